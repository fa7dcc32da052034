"""From image frames to pages: the whole reconstruction as one plan.

Pixels are read twice, once for features (a map that leaves numbers and miniatures of each frame) and
once for the few selected pages; no window or shuffle between carries them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Settings
from ..functions import document, grid, images, scores
from ..operators import dedup, sampling, segments, selection, sequence
from ..sources.images import to_array

FEATURES = ("sharpness", "brightness", "contrast", "edge_density", "text_density", *scores.NEUTRAL)
_NUMBERS = ", ".join(f"{n} double" for n in FEATURES)
FEATURE_SCHEMA = f"job string, idx long, t double, {_NUMBERS}, phash string, found boolean, normalized boolean, small array<binary>"


class Reconstruction(NamedTuple):
    frames: DataFrame
    segments: DataFrame
    selected: DataFrame
    collapsed: DataFrame
    pages: DataFrame


def frame_features(frames: DataFrame, camera: bool) -> DataFrame:
    """Features of each frame and its change against the previous one.

    Pixels are read where they lie: a map turns each frame into its measures and the miniatures that
    comparisons need, and only those are brought together by job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for r in part.itertuples():
                image = to_array(r.height, r.width, r.data)
                d = document.detect(image) if camera else {}
                seen = d.get("corrected", image)
                m = images.measures(seen)
                m |= {k: float(d.get(k, v)) for k, v in scores.NEUTRAL.items()} | {"text_density": d.get("text_density", m["edge_density"])}
                rows.append({"job": r.job, "idx": r.idx, "t": r.t, **m, "phash": images.dhash(seen), "found": d.get("found", True), "normalized": d.get("normalized", True), "small": images.miniatures(image)})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURE_SCHEMA.split(", ")])

    found = frames.select("job", "idx", "t", "height", "width", "data").mapInPandas(run, FEATURE_SCHEMA)
    w = segments.order_window()
    found = found.withColumn("_d", _image_deltas("small", F.lag("small").over(w))).drop("small")
    found = found.withColumns({"change": F.col("_d.change"), "diff": F.col("_d.diff")})
    penalty = F.coalesce("_d.motion", F.lit(0.0))
    if camera:
        q = scores.features()
        moving = ("found", "page_coverage", "rectangularity", "perspective_score", "single_page_score", "border_touch_ratio")
        found = found.withColumns({f"_before_{n}": F.lag(n).over(w) for n in moving})
        penalty = penalty + scores.camera_penalty(q) + scores.stability_penalty(q, scores.features("_before_"))
    return found.withColumn("transition_penalty", penalty).drop(*[c for c in found.columns if c.startswith("_")])


@F.pandas_udf(T.StructType().add("change", "double").add("diff", "double").add("motion", "double"))
def _image_deltas(now: pd.Series, before: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if b is None else images.deltas(b, a) for a, b in zip(now, before)]
    return pd.DataFrame(rows, columns=["change", "diff", "motion"], dtype="float64")


def quality(features: DataFrame, camera: bool, settings: Settings = DEFAULT) -> DataFrame:
    """Adds component scores, gates and the frame score."""
    q = scores.features()
    df = features.withColumns(scores.component_scores(q)).withColumn("stability_score", scores.stability(q))
    df = df.withColumn("reasons", scores.rejection_reasons(q, camera, settings.gates))
    return df.withColumns({"rejected": F.size("reasons") > 0, "score": scores.frame_score(q, camera, F.size("reasons"))})


def _signatures(pages: DataFrame, camera: bool) -> DataFrame:
    """Signatures of the selected pages, each computed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                image = to_array(r.height, r.width, r.data)
                final = image if min(r.page_coverage, r.contour_confidence, r.single_page_score) >= 0.999 else document.finish(image)
                page = images.render(final)
                out.append((r.job, r.idx, images.raw_signature(image).ravel(), images.content_signature(page).ravel(), images.layout_signature(page).ravel(), images.structure_tokens(page)))
            yield pd.DataFrame(out, columns=["job", "idx", "raw", "content", "layout", "tokens"])

    schema = "job string, idx long, raw array<double>, content array<double>, layout array<double>, tokens array<string>"
    return pages.select("job", "idx", "height", "width", "data", "page_coverage", "contour_confidence", "single_page_score").mapInPandas(run, schema)


@F.pandas_udf(T.DoubleType())
def _cluster_similarity_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if y is None else images.cluster_similarity(np.asarray(x).reshape(56, 56), np.asarray(y).reshape(56, 56)) for x, y in zip(a, b)], dtype="float64")


def evidence(a: dict, b: dict) -> dict:
    """Evidence of a pair of pages with precomputed signatures."""
    ca, cb, la, lb = (np.asarray(p[k]).reshape(n, n) for k, n in (("content", 48), ("layout", 40)) for p in (a, b))
    layout, profile = 1 - images.layout_diff(la, lb), 1 - images.profile_diff(la, lb)
    diff = float(np.abs(ca - cb).mean())
    visual = 0.4 * images.histogram_similarity(ca, cb) + 0.35 * (1 - min(diff / (2 * DEFAULT.duplicate_content_diff), 1.0)) + 0.15 * layout + 0.1 * profile
    ta, tb = set(a["tokens"]), set(b["tokens"])
    ha, hb = a["phash"], b["phash"]
    return {
        "hash_distance": (int(ha, 16) ^ int(hb, 16)).bit_count() + 4 * abs(len(ha) - len(hb)), "gap": abs(a["start"] - b["start"]), "visual": max(0.0, min(visual, 1.0)), "layout": layout, "profile": profile,
        "tokens": len(ta & tb) / len(ta | tb) if ta and tb else 0.0, "ocr": 0.0, "text_heavy": min(a["text_density"], b["text_density"]) >= DEFAULT.text_density_cut, "either_weak": a["weak"] or b["weak"],
    }


def is_duplicate(e: dict, max_hash: int, window: float = DEFAULT.duplicate_window_seconds) -> bool:
    """The duplicate rules on plain values, as ``scores.is_duplicate`` has them on columns."""
    near = e["gap"] <= window
    at = lambda v, lay, prof: e["visual"] >= v and e["layout"] >= lay and e["profile"] >= prof
    if e["hash_distance"] > max_hash + 6 and e["visual"] < 0.95:
        return False
    if near and (at(0.98, 0.94, 0.92) or (at(0.72, 0.89, 0.93) and e["tokens"] >= 0.84 and e["either_weak"])):
        return True
    if e["text_heavy"]:
        return (at(0.93, 0.9, 0.93) and max(e["ocr"], e["tokens"]) >= DEFAULT.text_similarity) or (near and at(0.9, 0.9, 0.93) and e["tokens"] >= 0.97)
    return at(DEFAULT.low_text_visual, 0.92, 0.9) if near else at(DEFAULT.far_visual, 0.95, 0.94)


def collapse(pages: DataFrame) -> DataFrame:
    """Cluster representatives of pages with raw signatures; a lone page of a job stays as it is."""
    before = F.lag("raw").over(sequence.order_window())
    similar = pages.withColumn("_before", before).withColumn("_similar", _cluster_similarity_of("raw", "_before")).drop("_before")
    clustered = sequence.sequence_clusters(similar, F.col("_similar")).drop("_similar")
    q = scores.features()
    return sequence.cluster_representatives(clustered, scores.sequence_rank(q), scores.weak(q, "sequence"))


def match_keys(max_hash: int) -> Callable[[dict], tuple[list, list]]:
    """Keys of which two pages that ``is_duplicate`` accepts share one.

    Either their hashes differ in at most ``max_hash + 6`` bits, so one more bands than that agree in one,
    or their visual similarity is 0.95 at least. Then the mean difference of their contents takes no more
    than 0.05 of its weight of 0.35, and no less does the difference of their means.
    """
    n = max_hash + 7
    cuts = [i * 64 // n for i in range(n + 1)]
    width = 0.05 / 0.35 * 2 * DEFAULT.duplicate_content_diff * (1 + 1e-6)

    def keys(page: dict) -> tuple[list, list]:
        h, level = int(page["phash"], 16), int(np.mean(page["content"]) // width)
        bands = [(i, h >> a & (1 << b - a) - 1) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        return bands + [("level", level)], bands + [("level", level + d) for d in (-1, 0, 1)]

    return keys


_EVIDENCE = ["phash", "content", "layout", "tokens", "text_density", "weak"]


def remove_duplicates(pages: DataFrame, max_hash: int) -> DataFrame:
    """Greedy duplicates of pages with signatures; kept pages with slot, page_number and label."""
    q = scores.features()
    ranked = pages.withColumns({"rank": scores.duplicate_rank(q), "weak": scores.weak(q, "duplicate"), "id": F.col("idx")})
    kept = dedup.greedy_dedup_pandas(ranked, lambda a, b: is_duplicate(evidence(a, b), max_hash), _EVIDENCE, match_keys(max_hash))
    return dedup.renumber(kept).join(ranked.drop("page_number", "label", "slot"), ["job", "id"])


def reconstruct(frames: DataFrame, fps: float, mode: str = "screen", settings: Settings = DEFAULT) -> Reconstruction:
    """Pages of every job in ``frames`` (job, idx, t, height, width, data)."""
    config, camera = settings.mode(mode), mode == "camera"
    sampled = sampling.sample_frames(frames, F.lit(fps), F.lit(config.sample_fps))
    found = quality(frame_features(sampled, camera), camera, settings).persist()
    distance = grid.hamming(grid.hash_from_hex(F.col("phash")), grid.hash_from_hex(F.lag("phash").over(segments.order_window())))
    deltas = segments.frame_deltas(found, F.col("change"), F.col("diff"), distance)
    marked = segments.with_transitions(segments.with_thresholds(deltas, config))
    members = segments.segment_frames(segments.with_splits(marked), config)
    rank = scores.selection_score(scores.features(), F.col("t"), F.col("start"), F.col("end"), camera)
    selected = selection.best_frames(members, rank).withColumn("ord", F.col("seg_no"))
    chosen = selected.select("job", "idx", "page_coverage", "contour_confidence", "single_page_score").join(frames.select("job", "idx", "height", "width", "data"), ["job", "idx"])
    signed = selected.join(_signatures(chosen, camera), ["job", "idx"]).persist()
    collapsed = collapse(signed)
    collapsed = collapsed.withColumn("ord", F.row_number().over(Window.partitionBy("job").orderBy("cluster")))
    return Reconstruction(found, members, selected, collapsed, remove_duplicates(collapsed, config.dedupe_threshold))
