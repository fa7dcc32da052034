"""Page queries: image features of grids, gates, scores, sequences, duplicates, texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import grid, scores, text
from ..operators import dedup, report, selection, sequence
from .views import GRIDS_SQL, PAGES_SQL, grids, pages, table

Q = scores.features()
G = DEFAULT.gates


def _r(x, n: int = 6):
    return F.round(x, n)


def frame_quality(spark, sf_dir):
    """Grid measures, component scores and the screen score of every grid."""
    g = grids(spark, sf_dir)
    cells = F.col("grid")
    m = g.select("job", "id", grid.mean(cells).alias("brightness"), F.sqrt(grid.variance(cells)).alias("contrast"), grid.laplacian_variance(cells).alias("sharpness"), grid.edge_density(cells, 40.0).alias("edge_density"))
    m = m.withColumns(scores.component_scores(Q)).withColumns({"text_density": F.col("edge_density") * 0.05, "transition_penalty": F.lit(0.05), "stability_score": F.lit(0.95)})
    reasons = scores.rejection_reasons(lambda n: F.col(n) if n in m.columns else F.lit(scores.NEUTRAL.get(n, True)), False)
    out = m.withColumn("reasons", reasons)
    score = scores.frame_score(Q, False, F.size("reasons"))
    return out.select("job", "id", *[_r(F.col(c)).alias(c) for c in ("brightness", "contrast", "edge_density", "readability_score")], _r(F.col("sharpness"), 4).alias("sharpness"), _r(score).alias("score"), F.array_join("reasons", "|").alias("reasons"))


_CELL = "list_transform(range(1, 7), lambda r: list_transform(range(1, 7), lambda c: grid[r * 8 + c] + grid[r * 8 + c + 2] + grid[(r - 1) * 8 + c + 1] + grid[(r + 1) * 8 + c + 1] - 4 * grid[r * 8 + c + 1]))"
_EDGE = "list_sum(flatten(list_transform(range(0, 7), lambda r: list_transform(range(0, 7), lambda c: CASE WHEN abs(grid[r * 8 + c + 2] - grid[r * 8 + c + 1]) > 40 OR abs(grid[(r + 1) * 8 + c + 1] - grid[r * 8 + c + 1]) > 40 THEN 1 ELSE 0 END))))"


def _hashes(spark, sf_dir):
    return grids(spark, sf_dir).select("job", "id", "ord", "raw", grid.dhash(F.col("raw")).alias("h"))


def dhash(spark, sf_dir):
    return _hashes(spark, sf_dir).select("job", "id", "h", grid.hash_hex(F.col("h")).alias("hex"))


_DHASH = "+".join(f"CASE WHEN raw[{i + 2}] > raw[{i + 1}] THEN {1 << (55 - k)}::BIGINT ELSE 0 END" for k, i in enumerate(i for i in range(64) if i % 8 < 7))
HASH_SQL = f"{GRIDS_SQL}, h AS (SELECT job, id, raw, CAST({_DHASH} AS BIGINT) AS h FROM g)"


def hamming_pairs(spark, sf_dir):
    return dedup.band_pairs(_hashes(spark, sf_dir), "h", 15, bits=56)


def grid_similarity(spark, sf_dir):
    """Each grid against its predecessor: histogram, layout, profile and visual similarity."""
    g = grids(spark, sf_dir).select("job", "id", "unit").withColumn("lay", grid.layout(F.col("unit")))
    w = Window.partitionBy("job").orderBy("id")
    g = g.withColumns({"before": F.lag("unit").over(w), "lay0": F.lag("lay").over(w)}).where("before is not null")
    rows, cols = grid.profiles(F.col("lay"))
    rows0, cols0 = grid.profiles(F.col("lay0"))
    g = g.withColumns({"ha": grid.histogram(F.col("unit")), "hb": grid.histogram(F.col("before")), "ra": rows, "rb": rows0, "ca": cols, "cb": cols0})
    g = g.withColumns({
        "hist": grid.correlation(F.col("ha"), F.col("hb")), "diff": grid.mean_diff(F.col("unit"), F.col("before")), "layout": 1 - grid.mean_diff(F.col("lay"), F.col("lay0")),
        "profile": 1 - (grid.mean_diff(F.col("ra"), F.col("rb")) + grid.mean_diff(F.col("ca"), F.col("cb"))) / 2,
    })
    visual = scores.visual_similarity(F.col("hist"), F.col("diff"), F.col("layout"), F.col("profile"))
    return g.select("job", "id", *[_r(F.col(c), 8).alias(c) for c in ("hist", "layout", "profile")], _r(visual, 8).alias("visual"), _r(scores.cluster_similarity(F.col("hist"), F.col("diff")), 8).alias("cluster_similarity"))


def image_deltas(spark, sf_dir):
    """Each grid against its predecessor: changed share, mean difference, hash distance, transition score, motion."""
    w = Window.partitionBy("job").orderBy("id")
    g = _hashes(spark, sf_dir).select("job", "id", "h").join(grids(spark, sf_dir).select("job", "id", "grid"), ["job", "id"])
    g = g.withColumns({"before": F.lag("grid").over(w), "h0": F.lag("h").over(w)}).where("before is not null")
    change, diff = grid.moving_share(F.col("grid"), F.col("before"), 18.0), grid.mean_diff(F.col("grid"), F.col("before")) / 255
    motion = scores.motion_penalty(grid.moving_share(F.col("grid"), F.col("before"), 22.0), diff)
    g = g.withColumns({"change_ratio": change, "mean_diff": diff, "motion_penalty": motion})
    shown = [_r(F.col(c), 8).alias(c) for c in ("change_ratio", "mean_diff", "motion_penalty")]
    return g.select("job", "id", *shown, grid.hamming(F.col("h"), F.col("h0")).alias("hash_distance"), _r(0.7 * F.col("change_ratio") + 0.3 * F.col("mean_diff"), 8).alias("transition_score"))


_HIST = lambda x: f"list_transform(range(0, 32), lambda b: len(list_filter({x}, lambda v: floor(floor(v * 255) * 32 / 256) = b))::DOUBLE)"
_MEAN = lambda x: f"(list_sum({x}) / len({x}))"
_ZIP = lambda a, b: f"list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i]))"
_ROWS = lambda x: f"list_transform(range(0, 8), lambda r: list_sum({x}[r * 8 + 1:r * 8 + 8]) / 8)"
_COLS = lambda x: f"list_transform(range(1, 9), lambda c: list_sum(list_transform(range(0, 8), lambda r: {x}[r * 8 + c])) / 8)"
SIMILAR_SQL = f"""{GRIDS_SQL},
s1 AS (SELECT job, id, unit, list_transform(unit, lambda x: CASE WHEN x < list_sum(unit) / 64 THEN 1.0::DOUBLE ELSE 0 END) AS lay FROM u),
s2 AS (SELECT *, lag(unit) OVER w AS before, lag(lay) OVER w AS lay0 FROM s1 WINDOW w AS (PARTITION BY job ORDER BY id)),
s3 AS (SELECT *, {_HIST("unit")} AS ha, {_HIST("before")} AS hb, {_ROWS("lay")} AS ra, {_ROWS("lay0")} AS rb, {_COLS("lay")} AS ca, {_COLS("lay0")} AS cb FROM s2 WHERE before IS NOT NULL),
s4 AS (SELECT job, id, {_MEAN(_ZIP("unit", "before"))} AS diff, 1 - {_MEAN(_ZIP("lay", "lay0"))} AS layout, 1 - ({_MEAN(_ZIP("ra", "rb"))} + {_MEAN(_ZIP("ca", "cb"))}) / 2 AS profile,
  (SELECT CASE WHEN stddev_pop(ha[i]) * stddev_pop(hb[i]) > 1e-12 THEN (avg(ha[i] * hb[i]) - avg(ha[i]) * avg(hb[i])) / (stddev_pop(ha[i]) * stddev_pop(hb[i])) ELSE 1 END FROM unnest(range(1, 33)) AS t(i)) AS hist FROM s3)"""


def rejection_reasons(spark, sf_dir):
    p = pages(spark, sf_dir).withColumns(scores.component_scores(Q)).withColumn("stability_score", scores.stability(Q))
    reasons = scores.rejection_reasons(Q, F.col("camera"))
    p = p.withColumn("reasons", reasons)
    return p.select("id", F.array_join("reasons", "|").alias("reasons"), F.size("reasons").cast("long").alias("n_reasons"), _r(scores.frame_score(Q, F.col("camera"), F.size("reasons"))).alias("score"))


def _sum(weights: dict[str, float]) -> str:
    return " + ".join(f"{k} * {w!r}::DOUBLE" for k, w in weights.items())


SCORED_SQL = f"""{PAGES_SQL},
q1 AS (SELECT *, greatest(0, 1 - abs(brightness - 178) / 178) AS brightness_score, least(contrast / 72, 1) AS contrast_score, least(sharpness / 1800, 1) AS sharpness_score,
  greatest(0, 1 - least(transition_penalty, 1)) AS stability_score FROM p),
q2 AS (SELECT *, 0.4::DOUBLE * contrast_score + 0.35::DOUBLE * least(edge_density / 0.18::DOUBLE, 1) + 0.25::DOUBLE * sharpness_score AS readability_score FROM q1),
q3 AS (SELECT *, list_filter([CASE WHEN sharpness_score < {G.min_sharpness} THEN 'severe_defocus' END, CASE WHEN readability_score < {G.min_readability} THEN 'low_readability' END,
  CASE WHEN transition_penalty > {G.max_transition} THEN 'transition_motion' END, CASE WHEN text_density < {G.min_text_density} THEN 'insufficient_text_detail' END, CASE WHEN camera AND NOT found THEN 'no_page_detected' END,
  CASE WHEN camera AND found AND page_coverage < {G.min_coverage} THEN 'partial_page_visibility' END, CASE WHEN camera AND found AND rectangularity < {G.min_rectangularity} THEN 'incomplete_page_contour' END,
  CASE WHEN camera AND found AND single_page_score < {G.min_single_page} THEN 'spread_or_off_axis_page' END, CASE WHEN camera AND found AND occlusion_ratio > {G.max_occlusion} THEN 'occlusion_or_finger' END,
  CASE WHEN camera AND found AND background_intrusion_ratio > {G.max_background} THEN 'background_clutter' END, CASE WHEN camera AND found AND border_touch_ratio > {G.max_border} THEN 'page_touches_frame_border' END,
  CASE WHEN camera AND found AND contour_confidence < {G.min_contour_confidence} THEN 'weak_page_isolation' END, CASE WHEN camera AND found AND gutter_ratio > {G.max_gutter} THEN 'gutter_dominant_spread' END,
  CASE WHEN camera AND found AND opposing_page_ratio > {G.max_opposing} THEN 'opposing_page_visible' END, CASE WHEN camera AND found AND NOT normalized THEN 'unstable_normalization' END], lambda x: x IS NOT NULL) AS reasons FROM q2),
q AS (SELECT *, CASE WHEN camera THEN {_sum(scores.CAMERA_SCORE)} ELSE {_sum(scores.SCREEN_SCORE)} END - least(len(reasons) * 0.24::DOUBLE, 1.2::DOUBLE) AS score FROM q3)"""


def scored(spark, sf_dir):
    p = pages(spark, sf_dir).withColumns(scores.component_scores(Q)).withColumn("stability_score", scores.stability(Q))
    p = p.withColumn("reasons", scores.rejection_reasons(Q, F.col("camera")))
    return p.withColumn("score", scores.frame_score(Q, F.col("camera"), F.size("reasons")))


def frame_summary(spark, sf_dir):
    """Each job's frame summaries, nested in order; shown as text."""
    f = scored(spark, sf_dir).select("job", F.col("id").alias("idx"), F.col("start").alias("t"), "score", "reasons")
    s = report.frame_summaries(f)
    shown = F.transform("frames", lambda x: F.concat_ws(":", x["frame_index"].cast("string"), F.array_join(x["rejection_reasons"], "|")))
    return s.select("job", F.size("frames").cast("long").alias("n_frames"), F.md5(F.array_join(shown, ",")).alias("digest"))


def soft_filter(spark, sf_dir):
    return selection.soft_filter(pages(spark, sf_dir).withColumn("part", F.floor(F.col("id") / 100)), ["job", "part"]).select("job", "id", "rejected")


def weak_pages(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.select("id", *[scores.weak(Q, k).alias(f"weak_{k}") for k in ("duplicate", "sequence", "fixture")])


def _weak_sql(kind: str) -> str:
    cov, single, bg, tp = {"duplicate": (0.68, 0.78, 0.08, 0.14), "sequence": (0.6, 0.72, 0.1, 0.22), "fixture": (0.6, 0.72, 0.1, 0.2)}[kind]
    return f"(rejected OR page_coverage < {cov} OR single_page_score < {single} OR background_intrusion_ratio > {bg} OR transition_penalty > {tp})"


def selection_score(spark, sf_dir):
    p = scored(spark, sf_dir).withColumn("change_ratio", F.col("n_chars") % 50 / 50.0)
    rank = scores.selection_score(Q, F.col("start") + 0.1, F.col("start"), F.col("end"), F.col("camera"))
    best = selection.top_one(p.withColumn("rank", rank), ["job"], F.col("rank"), "id")
    return best.select("job", "id", _r(F.col("rank")).alias("rank"))


def stability_penalty(spark, sf_dir):
    w = Window.partitionBy("job").orderBy("ord")
    p = pages(spark, sf_dir)
    names = ("found", "page_coverage", "rectangularity", "perspective_score", "single_page_score", "border_touch_ratio")
    p = p.withColumns({f"before_{n}": F.lag(n).over(w) for n in names})
    total = scores.stability_penalty(Q, scores.features("before_")) + scores.camera_penalty(Q)
    return p.select("id", _r(scores.stability_penalty(Q, scores.features("before_"))).alias("stability_penalty"), _r(total).alias("transition_penalty"))


def clusters(spark, sf_dir):
    before = F.lag(F.col("n_chars") % 100).over(sequence.order_window())
    return sequence.sequence_clusters(scored(spark, sf_dir), 1 - F.abs(F.col("n_chars") % 100 - before) / 300.0)


def sequence_clusters(spark, sf_dir):
    return clusters(spark, sf_dir).select("job", "id", "cluster")


CLUSTER_SQL = f"""{SCORED_SQL},
c1 AS (SELECT *, CASE WHEN coalesce(start - lag("end") OVER w <= 1.8 AND 1 - abs(n_chars % 100 - lag(n_chars % 100) OVER w) / 300.0::DOUBLE >= 0.9, false) THEN 0 ELSE 1 END AS opens FROM q WINDOW w AS (PARTITION BY job ORDER BY start, ord)),
c AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY job ORDER BY start, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM c1)"""
_SIDE = lambda o: f"CASE WHEN {o} IS NULL THEN 0 WHEN bad AND {o} THEN 0.18::DOUBLE * 0.35::DOUBLE WHEN bad OR {o} THEN 0.18::DOUBLE ELSE 0 END"


def cluster_representative(spark, sf_dir):
    c = sequence.cluster_representatives(clusters(spark, sf_dir), scores.sequence_rank(Q), scores.weak(Q, "sequence"))
    return c.select("job", "id", "cluster", "page_number", _r(F.col("sequence_score")).alias("sequence_score"))


def _duplicate_evidence(k, p) -> dict:
    """Evidence of a pair of pages from their narrow features (stand-ins for image signatures)."""
    near = lambda n, s: 1 - F.abs(k[n] - p[n]) * s
    return {
        "hash_distance": F.bit_count(k["n_chars"].bitwiseXOR(p["n_chars"])).cast("long"), "gap": F.abs(k["start"] - p["start"]), "visual": near("page_coverage", 0.15), "layout": near("rectangularity", 0.1),
        "profile": near("single_page_score", 0.08), "tokens": near("perspective_score", 0.3), "ocr": F.lit(0.0), "text_heavy": F.least(k["text_density"], p["text_density"]) >= DEFAULT.text_density_cut,
        "either_weak": k["weak"] | p["weak"],
    }


def _evidence_arrays(k: dict, p: dict) -> dict:
    """``_duplicate_evidence`` on arrays."""
    near = lambda n, s: 1 - np.abs(k[n] - p[n]) * s
    return {
        "hash_distance": grid.hamming_arrays(k["n_chars"], p["n_chars"]), "gap": np.abs(k["start"] - p["start"]), "visual": near("page_coverage", 0.15), "layout": near("rectangularity", 0.1),
        "profile": near("single_page_score", 0.08), "tokens": near("perspective_score", 0.3), "ocr": 0.0, "text_heavy": np.minimum(k["text_density"], p["text_density"]) >= DEFAULT.text_density_cut,
        "either_weak": k["weak"] | p["weak"],
    }


_FIELDS = ["n_chars", "page_coverage", "rectangularity", "single_page_score", "perspective_score", "text_density", "weak"]


def _dedup_pages(spark, sf_dir):
    p = scored(spark, sf_dir).withColumn("weak", scores.weak(Q, "duplicate")).withColumn("rank", scores.duplicate_rank(Q))
    return p.select("job", "id", "ord", "start", "rank", *_FIELDS)


def near_dup_pairs(spark, sf_dir):
    """Pages with their predecessor: the full duplicate decision."""
    p = _dedup_pages(spark, sf_dir)
    w = Window.partitionBy("job").orderBy("start", "ord")
    p = p.withColumn("k", F.lag(F.struct("id", "start", *_FIELDS)).over(w)).where("k is not null").withColumn("me", F.struct("id", "start", *_FIELDS))
    e = _duplicate_evidence(F.col("k"), F.col("me"))
    p = p.withColumns(e)
    return p.select("job", F.col("k.id").alias("left_id"), F.col("id").alias("right_id"), scores.is_duplicate(Q, 2).alias("duplicate"))


def dedup_evidence(spark, sf_dir):
    """Greedy duplicates under the full evidence tree."""
    match = lambda k, p: scores.is_duplicate_arrays(_evidence_arrays(k, p), 2)
    return dedup.renumber(dedup.greedy_dedup_blocks(_dedup_pages(spark, sf_dir), match, ["start", *_FIELDS])).select("job", "slot", "id", "label")


_RANKED = f"{SCORED_SQL}, k AS (SELECT *, {_weak_sql('duplicate')} AS weak, {_sum(scores.DUPLICATE_RANK)} AS rank FROM q)"


def _tree(a: str, b: str) -> str:
    hd, gap = f"bit_count(xor({a}.n_chars, {b}.n_chars))", f"abs({a}.start - {b}.start) <= 2.4"
    near = lambda n, s: f"(1 - abs({a}.{n} - {b}.{n}) * {s}::DOUBLE)"
    v, lay, prof, tok = near("page_coverage", 0.15), near("rectangularity", 0.1), near("single_page_score", 0.08), near("perspective_score", 0.3)
    at = lambda x, y, z: f"({v} >= {x} AND {lay} >= {y} AND {prof} >= {z})"
    return f"""CASE WHEN {hd} > 8 AND {v} < 0.95 THEN false WHEN {gap} AND {at(0.98, 0.94, 0.92)} THEN true WHEN {gap} AND {at(0.72, 0.89, 0.93)} AND {tok} >= 0.84 AND ({a}.weak OR {b}.weak) THEN true
WHEN least({a}.text_density, {b}.text_density) >= 0.018 THEN ({at(0.93, 0.9, 0.93)} AND {tok} >= 0.9) OR ({gap} AND {at(0.9, 0.9, 0.93)} AND {tok} >= 0.97)
WHEN {gap} AND {at(0.94, 0.92, 0.9)} THEN true WHEN NOT {gap} AND {at(0.975, 0.95, 0.94)} THEN true ELSE false END"""


def dedup_greedy(spark, sf_dir):
    p = _hashes(spark, sf_dir).select("job", "id", "ord", F.lit(0.0).alias("start"), "h", F.element_at("raw", 1).alias("rank"))
    return dedup.greedy_dedup_blocks(p, lambda k, x: grid.hamming_arrays(k["h"], x["h"]) <= 19, ["h"])


def token_jaccard(spark, sf_dir):
    """Each document's tokens against its predecessor's in its source: identifiers alone go through the window by source."""
    d = table(spark, sf_dir, "documents")
    ids = d.select(F.col("source").alias("job"), F.col("doc_id").alias("id"))
    ids = ids.withColumn("last", F.lag("id").over(Window.partitionBy("job").orderBy("id"))).where("last is not null")
    tok = d.select(F.col("doc_id").alias("id"), F.array_distinct(F.split(text.normalize_text(F.col("text")), " ")).alias("tok"))
    pairs = ids.join(tok, "id").join(tok.select(F.col("id").alias("last"), F.col("tok").alias("before")), "last")
    return pairs.select("job", "id", _r(text.token_jaccard(F.col("tok"), F.col("before"))).alias("similarity"))


def text_normalize(spark, sf_dir):
    n = text.normalize_text(F.col("text"))
    return pages(spark, sf_dir).select("id", F.length(n).cast("long").alias("n"), F.md5(n).alias("digest"))


_LIST = "{'id': r.id, 'n_chars': r.n_chars, 'start': r.start, 'page_coverage': r.page_coverage, 'rectangularity': r.rectangularity, 'single_page_score': r.single_page_score, 'perspective_score': r.perspective_score, 'text_density': r.text_density, 'weak': r.weak, 'rank': r.rank}"
QUERIES = {
    "frame_quality": frame_quality, "dhash": dhash, "hamming_pairs": hamming_pairs, "grid_similarity": grid_similarity, "rejection_reasons": rejection_reasons, "frame_summary": frame_summary, "soft_filter": soft_filter,
    "weak_pages": weak_pages, "selection_score": selection_score, "stability_penalty": stability_penalty, "sequence_clusters": sequence_clusters, "cluster_representative": cluster_representative,
    "image_deltas": image_deltas, "near_dup_pairs": near_dup_pairs, "dedup_evidence": dedup_evidence, "dedup_greedy": dedup_greedy, "token_jaccard": token_jaccard, "text_normalize": text_normalize,
}

ORACLE_SQL = {
    "frame_quality": f"""WITH {GRIDS_SQL}, a AS (SELECT job, id, list_sum(grid) / 64 AS brightness, sqrt(greatest(0, list_sum(list_transform(grid, lambda x: x * x)) / 64 - (list_sum(grid) / 64) ** 2)) AS contrast,
  flatten({_CELL}) AS lap, {_EDGE} / 49 AS edge_density FROM g), b AS (SELECT *, greatest(0, list_sum(list_transform(lap, lambda x: x * x)) / 36 - (list_sum(lap) / 36) ** 2) AS sharpness FROM a),
c AS (SELECT *, greatest(0, 1 - abs(brightness - 178) / 178) AS bs, least(contrast / 72, 1) AS cs, least(sharpness / 1800, 1) AS ss, edge_density * 0.05::DOUBLE AS td FROM b),
d AS (SELECT *, 0.4::DOUBLE * cs + 0.35::DOUBLE * least(edge_density / 0.18::DOUBLE, 1) + 0.25::DOUBLE * ss AS rs FROM c),
e AS (SELECT *, list_filter([CASE WHEN ss < 0.24 THEN 'severe_defocus' END, CASE WHEN rs < 0.34 THEN 'low_readability' END, CASE WHEN td < 0.012 THEN 'insufficient_text_detail' END], lambda x: x IS NOT NULL) AS reasons FROM d)
SELECT job, id, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(edge_density, 6) AS edge_density, round(rs, 6) AS readability_score, round(sharpness, 4) AS sharpness,
  round(rs * 0.34::DOUBLE + ss * 0.24::DOUBLE + cs * 0.14::DOUBLE + bs * 0.08::DOUBLE + td * 7.5::DOUBLE + 0.95::DOUBLE * 0.2::DOUBLE - 0.05::DOUBLE * 0.45::DOUBLE - least(len(reasons) * 0.24::DOUBLE, 1.2::DOUBLE), 6) AS score, array_to_string(reasons, '|') AS reasons FROM e""",
    "dhash": f"WITH {HASH_SQL} SELECT job, id, h, printf('%016x', h) AS hex FROM h",
    "hamming_pairs": f"WITH {HASH_SQL} SELECT a.job, a.id AS left_id, b.id AS right_id, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS distance FROM h a JOIN h b ON a.job = b.job AND a.id < b.id AND bit_count(xor(a.h, b.h)) <= 15",
    "grid_similarity": f"""WITH {SIMILAR_SQL} SELECT job, id, round(hist, 8) AS hist, round(layout, 8) AS layout, round(profile, 8) AS profile,
  round(greatest(0, least(1, 0.4::DOUBLE * hist + 0.35::DOUBLE * (1 - least(diff / 0.15::DOUBLE, 1)) + 0.15::DOUBLE * layout + 0.1::DOUBLE * profile)), 8) AS visual,
  round(greatest(0, least(1, 0.7::DOUBLE * hist + 0.3::DOUBLE * (1 - least(diff / 0.14::DOUBLE, 1)))), 8) AS cluster_similarity FROM s4""",
    "image_deltas": f"""WITH {HASH_SQL}, x AS (SELECT g.job, g.id, grid, h, lag(grid) OVER w AS before, lag(h) OVER w AS h0 FROM g JOIN h USING (job, id) WINDOW w AS (PARTITION BY g.job ORDER BY g.id)),
y AS (SELECT job, id, CAST(bit_count(xor(h, h0)) AS BIGINT) AS hash_distance, {_ZIP("grid", "before")} AS d FROM x WHERE before IS NOT NULL),
z AS (SELECT job, id, hash_distance, len(list_filter(d, lambda v: v > 18)) / 64 AS c, len(list_filter(d, lambda v: v > 22)) / 64 AS m, list_sum(d) / 64 / 255 AS a FROM y)
SELECT job, id, hash_distance, round(c, 8) AS change_ratio, round(a, 8) AS mean_diff, round(least(0.85::DOUBLE * m + 0.6::DOUBLE * a, 0.65::DOUBLE), 8) AS motion_penalty, round(0.7::DOUBLE * c + 0.3::DOUBLE * a, 8) AS transition_score FROM z""",
    "rejection_reasons": f"WITH {SCORED_SQL} SELECT id, array_to_string(reasons, '|') AS reasons, len(reasons) AS n_reasons, round(score, 6) AS score FROM q",
    "frame_summary": f"WITH {SCORED_SQL} SELECT job, count(*) AS n_frames, md5(string_agg(id || ':' || array_to_string(reasons, '|'), ',' ORDER BY id)) AS digest FROM q GROUP BY job",
    "soft_filter": f"WITH {PAGES_SQL} SELECT job, id, rejected FROM p QUALIFY NOT rejected OR NOT bool_or(NOT rejected) OVER (PARTITION BY job, floor(id / 100))",
    "weak_pages": f"WITH {PAGES_SQL} SELECT id, {', '.join(f'{_weak_sql(k)} AS weak_{k}' for k in ('duplicate', 'sequence', 'fixture'))} FROM p",
    "selection_score": f"""WITH {SCORED_SQL}, s AS (SELECT *, score + greatest(0, 1 - 2 * (abs(start + 0.1::DOUBLE - (start + "end") / 2) / greatest("end" - start, 0.001))) * 0.12::DOUBLE
  + greatest(0, 1 - n_chars % 50 / 50.0::DOUBLE) * 0.16::DOUBLE + readability_score * 0.18::DOUBLE + least(text_density * 10, 0.18::DOUBLE) - CASE WHEN rejected THEN 0.65::DOUBLE ELSE 0 END
  + CASE WHEN camera THEN {_sum(scores.CAMERA_SELECTION)} ELSE 0 END AS rank FROM q)
SELECT job, id, round(rank, 6) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY rank DESC, id) = 1""",
    "stability_penalty": f"""WITH {PAGES_SQL}, s AS (SELECT *, CASE WHEN lag(found) OVER w IS NULL THEN 0 WHEN found AND lag(found) OVER w THEN least(abs(page_coverage - lag(page_coverage) OVER w) * 2, 0.32::DOUBLE)
  + least(abs(rectangularity - lag(rectangularity) OVER w), 0.18::DOUBLE) + least(abs(perspective_score - lag(perspective_score) OVER w) * 0.8::DOUBLE, 0.14::DOUBLE)
  + least(abs(single_page_score - lag(single_page_score) OVER w) * 0.9::DOUBLE, 0.18::DOUBLE) + least(abs(border_touch_ratio - lag(border_touch_ratio) OVER w) * 0.7::DOUBLE, 0.12::DOUBLE) ELSE 0.22 END AS sp FROM p WINDOW w AS (PARTITION BY job ORDER BY ord))
SELECT id, round(sp, 6) AS stability_penalty, round(sp + CASE WHEN found THEN 0 ELSE 0.35::DOUBLE END + greatest(0, 0.42::DOUBLE - page_coverage) + greatest(0, 0.58::DOUBLE - single_page_score) + greatest(0, background_intrusion_ratio - 0.08::DOUBLE) * 1.2::DOUBLE
  + greatest(0, border_touch_ratio - 0.05::DOUBLE) * 0.8::DOUBLE + occlusion_ratio * 1.1::DOUBLE, 6) AS transition_penalty FROM s""",
    "sequence_clusters": f"WITH {CLUSTER_SQL} SELECT job, id, cluster FROM c",
    "cluster_representative": f"""WITH {CLUSTER_SQL}, b AS (SELECT *, {_weak_sql("sequence")} AS bad FROM c), n AS (SELECT *, lag(bad) OVER w AS lb, lead(bad) OVER w AS rb FROM b WINDOW w AS (PARTITION BY job, cluster ORDER BY start, ord)),
s AS (SELECT *, {_sum(scores.SEQUENCE_RANK)} - CASE WHEN rejected THEN 0.4::DOUBLE ELSE 0 END - {_SIDE("lb")} - {_SIDE("rb")} AS ss FROM n),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job, cluster ORDER BY ss DESC, start, ord) = 1)
SELECT job, id, cluster, row_number() OVER (PARTITION BY job ORDER BY cluster) AS page_number, round(ss, 6) AS sequence_score FROM t""",
    "near_dup_pairs": f"""WITH {_RANKED}, n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY start, ord) AS rn FROM k)
SELECT b.job, a.id AS left_id, b.id AS right_id, {_tree("a", "b")} AS duplicate FROM n a JOIN n b ON a.job = b.job AND b.rn = a.rn + 1""",
    "dedup_evidence": f"""WITH RECURSIVE {_RANKED}, n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY start, ord) AS rn, count(*) OVER (PARTITION BY job) AS n FROM k),
w AS (SELECT r.job, r.rn, r.n, [{_LIST}] AS kept FROM n r WHERE rn = 1 UNION ALL SELECT job, rn, n, CASE WHEN at_i IS NULL THEN list_append(kept, item) WHEN item.rank > kept[at_i].rank THEN list_concat(list_append(kept[:at_i - 1], item), kept[at_i + 1:]) ELSE kept END
  FROM (SELECT w.job, r.rn, w.n, w.kept, {_LIST} AS item, list_position(list_transform(w.kept, lambda x: {_tree("x", "r")}), true) AS at_i FROM w JOIN n r ON r.job = w.job AND r.rn = w.rn + 1)),
l AS (SELECT job, unnest(range(1, len(kept) + 1)) AS slot, kept FROM w WHERE rn = n)
SELECT job, slot, kept[slot].id AS id, 'Page ' || slot AS label FROM l""",
    "dedup_greedy": f"""WITH RECURSIVE {HASH_SQL}, n AS (SELECT *, raw[1] AS rank, row_number() OVER (PARTITION BY job ORDER BY id) AS rn, count(*) OVER (PARTITION BY job) AS n FROM h),
w AS (SELECT job, rn, n, [{{'id': id, 'h': h, 'rank': rank}}] AS kept FROM n WHERE rn = 1 UNION ALL SELECT job, rn, n, CASE WHEN at_i IS NULL THEN list_append(kept, item) WHEN item.rank > kept[at_i].rank THEN list_concat(list_append(kept[:at_i - 1], item), kept[at_i + 1:]) ELSE kept END
  FROM (SELECT w.job, r.rn, w.n, w.kept, {{'id': r.id, 'h': r.h, 'rank': r.rank}} AS item, list_position(list_transform(w.kept, lambda x: bit_count(xor(x.h, r.h)) <= 19), true) AS at_i FROM w JOIN n r ON r.job = w.job AND r.rn = w.rn + 1)),
l AS (SELECT job, unnest(range(1, len(kept) + 1)) AS slot, kept FROM w WHERE rn = n)
SELECT job, slot, kept[slot].id AS id FROM l""",
    "token_jaccard": f"""WITH {PAGES_SQL}, t AS (SELECT job, id, list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS tok FROM p),
b AS (SELECT *, lag(tok) OVER (PARTITION BY job ORDER BY id) AS before FROM t)
SELECT job, id, round(len(list_intersect(tok, before)) / len(list_distinct(list_concat(tok, before))), 6) AS similarity FROM b WHERE before IS NOT NULL""",
    "text_normalize": "WITH x AS (SELECT doc_id AS id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n FROM documents) SELECT id, length(n) AS n, md5(n) AS digest FROM x",
}
