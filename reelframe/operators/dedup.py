"""Duplicate pages: candidate pairs and greedy resolution with replacement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages that the block fold looks at together, and slots that it looks at first and at most together.
PAGES, FIRST_SLOTS, SLOTS = 2048, 32, 256
#: Slot of a page that no kept page matches, behind all others.
NONE = np.iinfo(np.int64).max


def band_pairs(pages: DataFrame, key: str, most: int, bits: int = 64, group: str = "job") -> DataFrame:
    """Pairs (group, left_id, right_id, distance) of a group whose hashes differ in at most ``most`` bits.

    The hash is cut into ``most + 1`` bands; pairs that close agree on a band, so the join is on
    (group, band, value) and never on all pairs. Each pair is found in its first common band only.
    """
    n = most + 1
    cuts = [round(i * bits / n) for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col(key).bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)])
    side = pages.select(F.col(group), F.col("id"), F.col(key).alias("h"), F.explode(bands).alias("b")).select(group, "id", "h", "b.*")
    left, right = side.select(group, "band", "value", F.col("id").alias("left_id"), F.col("h").alias("lh")), side.select(group, "band", "value", F.col("id").alias("right_id"), F.col("h").alias("rh"))
    x = F.col("lh").bitwiseXOR(F.col("rh"))
    first = F.lit(n)
    for i in reversed(range(n)):
        first = F.when(x.bitwiseAND(F.lit(signed[i])) == 0, i).otherwise(first)
    distance = F.bit_count(x).cast("long")
    pairs = left.join(right, [group, "band", "value"]).where((F.col("left_id") < F.col("right_id")) & (distance <= most) & (F.col("band") == first))
    return pairs.select(group, "left_id", "right_id", distance.alias("distance"))


def greedy_dedup(pages: DataFrame, matches: Callable[[Column, Column], Column], fields: list[str], rank: str = "rank") -> DataFrame:
    """Greedy duplicates of each job as a fold over its ordered pages: (job, slot, id).

    Pages are visited by (start, ord). The first kept page that matches takes the newcomer in: a
    strictly higher rank takes over the slot, and later pages compare with the page that stands there.
    ``fields`` are the columns that ``matches(kept, page)`` reads. The fold holds one job's narrow rows and
    costs pages times kept pages in interpreted columns: it is for short jobs, ``greedy_dedup_blocks`` for any.
    """
    item = F.struct("start", "ord", F.col("id"), F.col(rank).alias("rank"), *[c for c in fields if c not in ("start", "ord", "id", "rank")])
    listed = pages.groupBy("job").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = listed.schema["items"].dataType
    empty = F.array().cast(kind)

    def step(kept: Column, p: Column) -> Column:
        # (slots looked at, slot of the first match or 0): behind the first match no evidence is evaluated
        seen = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))
        look = lambda s, k: F.struct((s["n"] + 1).alias("n"), F.when(s["at"] > 0, s["at"]).when(matches(k, p), s["n"] + 1).otherwise(0).alias("at"))
        at = F.aggregate(kept, seen, look, lambda s: s["at"])
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (p["rank"] > k["rank"]), p).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(p))).otherwise(swapped)

    done = listed.select("job", F.posexplode(F.aggregate("items", empty, step)).alias("slot", "page"))
    return done.select("job", (F.col("slot") + 1).cast("long").alias("slot"), F.col("page.id").alias("id"))


class _Fold:
    """Kept pages of one job; pages come in blocks of arrays, in order."""

    def __init__(self, matches: Callable[[dict, dict], np.ndarray]):
        self.matches, self.n, self.ids = matches, 0, []
        self.kept: dict[str, np.ndarray] = {}

    def _put(self, slot: int, page: dict, i: int, new: object) -> None:
        if not self.kept:
            self.kept = {f: np.empty(64, v.dtype) for f, v in page.items()}
        if slot == len(self.kept["_rank"]):
            self.kept = {f: np.concatenate([v, np.empty_like(v)]) for f, v in self.kept.items()}
        for f, v in page.items():
            self.kept[f][slot] = v[i]
        self.ids[slot:slot + 1] = [new]
        self.n = max(self.n, slot + 1)

    def _match(self, a: int, b: int, pages: dict) -> np.ndarray:
        """Which pages (rows) match which of the slots a to b (columns)."""
        k, p = {f: v[None, a:b] for f, v in self.kept.items()}, {f: v[:, None] for f, v in pages.items()}
        return self.matches(k, p) & ~(k["_blank"] | p["_blank"])

    def _first(self, pages: dict, at: np.ndarray, slot: int) -> np.ndarray:
        """First matching slot, from ``slot`` on, of the pages at ``at``."""
        out, left, step = np.full(len(at), NONE), np.arange(len(at)), FIRST_SLOTS
        while slot < self.n and len(left):
            end = min(slot + step, self.n)
            m = self._match(slot, end, {f: v[at[left]] for f, v in pages.items()})
            hit = m.argmax(axis=1)
            found = m[np.arange(len(left)), hit]
            out[left[found]] = slot + hit[found]
            left, slot, step = left[~found], end, min(2 * step, SLOTS)
        return out

    def take(self, pages: dict, ids: pa.Array) -> None:
        """Between two changes of a slot nothing depends on the order, so only changes are taken singly."""
        n = len(ids)
        first = self._first(pages, np.arange(n), 0)

        def moves(i: int) -> np.ndarray:
            if not self.n:
                return np.ones(n - i, bool)
            f = first[i:]
            stands = self.kept["_rank"][np.minimum(f, self.n - 1)]
            return (f == NONE) | (pages["_rank"][i:] > np.where(stands == -NONE, NONE, stands))

        at, change = 0, moves(0)
        while at < n and (c := int(change.argmax())) < n - at and change[c]:
            at += c
            slot = min(int(first[at]), self.n)
            new = slot == self.n
            self._put(slot, pages, at, ids[at].as_py())
            at += 1
            if at == n:
                break
            rest = {f: v[at:] for f, v in pages.items()}
            match, f = self._match(slot, slot + 1, rest)[:, 0], first[at:]
            lost = np.empty(0, np.int64) if new else np.flatnonzero((f == slot) & ~match)
            f[(f > slot) & match] = slot
            if len(lost):
                f[lost] = self._first(rest, lost, slot + 1)
            change = moves(at)


def _ordered(rank: pa.Array) -> np.ndarray:
    """Ranks as long numbers of the same order, NaN highest as in SQL; null is -NONE, below all."""
    if pa.types.is_floating(rank.type):
        x = rank.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
        bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
        key = np.where(np.isnan(x), NONE - 1, np.where(bits < 0, bits ^ NONE, bits))
    else:
        key = rank.cast(pa.int64()).fill_null(0).to_numpy()
    return np.where(rank.is_null().to_numpy(zero_copy_only=False), -NONE, key)


def _values(x: pa.Array) -> np.ndarray:
    return (x.fill_null(False if pa.types.is_boolean(x.type) else 0) if x.null_count else x).to_numpy(zero_copy_only=False)


def greedy_dedup_blocks(pages: DataFrame, matches: Callable[[dict, dict], np.ndarray], fields: list[str], rank: str = "rank") -> DataFrame:
    """The fold of ``greedy_dedup`` over a sorted stream of pages: (job, slot, id).

    ``matches(kept, page)`` gets arrays of the ``fields`` (numbers or booleans) that broadcast against each
    other; a page with a null among them matches none. Spark sorts the pages, and a task holds no more than
    the kept pages of one job and a block. Pages that change no slot, all but a few, are settled a block at a time.
    """
    read = list(dict.fromkeys(fields))
    sort = ["job", "start", "ord", "id", "_rank", *[c for c in read if c not in ("start", "ord", "id")]]
    narrow = pages.withColumn("_rank", F.col(rank)).select(*sort)
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, fold = None, None

        def done() -> pa.RecordBatch:
            columns = [pa.array([job] * fold.n, like["job"].type), pa.array(range(1, fold.n + 1), pa.int64()), pa.array(fold.ids, like["id"].type)]
            return pa.RecordBatch.from_arrays(columns, ["job", "slot", "id"])

        for batch in batches:
            like = {f.name: f for f in batch.schema}
            runs = pc.run_end_encode(batch.column("job"))
            ends = runs.run_ends.to_pylist()
            for begin, end, name in zip([0, *ends], ends, runs.values.to_pylist()):
                if fold is None or name != job:
                    if fold is not None:
                        yield done()
                    job, fold = name, _Fold(matches)
                for a in range(begin, end, PAGES):
                    part = batch.slice(a, min(PAGES, end - a))
                    blank = np.any([part.column(c).is_null().to_numpy(zero_copy_only=False) for c in read], axis=0)
                    fold.take({c: _values(part.column(c)) for c in read} | {"_rank": _ordered(part.column("_rank")), "_blank": blank}, part.column("id"))
        if fold is not None:
            yield done()

    return narrow.repartition("job").sortWithinPartitions(*sort).mapInArrow(run, f"job {kinds['job']}, slot long, id {kinds['id']}")


def greedy_dedup_pandas(pages: DataFrame, matches: Callable[[dict, dict], bool], columns: list[str], keys: Callable[[dict], tuple[list, list]] | None = None) -> DataFrame:
    """The same fold for evidence that columns can't express (image signatures): one job a group.

    ``pages`` has job, id, start, ord, rank and ``columns``; signatures come precomputed, once a page.
    ``keys(page)`` gives the keys that a kept page is filed under and those a newcomer looks under; pages
    that match must share one. Then a newcomer meets the pages under its keys only, and its cost doesn't
    grow with all pages kept; without it, it meets all of them. Either way the first match ends the search.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        filed: dict[object, set[int]] = {}

        def file(slot: int, page: dict, add: bool) -> None:
            for k in keys(page)[0] if keys else ():
                (filed.setdefault(k, set()).add if add else filed[k].discard)(slot)

        for page in group.sort_values(["start", "ord"], kind="stable").to_dict("records"):
            met = sorted(set().union(*(filed.get(k, ()) for k in keys(page)[1]))) if keys else range(len(kept))
            at = next((i for i in met if matches(kept[i], page)), None)
            if at is None:
                file(len(kept), page, True)
                kept.append(page)
            elif page["rank"] > kept[at]["rank"]:
                file(at, kept[at], False)
                file(at, page, True)
                kept[at] = page
        return pd.DataFrame({"job": [k["job"] for k in kept], "slot": range(1, len(kept) + 1), "id": [k["id"] for k in kept]})

    narrow = pages.select("job", "id", "start", "ord", "rank", *columns)
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.groupBy("job").applyInPandas(fold, f"job {kinds['job']}, slot long, id {kinds['id']}")


def renumber(pages: DataFrame) -> DataFrame:
    """Adds page_number and label by slot."""
    n = F.row_number().over(Window.partitionBy("job").orderBy("slot")).cast("long")
    return pages.withColumn("page_number", n).withColumn("label", F.concat(F.lit("Page "), F.col("page_number")))
