"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. Targets share the corpus by weight; a target stops at MOST times its source's size
and the excess is shared anew among the rest. A source's documents lie in blocks by a hash that is at
once the source's permutation, BLOCKS blocks to a stretch of about STRETCH_WORDS words (a source has
MAX_STRETCHES stretches at most, they are longer then). Its quota is the blocks of all whole passes
that its target allows and of one more pass up to the stretch in which the target is met. In that
stretch documents are taken in order until the next STRETCH_DOCS hold the rest, of which the subset
whose words add up best is taken, so the words taken come very near the target.

The quotas are split among SHARDS output shards by a binary tree: each node draws its left half's
quotas from a multivariate hypergeometric law, so every shard holds an exact, random share of blocks.
The tree runs over groups of sources first, then within each group, given the group's share of every
shard, which is the same law. A shard's blocks of a source are consecutive in the permutation, hence
disjoint; what is taken of a document is the sum of its draws over the shards. Within a shard rows are
ordered by hash. The same plan is made at every size.

Nothing that grows with documents or sources reaches the driver: it holds one row a group of sources
and one a partition of the table of sources.

Defined results: null text has size 0; null source is a source, the last; documents of size 0 are
taken like others of their block; equal rows (identifier, source and text) may be taken in part, any
so many of them; a text of any length is one document, taken whole; an empty table gives an empty
result; extra columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, n_words, nest, numbered, shared

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCKS = 16
STRETCH_WORDS_ALL, MAX_STRETCHES = 200_000, 65_536
#: The words left at most and the documents among which the best subset is sought.
STRETCH_WORDS, STRETCH_DOCS = 100_000, 600
SHARDS = 64
#: Groups of sources over which the tree runs on the driver.
GROUPS = 256
#: Rows of exceptions (16 bytes each) that may be broadcast.
EXCEPTION_ROWS = 200_000
SEED = 20


def fair_share(sources: DataFrame, most: float = MOST) -> float:
    """Words that a weight of one is due in (source_size, weight), none due more than ``most`` times its size.

    Each round caps the sources that are due more and shares their excess among the others.
    """
    some = sources.where("source_size > 0")
    row = some.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    if not row.total:
        return 0.0
    share = row.total / row.weight
    while True:
        over = F.col("weight") * F.lit(share) >= F.lit(most) * F.col("source_size")
        now = some.agg(F.sum(F.when(over, F.col("source_size"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if not now.free:
            return float("inf")
        more = (row.total - most * (now.capped or 0)) / now.free
        if more <= share:
            return share
        share = more


def split_quotas(quotas: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Quotas of each shard (rows) and source, by recursive halving; ``totals`` are the sums of the shards."""
    if len(totals) == 1:
        return quotas[None, :]
    half = len(totals) // 2
    take = int(totals[:half].sum())
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals") if take else np.zeros_like(quotas)
    return np.vstack([split_quotas(drawn, totals[:half], rng), split_quotas(quotas - drawn, totals[half:], rng)])


def even(total: int, shards: int) -> np.ndarray:
    return np.diff(np.array([total * i // shards for i in range(shards + 1)], dtype=np.int64))


def _within(shares: np.ndarray, seed: int) -> Callable:
    """The tree within a group of sources, given the group's blocks of each shard (a column of ``shares``)."""

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_no")
        g = int(rows["grp"].iloc[0])
        upto = split_quotas(rows["quota"].to_numpy(np.int64), shares[:, g], np.random.default_rng([seed, g])).cumsum(axis=0)
        return pd.DataFrame({"upto_no": rows["source_no"].to_numpy(), "upto": [upto[:, i].tolist() for i in range(len(rows))]})

    return split


def _place(id_: Column, source: Column, text: Column) -> Column:
    """Place of a document in its source's permutation: a 63-bit hash."""
    return F.xxhash64(F.lit(SEED), id_, source, text, id_.isNull(), source.isNull(), text.isNull()).bitwiseAND(F.lit((1 << 63) - 1))


def _block(place: Column, blocks: Column) -> Column:
    return F.shiftright(F.shiftright(place, 31) * blocks, 32)


def choose(sizes: list[int], room: int, above: bool = True) -> list[bool]:
    """Which of the sizes add up nearest to ``room`` (from below, or else from either side), by exact subset sums; the earliest where there is a choice."""
    mask = (1 << (2 * room + 2)) - 1
    reach = [1]  # bit s: sum s can be made of the sizes behind
    for s in reversed(sizes):
        reach.append((reach[-1] | reach[-1] << s) & mask)
    low = (reach[-1] & ((1 << (room + 1)) - 1)).bit_length() - 1
    over = reach[-1] >> (room + 1) if above else 0
    high = room + (over & -over).bit_length() if over else None
    want = high if high is not None and high - room < room - low else low
    out = []
    for i, s in enumerate(sizes):
        take = s <= want and bool(reach[len(sizes) - 1 - i] >> (want - s) & 1)
        out.append(take)
        want -= s * take
    return out


def fill(sizes: list[int], room: int) -> list[bool]:
    """Which of the sizes, which hold more than ``room``, to take: in order until the next STRETCH_DOCS that fit hold
    twice the room left (or are the last), then the best subset of those and the smallest size above the room left.
    While that misses the room and others behind fit what is left, they are tried too. Empty ones go with those
    around them."""
    taken, at, best = [False] * len(sizes), 0, (room + 1, [])
    while True:
        stretch, start = list(islice((i for i in range(at, len(sizes)) if 0 < sizes[i] <= room), STRETCH_DOCS)), at
        held, last = sum(sizes[i] for i in stretch), len(stretch) < STRETCH_DOCS
        for i in stretch:
            if sizes[i] > room or (room <= STRETCH_WORDS and (last and held > room or held >= 2 * room)):
                break
            taken[i], at = True, i + 1
            room, held = room - sizes[i], held - sizes[i]
        if at > start:
            continue
        over = min((i for i, s in enumerate(sizes) if not taken[i] and room < s < 2 * room), key=lambda i: sizes[i], default=None)
        tried = sorted([*stretch, *([over] if over is not None else [])])
        chosen = [i for i, t in zip(tried, choose([sizes[i] for i in tried], room)) if t]
        best = min(best, (abs(room - sum(sizes[i] for i in chosen)), [i for i, t in enumerate(taken) if t] + chosen), key=lambda b: b[0])
        if last or not best[0]:
            break
        for i, t in zip(stretch, choose([sizes[i] for i in stretch], room, above=False)):
            taken[i], room = t, room - sizes[i] * t
        at = stretch[-1] + 1
    found, end = set(best[1]), max(best[1], default=0)
    return [i in found or (i < end and not s) for i, s in enumerate(sizes)]


def fill_copies(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """``fill`` for rows that repeat: how many of each. Of many equal rows all but the last ones are taken at once."""
    taken, many = [0] * len(sizes), 2 * STRETCH_DOCS
    for i, (s, n) in enumerate(zip(sizes, counts)):
        if s and n > many:
            taken[i] = max(0, min(n, room // s) - STRETCH_DOCS)
            room -= taken[i] * s
    units = [i for i, (n, t) in enumerate(zip(counts, taken)) for _ in range(min(n - t, many))]
    for i, t in zip(units, fill([sizes[i] for i in units], room)):
        taken[i] += t
    return [n if not s and t else t for s, n, t in zip(sizes, counts, taken)]


def _fill(docs: pd.DataFrame) -> pd.DataFrame:
    """Cut of one source's last stretch: all before ``cut`` is taken and nothing behind it, but for the places listed with ``k``."""
    docs = docs.sort_values("place")
    places, counts = docs["place"].tolist(), docs["n"].astype(int).tolist()
    taken = fill_copies(docs["size"].astype(int).tolist(), counts, round(float(docs["room"].iloc[0])))
    # the cut with the fewest exceptions to either side
    short = [*accumulate(((t == n) - (t == 0) for t, n in zip(taken, counts)), initial=0)]
    at = max(range(len(short)), key=short.__getitem__)
    odd = [i for i, (t, n) in enumerate(zip(taken, counts)) if (t < n if i < at else t)]
    cut = places[at] if at < len(places) else places[-1] + 1
    column = lambda v: pd.array([None, *v], dtype="Int64")  # noqa: E731  no detour over floats
    out = pd.DataFrame({"cut": [cut] * (len(odd) + 1), "pick": column(places[i] for i in odd), "k": column(taken[i] for i in odd), "n": column(counts[i] for i in odd)})
    out.insert(0, "cut_no", int(docs["source_no"].iloc[0]))
    out.insert(1, "stretch", int(docs["stretch"].iloc[0]))
    return out


class Mix:
    """A mixing plan for ``docs``: ``sized`` (narrow, a row a document) and ``plan`` (a row a source)."""

    def __init__(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, seed: int = SEED):
        spark = docs.sparkSession
        self.id, self.text, self.source = (F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string"))
        cols = [self.id.alias("doc_id"), self.source.alias("source"), n_words(self.text).alias("size"), _place(self.id, self.source, self.text).alias("place")]
        self.sized = shared(docs.select(*cols), "mix-sizes")

        # Targets: sources by code point, weights in turn.
        sources = numbered(self.sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.asc_nulls_last("source")], "source_no", "mix-sources")
        turn = (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int")
        sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
        share = fair_share(sources)
        size = F.col("source_size")
        target = F.when(size > 0, F.least(F.col("weight") * F.lit(share), F.lit(float(MOST)) * size)).otherwise(0.0)
        sources = sources.withColumn("target", target)
        passes = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(MOST))).otherwise(0).cast("long")
        stretches = F.least(F.greatest(F.ceil(size / STRETCH_WORDS_ALL), F.lit(1)), F.lit(MAX_STRETCHES)).cast("long")
        sources = sources.withColumns({"passes": passes, "blocks": stretches * BLOCKS})
        sources = shared(sources.withColumn("room", F.greatest(F.col("target") - F.col("passes") * size, F.lit(0.0))).withColumnRenamed("source", "plan_source"), "mix-targets")
        self.rows = sources.count()

        # The stretch in which the last pass ends, then the documents taken in it.
        placed = join_small(self.sized, sources, F.col("source").eqNullSafe(F.col("plan_source")), "inner", self.rows).where("room > 0")
        stretch = F.floor(_block(F.col("place"), F.col("blocks")) / BLOCKS).alias("stretch")
        placed = placed.select("source_no", "place", "size", "room", stretch)
        sums = placed.groupBy("source_no", "stretch").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
        run = F.sum("words").over(Window.partitionBy("source_no").orderBy("stretch"))  # MAX_STRETCHES rows a source at most
        ends = sums.withColumn("run", run).where("run > room").groupBy("source_no").agg(F.min(F.struct("stretch", (F.col("room") - (F.col("run") - F.col("words"))).alias("room"))).alias("e"))
        ends = shared(ends.select("source_no", F.col("e.stretch").alias("stretch"), F.col("e.room").alias("left")), "mix-ends")
        inside = join_small(placed, ends, ["source_no", "stretch"], "inner", self.rows)
        inside = inside.groupBy("source_no", "stretch", "place").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("left").alias("room"))
        cuts = shared(inside.groupBy("source_no").applyInPandas(_fill, "cut_no long, stretch long, cut long, pick long, k long, n long"), "mix-cuts")
        self.picks = cuts.where("pick is not null").select(F.col("cut_no").alias("pick_no"), "pick", "k", "n")
        found = self.picks.agg(F.count("*").alias("all"), F.count_if(F.expr("k > 0 and k < n")).alias("partly")).first()
        self.exceptions, self.partly = found["all"], found.partly

        # The tree: quotas of blocks, over groups of sources and within them.
        ended = cuts.where("pick is null").select("cut_no", "cut", "stretch")
        quota = F.col("passes") * F.col("blocks") + F.coalesce((F.col("stretch") + 1) * BLOCKS, F.lit(0))
        quotas = join_small(sources, ended, F.col("source_no") == F.col("cut_no"), "left", self.rows).withColumns({"quota": quota, "grp": F.pmod("source_no", F.lit(GROUPS))})
        quotas = shared(quotas.drop("cut_no", "stretch"), "mix-quotas")
        groups = np.zeros(GROUPS, np.int64)
        for r in quotas.groupBy("grp").agg(F.sum("quota").alias("q")).collect():
            groups[r.grp] = r.q
        self.shares = split_quotas(groups, even(int(groups.sum()), shards), np.random.default_rng(seed))
        upto = quotas.select("source_no", "quota", "grp").groupBy("grp").applyInPandas(_within(self.shares, seed), "upto_no long, upto array<long>")
        self.plan = shared(join_small(quotas, upto, F.col("source_no") == F.col("upto_no"), "inner", self.rows).drop("upto_no", "grp", "weight", "room"), "mix-plan")

    def _planned(self, df: DataFrame) -> DataFrame:
        """``df`` (source, place, ...) with the plan of its source and ``shards``, the shard of each draw of the row."""
        out = join_small(df, self.plan, F.col("source").eqNullSafe(F.col("plan_source")), "inner", self.rows)
        takes = F.col("passes") + F.coalesce((F.col("place") < F.col("cut")).cast("int"), F.lit(0))
        if self.exceptions:
            out = join_small(out, self.picks, (F.col("source_no") == F.col("pick_no")) & (F.col("place") == F.col("pick")), "left", self.exceptions, EXCEPTION_ROWS)
            takes = F.when(F.col("k").isNull(), takes).when(F.col("k") == F.col("n"), F.col("passes") + 1).otherwise(F.col("passes"))
        rows = out.withColumn("takes", takes)
        if self.partly:
            rows = rows.where("not coalesce(k > 0 and k < n, false)").unionByName(self._part(rows.where("k > 0 and k < n")))
        # the shard of a draw: how many shards' blocks of the source end before it
        draw = lambda p: p * F.col("blocks") + _block(F.col("place"), F.col("blocks"))
        drawn = F.transform(F.sequence(F.lit(0).cast("long"), F.col("takes") - 1), lambda p: F.size(F.filter("upto", lambda x: x <= draw(p))).cast("long"))
        return rows.withColumn("shards", F.when(F.col("takes") > 0, drawn).otherwise(F.array().cast("array<bigint>")))

    def _part(self, equal: DataFrame) -> DataFrame:
        """Of ``n`` equal rows ``k`` are taken once more: ranks within a partition, then counts over the partitions."""
        equal = shared(equal.withColumns({"in_part": F.spark_partition_id(), "in_row": F.monotonically_increasing_id()}), "mix-equal")
        same = ["source_no", "place", "in_part"]
        counts = equal.groupBy(*same).agg(F.count("*").alias("here"))
        before = F.coalesce(F.sum("here").over(Window.partitionBy("source_no", "place").orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = equal.withColumn("rank", F.row_number().over(Window.partitionBy(*same).orderBy("in_row")))
        ranked = ranked.join(counts.withColumn("before", before).drop("here"), same)
        taken = F.col("passes") + (F.col("rank") + F.col("before") <= F.col("k")).cast("int")
        return ranked.withColumn("takes", taken).drop("in_part", "in_row", "rank", "before")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document, and ``draws``: the words that each shard draws of it."""
        draws = F.array_join(F.transform("shards", lambda s: F.concat_ws(":", s.cast("string"), F.col("size").cast("string"))), ",")
        words = F.aggregate("shards", F.lit(0).cast("long"), lambda n, _: n + F.col("size"))
        return self._planned(self.sized).select("doc_id", "size", "source_size", "target", words.alias("taken"), draws.alias("draws"))

    def rows_of(self, docs: DataFrame) -> DataFrame:
        """The mixed rows: ``row`` (all columns of ``docs``), shard and place, shard by shard in shuffled order."""
        df = docs.select(self.source.alias("source"), _place(self.id, self.source, self.text).alias("place"), nest(docs).alias("row"))
        out = self._planned(df).select("row", "place", F.posexplode("shards").alias("pass", "shard")).select("row", "shard", F.xxhash64("place", "pass").alias("order"))
        # a shard of any size: parts of it by the leading bits of the order
        return out.repartition("shard", F.shiftright("order", 56)).sortWithinPartitions("shard", "order")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``; a document appears as often as it is taken."""
    return Mix(docs, **options).rows_of(docs).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    return Mix(docs).taken()
