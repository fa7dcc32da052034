"""SimHash near-duplicates by pigeonhole blocks.

Every text gets a 64-bit fingerprint; fingerprints link at ``distance`` or fewer differing bits.
Distinct fingerprints are split into ``distance + 3`` blocks. Two that link differ in at most
``distance`` blocks, so they agree in some 3 blocks: each triple of blocks is a join key (38 bits at
distance 2, 32 at 3, 27 at 4), and every pair that meets is verified by its Hamming distance within the
join. A key that more than HOT fingerprints share is not paired up: its members meet at the
fingerprints half the distance away. At an even distance two link exactly if they share such a hub; at
an odd one exactly if one of them is nearer to it by a bit. A star around a nearer member links them,
which is linear in the members and loses no link. Keys of larger distances are less selective and their
hubs more (27 a member at distance 2, 529 at 3, 704 at 4), so the distance should stay small.

Defined results: null or wordless text has fingerprint 0 and links like any other; texts of any length
are read whole, in bounded memory beside the text; null identifiers never name a component unless all
of it is null; repeated rows get equal results; an empty table gives an empty result; extra columns are
ignored or carried, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import nest, shared
from .components import connected

BITS = 64
#: Keys with more members than this meet at neighbouring fingerprints instead of pairwise.
HOT = 64
SEED = 42
_UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of UTF-8 text as an unsigned integer."""
    words = text.translate(_UP).split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):  # a bounded block of bits at a time
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(width: int):
    @F.arrow_udf(T.LongType())
    def run(text: pa.Array) -> pa.Array:
        raw = text.cast(pa.large_binary())
        found = np.fromiter((fingerprint(t.as_py() or b"", width) for t in raw), np.uint64, len(raw))
        return pa.array(found.view(np.int64))

    return run


def blocks(distance: int) -> list[int]:
    """Bit masks of ``distance + 3`` blocks of nearly equal width."""
    n = distance + 3
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect exactly those within ``distance``.

    Pairs of a hot key are given as stars of true links around a fingerprint near each
    shared hub, enough for components; other pairs are listed one by one.
    """
    masks = [_signed(sum(m)) for m in combinations(blocks(distance), 3)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    keyed = prints.select("fp", keys.alias("k")).select("fp", "k.no", "k.key")
    sizes = keyed.groupBy("no", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = shared(keyed.join(sizes, ["no", "key"]), "simhash-keys")
    few = met.where(F.col("n") <= HOT).select("no", "key", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["no", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")

    # Flips of the bits outside a key by half the distance: their number follows from the distance alone.
    near_by, far_by = distance // 2, (distance + 1) // 2
    free = [[1 << i for i in range(BITS) if not m >> i & 1] for m in (sum(c) for c in combinations(blocks(distance), 3))]
    flips = [(no, _signed(sum(f)), n <= near_by) for no, some in enumerate(free) for n in range(far_by + 1) for f in combinations(some, n)]
    flips = F.broadcast(prints.sparkSession.createDataFrame(flips, "no int, flip long, nearer boolean"))
    hubs = met.where(F.col("n") > HOT).join(flips, "no").select("no", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"), "nearer")
    least = hubs.groupBy("no", "key", "hub").agg(F.min(F.when(F.col("nearer"), F.col("fp"))).alias("a"), F.count("*").alias("m")).where("m > 1 and a is not null").drop("m")
    stars = hubs.join(least, ["no", "key", "hub"]).where("a <> fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", distance: int = 2, width: int = 3, carry: bool = False) -> DataFrame:
    """Each document with id, fp (long), component_id (smallest id of its component) and ``keep``.

    ``keep`` marks one row of each component. With ``carry`` the row is kept as struct ``row``.
    """
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"), _fingerprints(width)(F.col(f"`{text_col}`").cast("string")).alias("fp"), F.monotonically_increasing_id().alias("at")]
    if carry:
        cols.append(nest(docs).alias("row"))
    printed = shared(docs.select(*cols), "simhash-prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first")
    prints = shared(printed.groupBy("fp").agg(first), "simhash-distinct")
    roots = connected(links(prints.select("fp"), distance))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    found = rooted.join(least, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.at").alias("kept_at"))
    if carry:  # only rows that go away from their component's survivor are joined by position
        stay = found.select(F.col("kept_at").alias("at")).distinct()
        return printed.join(stay, "at", "left_semi").select("id", "fp", F.col("id").alias("component_id"), F.lit(True).alias("keep"), "row")
    return printed.join(found, "fp").select("id", "fp", "component_id", (F.col("at") == F.col("kept_at")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", distance: int = 2, width: int = 3) -> DataFrame:
    """One row of each component of near-duplicates, with the columns of ``docs``."""
    return near_duplicates(docs, text_col, id_col, distance, width, carry=True).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
