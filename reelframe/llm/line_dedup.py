"""Line deduplication by a segment-partition edit join.

Two lines are near if their edit distance is at most what ``allowed`` grants the shorter one: nothing
below LEAST characters, 1 from there, and t from 30 t^3 characters on (240, 810, 1920, ...), so that the
keys of a line stay in proportion to its length. A line is cut into one segment more than it is allowed
edits. The least number k for which the first k + 1 segments hold at most k edits marks a segment that
stands unchanged in the other line, with k edits before it and the rest behind. So each line indexes its
segments (by length, number and content) and probes the substrings that a line of its own or a smaller
length could have had as segments, at places that leave the right lengths on both sides. Pairs that meet
are told apart by sketches (parities of their counts of neighbouring characters, of which an edit
changes four at most) and verified by banded bit-parallel edit distance. Linked lines form classes (transitively); a class
keeps its first line by (doc_id, line number), all others go.

Equal lines are one line to the join. A key that more than HOT lines index is not paired up but split:
the unmatched part of greatest length, with its share of the edits, is cut into segments again, and its
key grows by one of them, until keys are rare or all that differs is as short as the edits granted for
it; lines that share such a key are all near one another, and a star links them. Each such step keeps
every near pair together under some key, at every distance.

Lines are compared without white space at their ends; blank lines are no lines.

Defined results: null text has no lines; null identifiers come last in the order; rows with equal
identifiers are documents of their own, in the order of their texts' hashes; lines and texts of any
length are compared whole; an empty table gives an empty result; extra columns are ignored or carried,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, join_small, may_be_in, nest, shared
from .components import connected

#: Shorter lines match exactly only: an edit is more than a twentieth of them.
LEAST, UNIT = 20, 30
#: Keys that more lines index than this are split.
HOT = 64
_TRIM = " \t\r\x0b\x0c"
#: Second hash of a line: chained to a constant as ``xxhash64(constant, line)`` does.
_SALT = "line"
_SALT_SEED = xxhash.xxh64_intdigest(_SALT.encode(), 42)
_MASK = (1 << 64) - 1


def allowed(length: int) -> int:
    """Edits allowed between lines of which the shorter has ``length`` characters."""
    if length < LEAST:
        return 0
    t = 1
    while UNIT * (t + 1) ** 3 <= length:
        t += 1
    return t


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the ``edits + 1`` nearly equal segments of a line."""
    n = edits + 1
    short, longer = length // n, length % n
    out, at = [], 0
    for i in range(n):
        size = short + (i >= n - longer)
        out.append((at, size))
        at += size
    return out


#: Part of a line that is not matched yet: start, end, edits granted, length of its counterpart in the indexed line.
Part = tuple[int, int, int, int]


def cuts(part: Part, index: bool) -> list[tuple[int, int, int, Part, Part]]:
    """(segment, start, end, part before, part behind) of the substrings of a part that may be segments of its counterpart."""
    start, end, edits, length = part
    out = []
    for k, (p, size) in enumerate(segments(length, edits)):
        for d in (0,) if index else range(-k, k + 1):
            q = start + p + d
            behind = length - p - size
            if start <= q and q + size <= end and abs(end - q - size - behind) <= edits - k:
                out.append((k, q, q + size, (start, q, k, p), (q + size, end, edits - k, behind)))
    return out


@lru_cache(maxsize=8192)
def first_cuts(length: int, limit: Callable[[int], int]) -> tuple[list, list]:
    """Cuts of a line as index and as probe, with the indexed length before each.

    For its own length the unshifted segments are left out of the probes: those are its index keys.
    """
    own = [(length, *c) for c in cuts((0, length, limit(length), length), True)]
    seek = []
    for other in range(max(length - limit(length), 1), length + 1):
        if length - other <= limit(other) > 0:
            seek += [(other, *c) for c in cuts((0, length, limit(other), other), False)]
    unshifted = set(own)
    return own, [c for c in seek if c not in unshifted]


@lru_cache(maxsize=8192)
def _first_places(length: int, limit: Callable[[int], int]) -> tuple[list, list]:
    return tuple([(m * 4096 + k, a, b) for m, k, a, b, *_ in cuts_] for cuts_ in first_cuts(length, limit))


def line_keys(line: str, raw: bytes, limit: Callable[[int], int]) -> tuple[list[int], list[int]]:
    """Index and probe keys of a line: hashes of (length, segment, content)."""
    h = xxhash.xxh64_intdigest
    cut = (lambda a, b: raw[a:b]) if len(raw) == len(line) else (lambda a, b: line[a:b].encode())
    return tuple([_signed(h(cut(a, b), seed)) for seed, a, b in places] for places in _first_places(len(line), limit))


def split_key(line: str, index: bool, key: int, parts: list[Part]) -> list[tuple[int, list[Part]]]:
    """Longer keys that stand for ``key``, with the parts they leave open; near lines share one of them.

    A part whose counterpart is no longer than its edits is closed where it is as short itself (all such
    are near). Else it holds an unchanged character: the first one costs as many edits as the longer side
    has characters before it.
    """
    i = max(range(len(parts)), key=lambda j: parts[j][3])
    start, end, edits, length = parts[i]
    before, behind, out = parts[:i], parts[i + 1 :], []

    def grown(what: str, a: int, b: int) -> int:
        return xxhash.xxh64_intdigest(f"{what}:{line[a:b]}".encode(), key & _MASK)

    def emit(new: int, left: list[Part]) -> None:
        for a, b, n, m in left:
            if not n:  # no edits left: equal, or not near
                if b - a != m:
                    return
                new = xxhash.xxh64_intdigest(line[a:b].encode(), new)
        out.append((_signed(new), [*before, *(p for p in left if p[2]), *behind]))

    if length > edits:
        for k, a, b, left, right in cuts(parts[i], index):
            emit(grown(f"s{k}", a, b), [left, right])
        return out
    if index or end - start <= edits:
        emit(grown("closed", 0, 0), [])
    if index:
        for x in range(length):
            for cost in range(x, edits + 1):
                emit(grown(f"c{x}.{cost}", start + x, start + x + 1), [(start + x + 1, end, edits - cost, length - x - 1)])
    elif end - start > edits:
        for x in range(length):
            for y in range(end - start):
                cost = max(x, y)
                if cost <= edits and abs((end - start - y - 1) - (length - x - 1)) <= edits - cost:
                    emit(grown(f"c{x}.{cost}", start + y, start + y + 1), [(start + y + 1, end, edits - cost, length - x - 1)])
    return out


def within(x: str, y: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: bit-parallel columns on the band around the diagonal."""
    if abs(len(x) - len(y)) > most:
        return False
    a, n = 0, min(len(x), len(y))
    while a < n and x[a] == y[a]:
        a += 1
    b = 0
    while b < n - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    if not x or not y:
        return len(x) + len(y) <= most
    # Bits are diagonals: bit d of reach[e] says that diagonal d - most is reached in the current row with e edits.
    width = 2 * most + 1
    full = (1 << width) - 1
    reach = [0] * (most + 1)
    for e in range(most + 1):
        for d in range(most, most + e + 1):  # row 0: column j = d - most by insertions
            if d - most <= len(y):
                reach[e] |= 1 << d
    for i, c in enumerate(x):
        same = fit = 0
        for d in range(width):
            j = i + d - most  # column before this step, on diagonal d
            if 0 <= j < len(y):
                fit |= 1 << d
                if y[j] == c:
                    same |= 1 << d
        here = sum(1 << d for d in range(width) if 0 <= i + 1 + d - most <= len(y))
        old, new = reach, [0] * (most + 1)
        for e in range(most + 1):
            r = old[e] & same
            if e:
                r |= old[e - 1] & fit  # substitution
                r |= old[e - 1] >> 1  # deletion: next row, same column
                r |= new[e - 1] << 1  # insertion: this row, next column
            new[e] = r & full & here
        reach = new
        if not reach[most]:
            return False
    return bool(reach[most] >> (len(y) - len(x) + most) & 1)


def sketches(text: str, places: list[tuple[int, int]]) -> list[int]:
    """Parities of the counts of character pairs, hashed to 64 bits, of the stretches of a text (two characters or more)."""
    if not places:
        return []
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    pairs = (c[:-1] * np.uint32(0x9E3779B1) ^ c[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(26)
    ends = np.array([(a, b - 1) for a, b in places], np.int64).ravel()
    bits = np.append(np.left_shift(np.uint64(1), pairs.astype(np.uint64)), np.uint64(0))
    return np.bitwise_xor.reduceat(bits, ends)[::2].view(np.int64).tolist()


_KEYS = [("own", pa.list_(pa.int64())), ("seek", pa.list_(pa.int64()))]
_LINE = pa.struct([("no", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sketch", pa.int64()), ("edits", pa.int32()), *_KEYS])


def _splitter(limit: Callable[[int], int]):
    keys = T.ArrayType(T.LongType())
    kind = T.StructType().add("no", "long").add("a", "long").add("b", "long").add("sketch", "long").add("edits", "integer").add("own", keys).add("seek", keys)

    @F.arrow_udf(T.ArrayType(kind))
    def split(text: pa.Array) -> pa.Array:
        out, h = [], xxhash.xxh64_intdigest
        for t in text:
            found, near, places, at = [], [], [], 0
            text = t.as_py() or ""
            for no, part in enumerate(text.split("\n")):
                line = part.strip(_TRIM)
                if line:
                    raw, edits = line.encode(), limit(len(line))
                    own, seek = line_keys(line, raw, limit) if edits else ([], [])
                    found.append({"no": no, "a": _signed(h(raw, 42)), "b": _signed(h(raw, _SALT_SEED)), "sketch": 0, "edits": edits, "own": own, "seek": seek})
                    if edits:
                        start = at + len(part) - len(part.lstrip(_TRIM))
                        near.append(found[-1])
                        places.append((start, start + len(line)))
                at += len(part) + 1
            for x, sketch in zip(near, sketches(text, places)):
                x["sketch"] = sketch
            out.append(found)
        return pa.array(out, pa.list_(_LINE))

    return split


def _verifier(limit: Callable[[int], int]):
    @F.arrow_udf(T.BooleanType())
    def verified(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist())
        return pa.array([within(a, b, limit(min(len(a), len(b)))) for a, b in pairs], pa.bool_())

    return verified


def _opener(limit: Callable[[int], int]):
    """Parts that a first key leaves open, by its place among the line's keys."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def opened(line: pa.Array, index: pa.Array, place: pa.Array) -> pa.Array:
        out = []
        for x, i, at in zip(line.to_pylist(), index.to_pylist(), place.to_pylist()):
            left, right = first_cuts(len(x), limit)[0 if i else 1][at][-2:]
            out.append([n for p in (left, right) if p[2] for n in p])
        return pa.array(out, pa.list_(pa.int64()))

    return opened


@F.arrow_udf(T.ArrayType(T.StructType().add("key", "long").add("parts", T.ArrayType(T.LongType()))))
def _split_keys(line: pa.Array, index: pa.Array, key: pa.Array, parts: pa.Array) -> pa.Array:
    out = []
    for x, i, k, p in zip(line.to_pylist(), index.to_pylist(), key.to_pylist(), parts.to_pylist()):
        found = split_key(x, i, k, [tuple(p[j : j + 4]) for j in range(0, len(p), 4)])
        out.append([{"key": n, "parts": [v for q in left for v in q]} for n, left in found])
    return pa.array(out, pa.list_(pa.struct([("key", pa.int64()), ("parts", pa.list_(pa.int64()))])))


def _crowded(index: DataFrame) -> tuple[DataFrame, int]:
    """Keys (key) that more than HOT lines index, and their number."""
    hot = shared(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), "line-crowded")
    return hot, hot.count()


def _meet(index: DataFrame, probe: DataFrame) -> DataFrame:
    """Pairs (x, y) of lines of which one indexes a key that the other probes, and whose sketches may be of near lines."""
    index = index.select("key", F.col("lid").alias("x"), F.col("sketch").alias("p"), "edits")
    pairs = index.join(probe.select("key", F.col("lid").alias("y"), F.col("sketch").alias("q")), "key")
    pairs = pairs.where((F.col("x") != F.col("y")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= 4 * F.col("edits")))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _resolve(crowd: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Pairs that connect near lines among (lid, sketch, edits, index, key, parts) of crowded keys, by splitting the keys."""
    found = None
    add = lambda pairs: pairs if found is None else found.unionByName(pairs)
    while not crowd.isEmpty():
        rows = crowd.join(texts, "lid").select("lid", "sketch", "edits", "index", F.explode(_split_keys("line", "index", "key", "parts")).alias("c"))
        rows = rows.select("lid", "sketch", "edits", "index", "c.key", "c.parts")
        rows = shared(rows.distinct(), "line-split")
        hot, n = _crowded(rows.where("index"))
        few = join_small(rows, hot, "key", "left_anti", n)
        found = add(shared(_meet(few.where("index"), few.where("not index")).distinct(), "line-split-pairs"))
        if not n:
            free(rows)
            break
        many = shared(join_small(rows, hot, "key", "left_semi", n), "line-split-crowd")
        free(rows, hot)
        alike = many.where(F.size("parts") == 0)  # nothing is open: all near one another
        least = alike.groupBy("key").agg(F.min("lid").alias("x"))
        found = add(alike.join(least, "key").where("x < lid").select("x", F.col("lid").alias("y")).distinct())
        crowd = many.where(F.size("parts") > 0)
    return found


def line_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: Callable[[int], int] = allowed, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, lines): documents with id, at[, row]; lines with at, no, lid, first_at, first_no, near.

    (first_at, first_no) is the line its class keeps; ``near`` says that it is another text.
    """
    text = F.col(f"`{text_col}`").cast("string")
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("at"), _splitter(limit)(text).alias("lines")]
    split = shared(docs.select(*cols, *([nest(docs).alias("row")] if carry else [])), "line-docs")
    flat = split.select("id", "hash", "at", F.explode("lines").alias("l"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "at", F.col("l.no").alias("no"), *[F.col(f"l.{c}").alias(c) for c in ("sketch", "edits", "own", "seek")])
    uniq = flat.groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.min(rank).alias("first"))
    uniq = shared(uniq.withColumn("lid", F.monotonically_increasing_id()), "line-distinct")

    own = uniq.select("lid", "first.sketch", "first.edits", F.posexplode("first.own").alias("place", "key"))
    seek = uniq.select("lid", "first.sketch", "first.edits", F.posexplode("first.seek").alias("place", "key"))
    hot, n_hot = _crowded(own)
    rare = lambda keys: join_small(keys, hot, "key", "left_anti", n_hot) if n_hot else keys
    index = rare(own).select("key", "lid", "sketch", "edits")
    pairs = shared(_meet(index, rare(seek).select("key", "lid", "sketch").unionByName(index.drop("edits"))).distinct(), "line-pairs")
    wanted = pairs.select(F.col("x").alias("lid")).unionByName(pairs.select(F.col("y").alias("lid")))
    if n_hot:
        crowded = [join_small(keys, hot, "key", "left_semi", n_hot).withColumn("index", F.lit(i)) for keys, i in ((own, True), (seek, False))]
        crowd = shared(crowded[0].unionByName(crowded[1]), "line-crowd")
        wanted = wanted.unionByName(crowd.select("lid"))

    # Texts of the lines concerned, from the documents, found by both hashes.
    wanted = shared(wanted.distinct().join(uniq.select("lid", "a", "b"), "lid"), "line-wanted")
    line = F.explode(F.split(F.coalesce(text, F.lit("")), "\n"))
    texts = docs.select(line.alias("line")).select(F.btrim("line", F.lit(_TRIM)).alias("line")).where("line <> ''").select("line", F.xxhash64("line").alias("a"))
    texts = may_be_in(texts, wanted, "a").withColumn("b", F.xxhash64(F.lit(_SALT), "line")).join(wanted, ["a", "b"]).groupBy("lid").agg(F.min("line").alias("line"))
    texts = shared(texts, "line-texts")

    if n_hot:
        opened = crowd.join(texts, "lid").withColumn("parts", _opener(limit)("line", "index", "place")).select("lid", "sketch", "edits", "index", "key", "parts")
        # lines of equal length meet as index and probe of the same key
        opened = shared(opened.unionByName(opened.where("index").withColumn("index", F.lit(False))), "line-open")
        more = _resolve(opened, texts)
        pairs = pairs if more is None else pairs.unionByName(more).distinct()
    both = pairs.join(texts.select(F.col("lid").alias("x"), F.col("line").alias("p")), "x").join(texts.select(F.col("lid").alias("y"), F.col("line").alias("q")), "y")
    edges = both.where(_verifier(limit)("p", "q")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = connected(edges)
    place = F.struct("first.none", "first.id", "first.hash", "first.at", "first.no")
    rooted = uniq.select("a", "b", "lid", place.alias("own")).join(roots.withColumnRenamed("node", "lid"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    lead = rooted.where("root <> lid").select("root").distinct()  # classes of more than one text
    least_of = rooted.join(lead, "root", "left_semi").groupBy("root").agg(F.min("own").alias("kept"))
    classes = rooted.join(least_of, "root", "left").select("a", "b", "lid", "root", "own", F.coalesce("kept", "own").alias("kept"))
    lines = flat.select("at", "l.no", "l.a", "l.b").join(classes, ["a", "b"])
    return split, lines.select("at", "no", "root", F.col("kept.at").alias("first_at"), F.col("kept.no").alias("first_no"), (F.col("kept") != F.col("own")).alias("near"))


def duplicate_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: Callable[[int], int] = allowed, carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_lines (with text), n_dropped, n_near and ``dropped``, the numbers of dropped lines."""
    split, lines = line_classes(docs, text_col, id_col, limit, carry)
    drop = lines.where("at <> first_at or no <> first_no")
    found = drop.groupBy("at").agg(F.array_sort(F.collect_list("no")).alias("dropped"), F.sum(F.col("near").cast("long")).alias("n_near"))
    out = split.select("id", "at", F.size("lines").cast("long").alias("n_lines"), *(["row"] if carry else [])).join(found, "at", "left")
    none = F.array().cast("array<bigint>")
    dropped = F.coalesce("dropped", none)
    cols = [F.col("id").alias("doc_id"), "n_lines", F.size(dropped).cast("long").alias("n_dropped"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), dropped.alias("dropped")]
    return out.select(*cols, *(["row"] if carry else []))


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the duplicate lines of their texts."""
    found = duplicate_lines(docs, text_col, id_col, carry=True, **options)
    kept = F.filter(F.split(F.col(f"row.`{text_col}`"), "\n"), lambda x, i: ~F.array_contains(F.col("dropped"), i.cast("long")))
    cols = [F.array_join(kept, "\n").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*cols)


def query(docs: DataFrame) -> DataFrame:
    return duplicate_lines(docs).select("doc_id", "n_lines", "n_dropped", "n_near", F.array_join("dropped", ",").alias("dropped"))
