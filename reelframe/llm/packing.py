"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into pieces of the binary lengths of n, largest first (whole sequences
of ``max_length`` before them). Each piece is a sequence of its own, so none crosses documents and
none is padded; pieces of equal length form a bucket, and sequence ids run gaplessly through the
buckets from the longest to the shortest, so a trainer reads equal lengths side by side.

Where a tokenizer normalises and splits text as FAST says (the default file does), texts are cut in bulk:
it never joins text across white space, and it splits words into runs of letters, digits and marks before
it merges, so a text's ids are those of its pieces in a row (a test holds this against the tokenizer on
whole texts). Distinct words and pieces of many texts are found by Arrow, only pieces not met lately go to
the tokenizer, and ids are laid out by index. Any other tokenizer reads every text whole.

Defined results: null or empty text is one piece, the end token; a text of any length is read whole;
rows with equal or null identifiers are packed one by one; extra columns are ignored by ``pack``,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared

MAX_LENGTH = 2048
END = 1
#: Pieces numbered by one task, and slots whose offsets are summed by one task.
SLOT_PIECES, RANGE = 20_000, 4096
#: Pieces that a task remembers the ids of, in two generations of this size (or of the pieces of one part); longer
#: ones than LONG characters are not remembered.
CACHE, LONG = 100_000, 64
#: Bytes of the texts that are cut at a time (a longer text: itself), and words or pieces whose ids are laid out at a time.
PART_BYTES, LAID = 8_000_000, 100_000

#: Words of these characters split into pieces by the same rules here ('<' may begin a special token);
#: all others go to the tokenizer whole.
_PLAIN = re.compile(r"[\x21-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Most words: letters, then marks or nothing.
_LETTERS = "".join(c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]) if c not in "×÷")
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "<")
_COMMON = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-/:;=-@\[-`{-~]*$"


# The normalisation and splitting of the tokenizer files for which the cache is proven.
FAST = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


@lru_cache(maxsize=2)
def is_fast(path: str) -> bool:
    """Whether ids may come from the cache; special tokens must begin with '<', which sends a word to the tokenizer."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    plain = said["model"].get("type") == "BPE" and not said["model"].get("dropout") and not said.get("truncation") and not said.get("padding")
    return plain and all(said.get(k) == v for k, v in FAST.items()) and all(t["content"].startswith("<") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in said["added_tokens"])


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer of a file, once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Stretches of the texts of about PART_BYTES, or of one longer text."""
    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield texts.slice(a, b - a)


def _laid(ids: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the items ``which`` in a row, and where each begins there (one place more: the end)."""
    begin = np.concatenate([[0], np.cumsum(size[which])])
    out = np.empty(begin[-1], "<u4")
    for i in range(0, len(which), LAID):
        some = which[i : i + LAID]
        a, b = begin[i], begin[i + len(some)]
        out[a:b] = ids[np.repeat(first[some] - begin[i : i + len(some)], size[some]) + np.arange(a, b)]
    return out, begin


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The cache has two generations: what is met in the older one moves to the younger, and a full
    younger one becomes the older, so frequent pieces stay and memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.fast = load(path), is_fast(path)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _split(self, word: str) -> list[str]:
        """Pieces of a word; one that the tokenizer is to read whole comes behind a space, which no piece has."""
        return _PIECE.findall(word.lower()) if _PLAIN.fullmatch(word) else [" " + word] if word else []

    def _piece(self, p: str) -> bytes:
        found = self.old_pieces.get(p)
        if found is None:
            if p.startswith(" "):
                found = self._whole(p[1:])
            else:
                found = array("I", [t.id for t in self.model.tokenize(p if p.isascii() else p.translate(self.bytes))]).tobytes()
        if len(p) <= LONG:
            self.pieces[p] = found
        return found

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, where each word's begin and how many they are."""
        is_common = pc.match_substring_regex(words, _COMMON)
        common = words.filter(is_common)
        others = [self._split(w) for w in words.filter(pc.invert(is_common)).to_pylist()]
        letters, marks = pc.utf8_lower(pc.utf8_rtrim(common, characters=_MARKS)), pc.utf8_ltrim(common, characters=_LETTERS)
        pieces = pa.concat_arrays([letters, marks, pa.array(chain.from_iterable(others), pa.large_string())]).dictionary_encode()
        found = [self.pieces.get(p) or self._piece(p) for p in pieces.dictionary.to_pylist()]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # the pieces of each word in order: letters and marks (maybe empty) of a common one
        number, at = pieces.indices.to_numpy(), is_common.to_numpy(zero_copy_only=False)
        n = np.full(len(words), 2)
        n[~at] = [len(o) for o in others]
        ends = np.cumsum(n)
        order = np.empty(n.sum(), np.int64)
        order[(ends - n)[at]], order[(ends - n)[at] + 1] = number[: len(common)], number[len(common) : 2 * len(common)]
        order[np.repeat(~at, n)] = number[2 * len(common) :]
        ids, begin = _laid(np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, size, order)
        return ids, begin[ends - n], begin[ends] - begin[ends - n]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text; none of a null."""
        if not self.fast:
            for t in texts:
                yield self._whole(t.as_py() or "")
            return
        for part in _parts(texts.cast(pa.large_string())):
            split = pc.ascii_split_whitespace(part)
            words = split.flatten().dictionary_encode()
            ids, begin = _laid(*self._words(words.dictionary), words.indices.to_numpy())
            cuts = begin[np.cumsum([0, *pc.fill_null(pc.list_value_length(split), 0).to_pylist()])].tolist()
            for a, b in zip(cuts, cuts[1:]):
                yield ids[a:b].tobytes()
            if len(self.pieces) > CACHE:
                self.pieces, self.old_pieces = {}, self.pieces

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all(pa.array([text.decode()])))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens, in order."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(max_length.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cutter(path: str, max_length: int, with_ids: bool):
    kind = T.StructType().add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long")
    if with_ids:
        kind = kind.add("ids", "binary")
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.binary())] * with_ids

    @F.arrow_udf(T.ArrayType(kind))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, end = Encoder(path), END.to_bytes(4, "little")  # the cache goes with the task
        for text in batches:
            ends, columns = [0], [[] for _ in fields]
            for ids in encoder.encode_all(text):
                ids, at = ids + end, 0
                total = len(ids) // 4
                for n in piece_lengths(total, max_length):
                    own = ids[4 * at : 4 * (at + n)]
                    for column, value in zip(columns, (at, n, zlib.crc32(own), total, own)):
                        column.append(value)
                    at += n
                ends.append(len(columns[0]))
            values = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields)]
            yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(values, [name for name, _ in fields]))

    return cut


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, max_length: int = MAX_LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``max_length`` is a power of two. A sequence is one piece, so offset is 0.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    cut = _cutter(tokenizer or default_tokenizer(), max_length, with_ids)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), cut(F.col(f"`{text_col}`").cast("string")).alias("pieces"))
    flat = rows.select("doc_id", F.explode_outer("pieces").alias("p")).select("doc_id", "p.*")  # never empty; a plain explode infers a filter that runs the tokenizer twice
    pieces = shared(flat, "pack-pieces")
    # Numbers: hash slots of bounded size, a local rank in each (length, slot), offsets from their counts within
    # a (length, range of slots), and offsets of those: a dozen rows for each RANGE * SLOT_PIECES pieces.
    slots = max(1, -(-pieces.count() // SLOT_PIECES))
    slotted = pieces.withColumn("slot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slots)))
    counts = shared(slotted.groupBy("length", "slot").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("slot") / RANGE)), "pack-counts")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.groupBy("length", "range").agg(F.sum("n").alias("n")).select("length", "range", before(Window.orderBy(F.desc("length"), "range")).alias("first"))
    inner = counts.select("length", "range", "slot", before(Window.partitionBy("length", "range").orderBy("slot")).alias("within"))
    base = inner.join(ranges, ["length", "range"]).select("length", "slot", (F.col("first") + F.col("within")).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "start", "ids_crc32")) - 1
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    numbered = slotted.withColumn("local", local).join(base, ["length", "slot"])
    return numbered.select(*cols, *(["ids"] if with_ids else []))


def query(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False)
