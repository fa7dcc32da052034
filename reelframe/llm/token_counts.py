"""Token counts by trie-shared dynamic programming.

A unigram model scores a segmentation of a pre-token (a word with the word-start mark) by the sum of
its pieces' log-probabilities; the best segmentation's length is the pre-token's token count. The
distinct pre-tokens of a batch are inserted in a trie in sorted order, and the forward score of a
prefix is computed once, at its trie node, for all pre-tokens that share it. Only the open branch of
the trie is kept (sorted insertion never returns to a closed one), so memory is bound by the longest
pre-token; terminal counts go to a cache that starts anew when full.

The vocabulary is read from a sentencepiece file, which states merge ranks, no probabilities. So the
pieces' log-probabilities are fitted first: the file's own segmentation of every word of all documents
gives each piece's frequency (one row a piece reaches the driver, whatever the corpus), with ADD for
pieces not met. A character that no piece covers counts as its UTF-8 bytes at a penalty.

Defined results: null text counts 0; texts and words of any length count whole; ties between
segmentations go to the one with fewer tokens; extra columns are ignored, whatever their names;
repeated rows and null identifiers are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Added to the frequency of every piece.
ADD = 0.5
#: Below the least frequent piece, in nats: the score of a character that falls back to bytes.
PENALTY = 10.0
CACHE_WORDS = 400_000
#: Pre-tokens longer than this share no branch; they are scored alone with a rolling window.
LONG = 4096


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Vocabulary trie: node = [children, log-probability or None]."""

    def __init__(self, pieces: dict[str, float]):
        self.root: list = [{}, None]
        for piece, score in pieces.items():
            node = self.root
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = score
        self.unknown = min(pieces.values()) - PENALTY

    def start(self) -> tuple:
        """State of the empty prefix: best score, its token count, open pieces."""
        return 0.0, 0, [(self.root, 0.0, 0)]

    def step(self, state: tuple, c: str) -> tuple:
        """State of the prefix that is one character longer."""
        best, count, opened = state
        top, least, still = None, 0, []
        for node, score, n in opened:
            child = node[0].get(c)
            if child is not None:
                if child[0]:
                    still.append((child, score, n))
                if child[1] is not None:
                    s = score + child[1]
                    if top is None or s > top or (s == top and n + 1 < least):
                        top, least = s, n + 1
        s, n = best + self.unknown, count + len(c.encode("utf-8", "surrogatepass"))
        if top is None or s > top or (s == top and n < least):
            top, least = s, n
        still.append((self.root, top, least))
        return top, least, still

    def counts(self, tokens: list[str]) -> dict[str, int]:
        """Token count of each distinct pre-token, by one walk over their trie."""
        out: dict[str, int] = {}
        branch, open_word = [self.start()], ""
        for token in sorted(tokens):
            if len(token) > LONG:
                state = self.start()
                for c in token:
                    state = self.step(state, c)
                out[token] = state[1]
                continue
            shared, most = 0, min(len(token), len(open_word))
            while shared < most and token[shared] == open_word[shared]:
                shared += 1
            del branch[shared + 1 :]
            for c in token[shared:]:
                branch.append(self.step(branch[-1], c))
            out[token], open_word = branch[-1][1], token
        return out


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Pieces of a vocabulary file that stand for text, with their ids."""
    p = processor(path)
    return {p.id_to_piece(i): i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}


def _piece_counter(path: str):
    """Frequencies of pieces over the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = processor(path)
        totals, words = np.zeros(p.get_piece_size(), np.int64), Counter()

        def add() -> None:
            some = list(words)
            for i in range(0, len(some), 10_000):
                part = some[i : i + 10_000]
                cut = p.encode([w.decode() for w in part], num_threads=1)
                ids = np.fromiter((x for c in cut for x in c), np.int64)
                np.add.at(totals, ids, np.repeat([words[w] for w in part], [len(c) for c in cut]))
            words.clear()

        for batch in batches:
            for t in batch.column(0).cast(pa.large_binary()):
                words.update((t.as_py() or b"").split())
                if len(words) > CACHE_WORDS:
                    add()
        add()
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(totals[met])], names=["piece", "n"])

    return run


def fit_scores(docs: DataFrame, text_col: str = "text", model: str | None = None) -> array:
    """Log-probability of every piece of the vocabulary by id, from its frequency in all documents."""
    path = model or default_model()
    found = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_piece_counter(path), "piece long, n long")
    counts = {r.piece: r.n for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # a row a piece at most
    known = pieces(path)
    total = sum(counts.get(i, 0) for i in known.values()) + ADD * len(known)
    scores = array("d", [0.0]) * processor(path).get_piece_size()
    for i in known.values():
        scores[i] = log((counts.get(i, 0) + ADD) / total)
    return scores


#: Models of this worker by vocabulary file and scores, each with its cache of terminal counts.
_LOADED: dict[tuple[str, str], tuple[Model, dict[bytes, int]]] = {}


def load(path: str, scores: array, key: str | None = None) -> tuple[Model, dict[bytes, int]]:
    """The model of a vocabulary file with the scores of its pieces, and this worker's cache."""
    key = (path, key or hashlib.sha256(scores.tobytes()).hexdigest())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Model({p: scores[i] for p, i in pieces(path).items()}), {}
    return _LOADED[key]


def _groups(texts: list[bytes], most: int = 4_000_000):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def count_texts(texts: list[bytes], model: Model, cache: dict[bytes, int]) -> list[tuple[int, int]]:
    """(pre-tokens, tokens) of each UTF-8 text."""
    out = []
    for part in _groups(texts):
        words = [Counter(t.split()) for t in part]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = {MARK + w.decode(): w for w in set().union(*words) if w not in cache}
        for token, n in model.counts(list(new)).items():
            cache[new[token]] = n
        out += [(c.total(), sum(cache[w] * k for w, k in c.items())) for c in words]
    return out


def counter(path: str, scores: array):
    key = hashlib.sha256(scores.tobytes()).hexdigest()
    fields = [("n_pretokens", pa.int64()), ("n_tokens", pa.int64())]

    @F.arrow_udf(T.StructType().add("n_pretokens", "long").add("n_tokens", "long"))
    def count(text: pa.Array) -> pa.Array:
        raw = [t.as_py() or b"" for t in text.cast(pa.large_binary())]
        return pa.array([dict(zip(("n_pretokens", "n_tokens"), x)) for x in count_texts(raw, *load(path, scores, key))], pa.struct(fields))

    return count


def token_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: str | None = None, scores: array | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every document; ``scores`` of an earlier fit save the pass that fits them."""
    count = counter(model or default_model(), fit_scores(docs, text_col, model) if scores is None else scores)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), count(F.col(f"`{text_col}`").cast("string")).alias("n")).select("doc_id", "n.*")


def query(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
