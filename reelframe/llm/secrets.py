"""Secret scan: keyed patterns plus sliding-window Shannon entropy.

Three base patterns give spans of their own. Other candidates are runs of key characters; a window
slides over each run, its entropy kept by incremental counts (one character in, one out), once with
the limits of hexadecimal runs and once with those of base-64 runs; maximal stretches of windows over
the limit become ``entropy`` spans unless an allow-list rule suppresses them. Runs of SHORTEST to
WINDOW characters are one window with a limit by their length. Words that name a placeholder are cut
out of a run; within a found stretch they suppress it. Allow-listing never touches base spans. An
entropy span that overlaps a base span, or one found with the limits of hexadecimal runs, is left out;
base spans of different kinds may overlap one another.

Defined results: null text counts as empty (no spans; digest of the empty string); texts of any
length are scanned whole, in time linear in their length; repeated rows give repeated results; null
identifiers are carried; an empty table gives an empty result; extra columns are ignored by
``scan_secrets`` and carried by ``redact_secrets``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")

_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")

WINDOW = 24
#: Shorter runs, down to this, are one window; their limit falls as the entropy that so many characters can have.
SHORTEST = 16
#: Class: characters of a candidate, least entropy of a window in bits a character.
CLASSES = {"hex": (re.compile(r"[0-9A-Fa-f]{16,}"), 3.0), "base64": (re.compile(r"[A-Za-z0-9+/_=-]{16,}"), 3.8)}
#: A part of an identifier or path that reads like a name: words, numbers, a word with a number.
_NAME = r"(?:[0-9]{1,8}|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[a-z][0-9]{0,4}|[0-9]{1,3}[A-Za-z]{1,2}|[0-9]{1,8}T[0-9]{1,6}Z?)"
#: Candidates that match one of these whole are known not to be secrets.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"[0-9]+",  # numbers
        r"[A-Za-z]+",  # words run together
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
        rf"[_/+=-]*{_NAME}(?:[_/+=-]+{_NAME})*[_/+=-]*",  # identifiers and paths of names alone
    )
)
_PLACEHOLDER = re.compile(r"(?i:example|sample|placeholder|dummy|xxxx)")
_PART = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z]+|[A-Z]+)(?![A-Za-z0-9])")
_PLOGP = [0.0] + [i * log2(i) for i in range(1, WINDOW + 1)]


def entropy_stretches(run: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal stretches of ``run`` whose windows all reach the entropy, by incremental counts."""
    table = _PLOGP if window == WINDOW else [0.0] + [i * log2(i) for i in range(1, window + 1)]
    counts: dict[str, int] = {}
    weight, out = 0.0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        weight += table[n + 1] - table[n]
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            weight += table[n - 1] - table[n]
        if i >= window - 1 and log2(window) - weight / window >= least - 1e-9:
            a = i - window + 1
            if out and a <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([a, i + 1])
    return [(a, b) for a, b in out]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX_RUN.finditer(text)]  # greedy runs: the same as dropping shorter ones
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _pieces(run: str) -> list[tuple[int, int]]:
    """``run`` without the words of it that name a placeholder, which say nothing of a key beside them."""
    if not _PLACEHOLDER.search(run):
        return [(0, len(run))]
    out, at = [], 0
    for m in _PART.finditer(run):
        if _PLACEHOLDER.search(m[0]):
            out.append((at, m.start()))
            at = m.end()
    return [*out, (at, len(run))]


def _stretches(run: str, least: float) -> list[tuple[int, int]]:
    out = []
    for a, b in _pieces(run):
        piece = run[a:b].strip("_/=+-") if (a, b) != (0, len(run)) else run
        a = run.index(piece, a)
        if len(piece) < SHORTEST or any(p.fullmatch(piece) for p in ALLOW) or not (any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece)):
            continue
        window = min(WINDOW, len(piece))
        found = entropy_stretches(piece, least * log2(window) / log2(WINDOW), window)
        out += [(a + x, a + y) for x, y in found if not _PLACEHOLDER.search(piece, x, y)]
    return out


class _Cover:
    """Union of spans; tells in a bisection whether another one overlaps it."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b


def entropy_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Entropy spans that overlap no base span, nor one found with the limits of an earlier class."""
    out: list[tuple[int, int]] = []
    for name, (pattern, least) in CLASSES.items():
        cover = _Cover([(a, b) for a, b, _ in taken] + out)
        for m in pattern.finditer(text):
            if name == "hex" and m.end() - m.start() < WINDOW and (text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum()):
                continue  # a few letters of a longer run
            found = [(m.start() + a, m.start() + b) for a, b in _stretches(m[0], least)]
            out += [span for span in found if not cover.meets(*span)]
    return [(a, b, "entropy") for a, b in out]


def _show(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_text(text: str) -> dict:
    base = base_spans(text)
    every = sorted(base + entropy_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2])))
    n = {k: sum(s[2] == k for s in base) for k in KINDS[:3]}
    return {f"n_{k}": v for k, v in n.items()} | {"base_sha256": hashlib.sha256(_show(base).encode()).hexdigest(), "spans": _show(every)}


_FIELDS = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]


@F.arrow_udf(T.StructType().add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("base_sha256", "string").add("spans", "string"))
def _scan(text: pa.Array) -> pa.Array:
    return pa.array([scan_text(t.as_py() or "") for t in text], pa.struct(_FIELDS))


@F.arrow_udf(T.StringType())
def _redact(text: pa.Array) -> pa.Array:
    out = []
    for t in text:
        t = t.as_py()
        if t:
            base, parts, end = base_spans(t), [], len(t)
            for a, b, k in sorted(base + entropy_spans(t, base), reverse=True):
                b = min(b, end)  # base kinds may overlap one another
                if a < b:
                    parts += [t[b:end], f"[{k}]"]
                    end = a
            t = "".join([t[:end], *reversed(parts)])
        out.append(t)
    return pa.array(out, pa.string())


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    found = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _scan(F.col(f"`{text_col}`").cast("string")).alias("found"))
    return found.select("doc_id", "found.*")


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets."""
    return docs.withColumn(text_col, _redact(F.col(f"`{text_col}`").cast("string")))


def query(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs)
