"""Plain Python versions of the corpus operators, written apart from them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def simhash(text: str | None) -> int:
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges) -> dict:
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash_components(docs) -> dict:
    """{doc_id: (fingerprint, component)}"""
    prints = {i: simhash(t) for i, t in docs}
    of = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    return {i: (f"{p:016x}", of[i]) for i, p in prints.items()}


def pieces(ids: list[int]) -> list[tuple]:
    """(start, length, crc) of the power-of-two pieces."""
    out, at = [], 0
    while at < len(ids):
        n = 2048
        while n > len(ids) - at:
            n //= 2
        out.append((at, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + n]))))
        at += n
    return out


def edit_distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def common(a: str, b: str, edits: int) -> bool:
    """Cheap bound: each edit changes at most two counts of characters."""
    x, y = Counter(a), Counter(b)
    return sum(((x - y) + (y - x)).values()) <= 2 * edits


def dropped_lines(docs, limit) -> dict:
    """{doc_id: dropped line numbers} for unique doc ids."""
    where = defaultdict(list)
    for i, t in sorted(docs):
        for no, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                where[line.strip(" \t\r\x0b\x0c")].append((i, no))
    long, pairs = sorted((x for x in where if limit(len(x))), key=len), []
    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            if len(b) - len(a) > limit(len(a)):
                break
            if common(a, b, limit(len(a))) and edit_distance(a, b) <= limit(len(a)):
                pairs.append((a, b))
    of = roots(where, pairs)
    first = {}
    for line, places in where.items():
        first[of[line]] = min([first.get(of[line], places[0]), *places])
    out = {i: [] for i, _ in docs}
    for line, places in where.items():
        for i, no in places:
            if (i, no) != first[of[line]]:
                out[i].append(no)
    return {i: sorted(x) for i, x in out.items()}


def viterbi(token: str, pieces: dict[str, float], unknown: float) -> int:
    """Tokens of the best segmentation; of equally good ones the fewest."""
    best = [(0.0, 0)]
    for j in range(1, len(token) + 1):
        found = [(best[j - 1][0] + unknown, -(best[j - 1][1] + len(token[j - 1].encode())))]
        for i in range(max(0, j - 64), j):
            if token[i:j] in pieces:
                found.append((best[i][0] + pieces[token[i:j]], -(best[i][1] + 1)))
        s, n = max(found)
        best.append((s, -n))
    return best[-1][1]


def base_secrets(text: str) -> dict:
    spans = []
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for kind, pattern, group, least in (("assign", assign, 2, 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)):
        spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    order = {"assign": 0, "access": 1, "hex": 2}
    shown = [f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], order[s[1]]))]
    n = Counter(k for _, k, _ in spans)
    return {"n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "base_sha256": hashlib.sha256(",".join(shown).encode()).hexdigest(), "spans": shown}
