"""Whole spans of the secret scan against a plain version; linear time; short keys; odd rows."""

import random
import re
import time
from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from reelframe.llm import secrets

from . import brute

HEX, WIDE = "0123456789abcdefABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
PLACEHOLDER = re.compile("example|sample|placeholder|dummy|xxxx", re.I)


def _runs(text, chars):
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in chars:
            end += 1
        if end - at >= 16:
            yield at, end
        at = max(end, at + 1)


def _named(piece):
    """Whether a piece is a number, a word, a UUID or names alone."""
    if piece.isdigit() or piece.isalpha() or re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", piece):
        return True
    name = [r"[0-9]{1,8}", r"[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*[0-9]{0,4}", r"[A-Z]+[0-9]{0,4}", r"[a-z][0-9]{0,4}", r"[0-9]{1,3}[A-Za-z]{1,2}", r"[0-9]{1,8}T[0-9]{1,6}Z?"]
    return all(any(re.fullmatch(n, part) for n in name) for part in re.split(r"[_/+=-]+", piece.strip("_/+=-")))


def plain_spans(text):
    """All spans: base ones by the plain patterns, then windows counted anew at every place."""
    base = [tuple(s.split(":")) for s in brute.base_secrets(text)["spans"]]
    base = [(int(a), int(b), k) for k, a, b in base]
    taken, out = [(a, b) for a, b, _ in base], list(base)
    for chars, least in ((HEX, 3.0), (WIDE, 3.8)):
        new = []
        for a, b in _runs(text, chars):
            if chars == HEX and b - a < 24 and (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()):
                continue
            run, cuts = text[a:b], [0]
            if PLACEHOLDER.search(run):
                for m in re.finditer(r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z]+|[A-Z]+)(?![A-Za-z0-9])", run):
                    if PLACEHOLDER.search(m[0]):
                        cuts += [m.start(), m.end()]
            cuts.append(len(run))
            for x, y in zip(cuts[::2], cuts[1::2]):
                if len(cuts) > 2 or PLACEHOLDER.search(run):
                    while x < y and run[x] in "_/=+-":
                        x += 1
                    while y > x and run[y - 1] in "_/=+-":
                        y -= 1
                piece = run[x:y]
                if len(piece) < 16 or _named(piece) or not any(c.isdigit() for c in piece) or not any(c.isalpha() for c in piece):
                    continue
                w = min(24, len(piece))
                hit = set()
                for i in range(len(piece) - w + 1):
                    n = Counter(piece[i : i + w])
                    if -sum(c / w * log2(c / w) for c in n.values()) >= least * log2(w) / log2(24) - 1e-9:
                        hit |= set(range(i, i + w))
                ends = sorted(hit)
                stretches = [(i, next(j for j in range(i, len(piece) + 1) if j not in hit)) for i in ends if i - 1 not in hit]
                new += [(a + x + i, a + x + j) for i, j in stretches if not PLACEHOLDER.search(piece[i:j])]
        new = [(i, j) for i, j in new if not any(p < j and i < q for p, q in taken)]
        out += [(i, j, "entropy") for i, j in new]
        taken += new
    order = ("assign", "access", "hex", "entropy")
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(out, key=lambda s: (s[0], order.index(s[2]))))


def _part(rng):
    n = rng.randint(10, 60)
    kind = rng.randrange(9)
    if kind == 0:
        return "".join(rng.choice(WIDE) for _ in range(n))
    if kind == 1:
        return "".join(rng.choice(HEX[:16]) for _ in range(n))
    if kind == 2:
        return rng.choice(["token: ", "API_KEY=", 'secret" : "']) + "".join(rng.choice(WIDE) for _ in range(n))
    if kind == 3:
        return "AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(n))
    if kind == 4:
        return "/".join(rng.choice(["usr", "share", "python3", "Doc12", "2024", "x1", "QDS"]) for _ in range(n // 4))
    if kind == 5:
        return rng.choice(["example", "SAMPLE_", "my-dummy-", "xxxx"]) + "".join(rng.choice(WIDE) for _ in range(n))
    if kind == 6:
        return "123e4567-e89b-12d3-a456-426614174000"
    if kind == 7:
        return "".join(rng.choice("ab1") for _ in range(n))
    return "a few plain words, é and 漢"


def test_spans_equal_the_plain_version():
    rng = random.Random(21)
    for _ in range(400):
        text = "".join(_part(rng) + rng.choice([" ", "\n", ".", "", "-"]) for _ in range(rng.randint(1, 8)))
        assert secrets.scan_text(text)["spans"] == plain_spans(text), text


def test_spans_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in secrets.query(docs).collect():
        assert r.spans == plain_spans(text[r.doc_id] or "")


def test_short_keys_have_windows():
    rng = random.Random(5)
    for n in (16, 18, 20, 21, 22, 23):
        keys = ["".join(rng.choice(WIDE[:62]) for _ in range(n)) for _ in range(300)]
        keys = [k for k in keys if any(c.isdigit() for c in k)]
        assert sum("entropy" in secrets.scan_text(f"so {k} it is")["spans"] for k in keys) >= 0.97 * len(keys), n


@pytest.mark.parametrize("unit", ["q7Zk2LmX9vRt4WbN8sYpQhDf ", "q7Zk2LmX9vRt4WbN8sYpQhDfJcGe/", "token=abcdefgh1 ", "abcdefghijklmnop", "ab/cd_", "AKIA", "0123456789abcdef"])
def test_time_is_linear(unit):
    def took(n):
        start = time.process_time()
        secrets.scan_text(unit * (n // len(unit)) + "!1A")
        return time.process_time() - start

    took(1000)
    assert took(800_000) < 12 * took(200_000) + 0.5


def test_ten_megabytes_take_seconds():
    text = "q7Zk2LmX9vRt4WbN8sYpQhDf token=abcdefgh1 some words stand here, " * 160_000
    start = time.process_time()
    found = secrets.scan_text(text)
    assert found["n_assign"] == 160_000 and found["spans"].count("entropy") == 160_000 and time.process_time() - start < 60


def test_odd_rows_and_redaction(spark):
    data = [(None, None), (1, ""), (2, "token=abcdefgh1 and q7Zk2LmX9vRt4WbN8sYpQhDf."), (2, "token=abcdefgh1 and q7Zk2LmX9vRt4WbN8sYpQhDf.")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("found", "spans", "n_hex", "base")})
    got = secrets.scan_secrets(df).collect()
    assert [r.spans for r in got if r.doc_id != 2] == ["", ""] and len({r for r in got if r.doc_id == 2}) == 1 and len(got) == 4
    out = secrets.redact_secrets(df)
    assert out.columns == df.columns and [r.text for r in out.collect()] == [None, "", *["[assign] and [entropy]."] * 2]
    assert secrets.scan_secrets(df.where("false")).count() == 0
