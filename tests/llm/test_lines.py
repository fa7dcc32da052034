"""Near-duplicate lines: keys, their splitting, and whole results against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from reelframe.llm import line_dedup as ld

from . import brute


def two(n):
    return 2 if n >= 4 else 0


def three(n):
    return 3 if n >= 6 else 0


def one(n):
    return 1 if n >= 3 else 0


def test_allowed_edits_grow_with_length():
    assert [ld.allowed(n) for n in (0, 19, 20, 39, 239, 240, 809, 810, 1919, 1920, 30_000)] == [0, 0, 1, 1, 1, 2, 2, 3, 3, 4, 10]


def _edit(rng, x, n, alphabet):
    for _ in range(n):
        p = rng.randrange(len(x) + 1)
        x = rng.choice([x[:p] + rng.choice(alphabet) + x[p:], x[:p] + x[p + 1 :], x[:p] + rng.choice(alphabet) + x[p + 1 :]])
    return x


def _first(x, limit, index):
    """(key, open parts) of a line's first keys; a probe of its own length stands for its index keys too."""
    own, seek = ld.first_cuts(len(x), limit)
    keys = ld.line_keys(x, x.encode(), limit)
    opened = lambda c: [p for p in c[-2:] if p[2]]
    found = [(k, opened(c)) for k, c in zip(keys[0], own)]
    return found if index else found + [(k, opened(c)) for k, c in zip(keys[1], seek)]


def _leaves(x, states, index):
    out, todo = set(), list(states)
    while todo:
        key, parts = todo.pop()
        if parts:
            todo += ld.split_key(x, index, key, parts)
        else:
            out.add(key)
    return out


@pytest.mark.parametrize("limit", [one, two, three])
def test_near_lines_share_a_key_at_every_step(limit):
    rng = random.Random(limit(100))
    for _ in range(250 if limit is three else 500):
        x = "".join(rng.choice("abc") for _ in range(rng.randint(6, 14)))
        y = _edit(rng, x, rng.randint(0, limit(99)), "abcé")
        x, y = sorted((x, y), key=len)
        if x == y or not limit(len(x)) or brute.edit_distance(x, y) > limit(len(x)):
            continue
        a, b = _first(x, limit, True), _first(y, limit, False)
        assert {k for k, _ in a} & {k for k, _ in b}
        for _ in range(3):  # after each split of all keys
            a = [c for k, p in a for c in (ld.split_key(x, True, k, p) if p else [(k, p)])]
            b = [c for k, p in b for c in (ld.split_key(y, False, k, p) if p else [(k, p)])]
            assert {k for k, _ in a} & {k for k, _ in b}, (x, y)
        assert _leaves(x, a, True) & _leaves(y, b, False), (x, y)


@pytest.mark.parametrize("limit", [one, two])
def test_lines_of_a_closed_key_are_near(limit):
    rng = random.Random(7)
    lines = list({"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(60)})
    at = {}
    for x in lines:
        for index in (True, False):
            for k in _leaves(x, _first(x, limit, index), index):
                at.setdefault(k, set()).add(x)
    met = {(x, y) for group in at.values() for x in group for y in group if x < y}
    assert met
    for x, y in met:
        assert brute.edit_distance(x, y) <= limit(min(len(x), len(y)))


def test_an_edit_changes_four_bits_of_a_sketch_at_most():
    rng = random.Random(2)
    for _ in range(2000):
        x = "".join(rng.choice("abcdeé 漢") for _ in range(rng.randint(3, 40)))
        y = _edit(rng, x, 1, "abxé")
        if len(y) > 1:
            p, q = ld.sketches(f"{x}\n  {y} \nz", [(0, len(x)), (len(x) + 3, len(x) + 3 + len(y))])
            assert [p, q] == [*ld.sketches(x, [(0, len(x))]), *ld.sketches(y, [(0, len(y))])]
            assert ((p ^ q) & (1 << 64) - 1).bit_count() <= 4


def _docs(rng, n, size=(8, 16)):
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(*size))) for _ in range(25)]
    line = lambda: _edit(rng, rng.choice(base), rng.randint(0, 3), "zxyé")
    return [(i, "\n".join(rng.choice(["", line(), line()]) for _ in range(rng.randint(0, 7)))) for i in range(n)]


@pytest.mark.parametrize(("limit", "hot"), [(one, 1), (two, 2), (three, 64)])
def test_equal_to_brute_force(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(ld, "HOT", hot)
    data = _docs(random.Random(hot), 60)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: list(r.dropped) for r in ld.duplicate_lines(df, limit=limit).collect()}
    assert got == brute.dropped_lines(data, limit)
    out = {r.doc_id: r.text for r in ld.dedup_lines(df, limit=limit).collect()}
    assert out == {i: "\n".join(x for no, x in enumerate(t.split("\n")) if no not in got[i]) for i, t in data}


def test_crowds_of_templates(spark, monkeypatch):
    """Lines that share nearly all of their text: none is lost, and keys are split rather than paired up."""
    monkeypatch.setattr(ld, "HOT", 8)
    rng = random.Random(3)
    text = "this line stands on every page of the book and says that page {} of {} is shown here, " + "with all that stands on it and around it, as the printer set it long ago; " * 3
    data = [(i, text.format(rng.randint(100, 999), rng.randint(100, 130))) for i in range(120)] + [(1000 + i, f"chapter {rng.randint(10, 99)} of the old book begins") for i in range(80)]
    assert ld.allowed(len(data[0][1])) == 2
    got = {r.doc_id: list(r.dropped) for r in ld.duplicate_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute.dropped_lines(data, ld.allowed)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: list(r.dropped) for r in ld.duplicate_lines(docs).collect()}
    assert got == brute.dropped_lines([(r.doc_id, r.text) for r in docs.collect()], ld.allowed)


def test_short_lines(spark):
    a, b = "a line of thirty-nine characters, yes it", "a line of thirty-nine characters, yes is"
    data = [(1, f"{a[:39]}\n{a[:19]}"), (2, f"{a[:20]}{a[21:39]}\n{a[:18]}!"), (3, "Chapter 1\nChapter 2")]
    got = {r.doc_id: (r.n_near, list(r.dropped)) for r in ld.duplicate_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: (0, []), 2: (1, [0]), 3: (0, [])}


def test_ties_do_not_depend_on_partitions(spark):
    rows = [(None, "a shared line of enough text\nx one"), (None, "a shared line of enough text\nx two"), (5, "a shared line of enough texd\ny"), (5, "a shared line of enough texd\ny"), (5, "a shared line of enough texd\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("own"))
    seen = set()
    for part in (df, df.orderBy(F.desc("text")).repartition(3), df.coalesce(1)):
        out = ld.dedup_lines(part)
        assert out.columns == df.columns
        seen.add(str(sorted(str(r) for r in out.collect())))
    assert len(seen) == 1
