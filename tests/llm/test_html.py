"""Main text of pages: marked and unmarked ones, odd rows, windows against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from reelframe.llm import html_text

STORY = ["The first line of the story says what happened and where it did.", "A second line goes on to say who was there, and why they came.", "The last long line tells how it ended for all of them."]
BODY = "".join(f"<p>{x}</p>" for x in STORY)
TEXT = "\n".join(STORY)


@pytest.mark.parametrize("tag", ["article", "div", "section"])
@pytest.mark.parametrize("wrapper", ["has-sidebar", "no-sidebar", "with-menu", "has-share", "legal", "layout has-sidebar", "single comments-open", "sidebar-left", "newsletter", "withMenu"])
def test_no_wrapper_empties_the_page(tag, wrapper):
    page = f"<body><nav><a href=/>Home</a></nav><div class='{wrapper}'><{tag}><h1>Head</h1>{BODY}</{tag}></div><footer>All rights reserved by us, the owners.</footer></body>"
    assert html_text.main_text(page) == f"Head\n{TEXT}"


@pytest.mark.parametrize("name", ["cookieBanner", "commentSection", "adBox", "ad", "side-bar sidebar", "relatedPosts", "newsletter-signup"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_named_regions_are_left_out(tag, name):
    region = f"<div class='{name}'><p>This stands beside the text and is long enough to be one, if it were not named.</p></div>"
    assert html_text.main_text(f"<{tag}><h1>Head</h1>{BODY}</{tag}>{region}") == f"Head\n{TEXT}"
    assert html_text.main_text(f"{region}<{tag}><h1>Head</h1>{BODY}</{tag}>") == f"Head\n{TEXT}"
    assert html_text.main_text(f"<{tag}>{BODY[: len(STORY[0]) + 7]}{region}{BODY[len(STORY[0]) + 7 :]}</{tag}>") == TEXT


def test_comments_in_articles():
    comments = "".join(f'<article class="comment"><p>I disagree with line {i}, and say at length why that is so.</p></article>' for i in range(9))
    for tag in ("article", "div"):
        assert html_text.main_text(f"<{tag}>{BODY}</{tag}>{comments}") == TEXT
        assert html_text.main_text(f"<{tag}>{BODY}</{tag}><section id=comments><p>{'They say this. ' * 90}</p></section>") == TEXT
    assert html_text.main_text(f"<div class=discussion>{BODY}</div>") == TEXT  # nothing else is text


def test_teaser_cards_do_not_replace_the_text():
    cards = "".join(f"<article class=card><h3><a href=/{i}>Another story of ours</a></h3><p>Short teaser.</p></article>" for i in range(3))
    assert html_text.main_text(f"<div>{BODY}</div>{cards}") == TEXT
    assert html_text.main_text(f"<main>{BODY}</main><div>{cards}</div>") == TEXT


def test_short_last_paragraph_after_a_menu():
    for tag in ("article", "div", "body"):
        for between in ("<nav><a href=/a>One</a><a href=/b>Two</a></nav>" * 3, "<div class=ad>Buy</div><ul><li><a href=/>A</a><li><a href=/>B</a><li><a href=/>C</a></ul>"):
            assert html_text.main_text(f"<{tag}>{BODY}{between}<p>The end.</p></{tag}>").endswith("\nThe end.")
    # beside the text's own element it is a notice
    assert html_text.main_text(f"<div>{BODY}</div><table><tr><td><a href=/>A</a><td><a href=/>B</a><td><a href=/>C</a></table><div>Imprint</div><span>All is well.</span>") == TEXT


def test_unmarked_pages_are_cut_at_surge_and_dive():
    """No tag or class says anything: densities of lines alone decide."""
    menu = "".join(f"<div>{w}</div>" for w in ("Home", "News", "Sport", "Weather", "Login"))
    links = "".join(f"<div><a href=/{i}>One of many stories that you may like to read</a></div>" for i in range(5))
    assert html_text.main_text(f"<body>{menu}<div>We use cookies here.</div>{menu}<section>{BODY}</section>{links}{menu}<div>Imprint</div></body>") == TEXT
    two = f"<section>{BODY}</section>{links}<section><h2>More</h2>{BODY}</section>"
    assert html_text.main_text(f"{menu}{two}{menu}") == f"{TEXT}\nMore\n{TEXT}"


def test_brute_force_stretches():
    rng = random.Random(4)
    for _ in range(400):
        w = [rng.choice([0, 0, 0, 5, 40, 90]) for _ in range(rng.randint(0, 25))]
        begins = {i for i in range(len(w)) if rng.random() < 0.1}
        window = rng.randint(1, 4)
        part = [sum(b <= i for b in begins) for i in range(len(w))]
        summed = [sum(w[j] for j in range(max(0, i - window + 1), i + 1) if part[j] == part[i]) for i in range(len(w))]
        # lines that weigh belong together if no window sum between them is nothing
        groups = []
        for i, x in enumerate(w):
            if x:
                if groups and part[groups[-1][-1]] == part[i] and all(summed[j] for j in range(groups[-1][-1], i)):
                    groups[-1].append(i)
                else:
                    groups.append([i])
        want = [(g[0], g[-1] + 1, sum(w[i] for i in g), max(summed[i] for i in range(g[0], g[-1] + 1))) for g in groups]
        got = [tuple(s) for s in html_text.surges(w, window, begins)]
        assert [g[:3] for g in got] == [x[:3] for x in want] and all(a[3] >= b[3] for a, b in zip(got, want))


@pytest.mark.parametrize("unit", ["<a ", "<svg>x", "<b>", "</b>", "<div><p>", "<div class=ad>", '<a title="x>', "<!--", "<script", "<li><b>", "&amp"])
def test_reading_is_linear(unit):
    def took(n):
        start = time.process_time()
        html_text.main_text(unit * n + '"')
        return time.process_time() - start

    took(100)
    assert took(80_000) < 12 * took(20_000) + 0.5


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, html_text string"
    data = [(1, "u", None, "t", "c", "x"), (2, None, "", "t", "c", "x"), (2, None, "", "t", "c", "x"), (None, "v", f"<p>{STORY[0]}</p>", "t", "c", "x"), (4, "w", "<article>" + "<p>A long page is read whole.</p>" * 60_000, None, None, "x"), (5, "z", "<nav>a</nav><br><", "t", "c", "x")]
    df = spark.createDataFrame(data, schema)
    got = {(r.page_id, r.url): r for r in html_text.query(df).collect()}
    assert [(got[k].text, got[k].n_chars) for k in ((1, "u"), (2, None))] == [("", 0)] * 2 and html_text.query(df).count() == 6
    assert got[None, "v"].text == STORY[0] and got[4, "w"].text.count("\n") == 59_999 and got[4, "w"].n_chars == len(got[4, "w"].text)
    assert html_text.query(df.where("false")).count() == 0
    kept = html_text.extract_text(df.withColumn("extracted", F.lit("own")), into="found")
    assert kept.columns == ["page_id", "url", "text", "n_chars", "html_text", "extracted", "found"] and {r.extracted for r in kept.collect()} == {"own"}
    with pytest.raises(ValueError, match="already"):
        html_text.extract_text(df.withColumn("extracted", F.lit("own")))
