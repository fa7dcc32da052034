"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block element; character references are decoded afterwards. A line
weighs its characters outside links; mostly linked lines and short ones that end no sentence weigh
nothing. Weights are summed over sliding windows of lines: where a sum rises from nothing a surge
begins, where it returns to nothing it dives, and the lines between the two points are a stretch. A
level-one heading, and the border of a marked article, begin a stretch of their own. On every page,
marked or not, the text is made of stretches, with the headings before them:

* a stretch whose sums reach SURGE and that has more than one line of weight, a heading or LONE
  characters (a lone shorter line is a notice);
* a lesser stretch with most of its weight in the elements that hold the text of those (same parent,
  same tag), such as a short last paragraph behind an advert;
* where there is none, the heaviest stretch.

Marks weigh lines, they choose none. Menus, headers, footers, sidebars, notices, adverts, forms and
comments weigh nothing, so they separate stretches, and are no part of them. Elements and roles say
so for certain. Class and id words do not: such a word is ignored where the element holds a marked
article or most of the heaviest stretch, and nothing outside of such elements is a marked article or
comes near; a comment word only where nothing else on the page is text. Where the heaviest stretch lies in a marked article
(``article``, ``main``, an article body), short lines there weigh too, every stretch there is text,
and lines outside any such mark weigh a quarter.

Defined results: null html counts as empty and gives an empty text, as does a page of markup alone;
an empty table gives an empty result; unclosed or broken markup is read as browsers do for block
elements, no deeper than DEPTH; pages of any length are read whole, in time linear in their length;
repeated rows are extracted one by one; other columns are carried, whatever their names (a column of
the name asked for the result is an error).
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
#: Characters in a window that make a surge, of a line that ends no sentence, and of a stretch of one line.
SURGE, SHORT, LONE = 80, 25, 200
#: Open elements that are told apart, as in browsers; deeper ones belong to the last of them.
DEPTH = 512

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text.
_RAW = frozenset("script style noscript template svg iframe object canvas textarea select option button head title math audio video".split())
#: Elements that are no main text wherever they stand.
_OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note".split())
#: Parts of class and id words: no main text, comments, and parts that only say how something else looks.
_OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar "
    "sidebar sidebars widget widgets aside related recommended recommendation recommendations share sharing social notice notices cookie cookies consent gdpr alert popup modal newsletter "
    "subscribe subscription signup login search form pagination pager toolbar copyright legal disclaimer skiplink".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus discussion".split())
_LOOK_WORDS = frozenset("has no not with without is hide show open closed enabled disabled below above after before".split())
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article-?body|post-?content|entry-?content|article-?content|article-?text|post-?body|story-?body|main-?content|page-?content|article|content-?body)(?=$|\s)", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

_OPEN = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
_TAG_END = re.compile(r"[\"'>]")
_ATTR = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SENTENCE = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*\Z")
#: An opening tag of the key closes an open element of these names (of the same list or table).
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _said(attrs: dict[str, str], words: frozenset[str]) -> bool:
    """Whether a class or id word has a part among ``words`` and none that only says how something looks."""
    for key in ("class", "id"):
        for word in attrs.get(key, "").split():
            parts = {p.lower() for p in _PART.findall(word)}
            if parts & words and not parts & _LOOK_WORDS:
                return True
    return False


class Line(NamedTuple):
    text: str
    hard: bool  #: in an element that is no main text for certain
    soft: tuple[int, ...]  #: elements around it with a word for no main text
    comment: tuple[int, ...]  #: elements around it with a word for comments
    main: tuple[int, ...]  #: marked articles around it
    links: int  #: characters in links
    heading: int  #: level, 0 for none
    spot: tuple[int, str]  #: parent of its block, tag of its block


class _State(NamedTuple):
    name: str
    no: int
    hard: bool = False
    soft: tuple[int, ...] = ()
    comment: tuple[int, ...] = ()
    main: tuple[int, ...] = ()
    link: bool = False
    heading: int = 0
    spot: tuple[int, str] = (0, "")
    block: int = 0  #: number of the innermost block


class _Page:
    """Places in a page; what was once sought in vain is not sought again, so reading stays linear."""

    def __init__(self, page: str):
        self.page, self.missing, self.low = page, set(), None

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Place behind the tag that is open at ``at``: its first > outside quotes. An unclosed quote is a character."""
        while m := _TAG_END.search(self.page, at):
            if m[0] == ">":
                return m.end()
            close = self.find(m[0], m.end())
            at = close + 1 if close >= 0 else m.end()
        return len(self.page)

    def end_of(self, name: str, at: int) -> int:
        """Place behind the end tag of ``name``, -1 if there is none."""
        if self.low is None:
            self.low = _Page(self.page.translate(_LOWER))
        start = self.low.find(f"</{name}", at)
        if start < 0:
            return -1
        close = self.find(">", start)
        return close + 1 if close >= 0 else len(self.page)


_LOWER = {c: c + 32 for c in range(65, 91)}


def lines(page: str) -> list[Line]:
    """Lines in page order."""
    out: list[Line] = []
    stack: list[_State] = []
    opened: Counter[str] = Counter()
    parts: list[tuple[str, bool]] = []
    outer = here = _State("", 0)
    src, number = _Page(page), 0

    def end_line() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(p for p, _ in parts)).split())
            linked = " ".join(_html.unescape("".join(p for p, a in parts if a)).split()) if any(a for _, a in parts) else ""
            parts.clear()
            if text:
                out.append(Line(text, here.hard, here.soft, here.comment, here.main, len(linked), here.heading, here.spot))

    def close(depth: int) -> None:
        nonlocal here
        if any(e.name in _BLOCK for e in stack[depth:]):
            end_line()
        opened.subtract(e.name for e in stack[depth:])
        del stack[depth:]
        here = stack[-1] if stack else outer

    at, size = 0, len(page)
    while at < size:
        start = src.find("<", at)
        if start < 0:
            parts.append((page[at:], here.link))
            break
        if start > at:
            parts.append((page[at:start], here.link))
        if page.startswith("<!--", start):
            end = src.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith("<![CDATA[", start):
            end = src.find("]]>", start)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith(("<!", "<?"), start):
            end = src.find(">", start)
            at = end + 1 if end >= 0 else size
            continue
        m = _OPEN.match(page, start + 1)
        if not m:
            parts.append(("<", here.link))
            at = start + 1
            continue
        name, at = m[2].lower(), src.tag_end(m.end())
        if m[1]:  # closing tag
            if opened[name] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        close(i)
                        break
                    if name not in _BLOCK and stack[i].name in _BLOCK:  # an inline end tag closes no block
                        break
            elif name in _BLOCK:
                end_line()
            continue
        given = page[m.end() : at]
        if name in _RAW:
            if name in _BLOCK:
                end_line()
            if not given.rstrip("> \t\r\n").endswith("/"):
                stop = src.end_of(name, at)
                if stop >= 0:
                    at = stop
                elif name in ("script", "style", "textarea", "title"):  # never closed: to the end of the page
                    break
            continue
        if name == "br":
            parts.append((" ", here.link))
            continue
        if name in _VOID:
            if name in _BLOCK:
                end_line()
            continue
        if name in _BLOCK:
            end_line()
            if opened["p"] > 0:
                for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends where a block begins
                    if stack[i].name == "p":
                        close(i)
                        break
                    if stack[i].name in _BLOCK:
                        break
            if name in _CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in _CLOSES[name]:
                        close(i)
                        break
                    if stack[i].name in ("ul", "ol", "dl", "table", "select", "tbody", "thead", "tfoot"):
                        break
        if len(stack) >= DEPTH:
            continue
        attrs = {a[0].lower(): _html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(given)} if given != ">" else {}
        number += 1
        role = attrs.get("role", "").lower()
        marks = name in ("article", "main") or role in ("main", "article") or attrs.get("itemprop") == "articleBody"
        marks = marks or bool(_MAIN_NAMES.search(attrs.get("class", "")) or _MAIN_NAMES.search(attrs.get("id", "")))
        hard = name in _OUTSIDE or (name == "header" and not here.main) or role in _OUTSIDE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
        plain = name in ("html", "body", "main") or name in _HEADINGS
        comment = not plain and _said(attrs, _COMMENT_WORDS)
        soft = not plain and name != "article" and _said(attrs, _OUTSIDE_WORDS)
        here = _State(
            name, number, here.hard or hard, here.soft + (number,) * soft, here.comment + (number,) * comment,
            here.main + (number,) * (marks and not comment), here.link or name == "a", int(name[1]) if name in _HEADINGS else here.heading,
            (here.block, name) if name in _BLOCK else here.spot, number if name in _BLOCK else here.block,
        )
        stack.append(here)
        opened[name] += 1
    end_line()
    return out


def weight(line: Line, short: bool) -> int:
    """Characters outside links; none of mostly linked lines nor, unless ``short`` ones count, of short ones that end no sentence."""
    if 2 * line.links > len(line.text) or not (short or len(line.text) >= SHORT or _SENTENCE.search(line.text)):
        return 0
    return len(line.text) - line.links


class Stretch(NamedTuple):
    start: int
    end: int
    total: int
    peak: int  #: greatest window sum


def surges(weights: list[int], window: int = WINDOW, begins: frozenset[int] | set[int] = frozenset()) -> list[Stretch]:
    """Stretches of lines from a surge of the window sums to the dive, without lines that weigh nothing at their ends.

    A window sum covers a line and the ``window - 1`` lines before it; it dives where a whole window has
    no weight, so that shorter gaps are bridged. At the lines ``begins`` the sums start anew.
    """
    out: list[Stretch] = []
    start, last, total, peak, sums, since = None, 0, 0, 0, 0, 0
    for i, w in enumerate(weights):
        if i in begins:
            if start is not None:
                out.append(Stretch(start, last + 1, total, peak))
                start = None
            sums, since = 0, i
        sums += w - (weights[i - window] if i - window >= since else 0)
        if start is None and w:
            start, total, peak = i, 0, 0
        if start is not None:
            total, peak = total + w, max(peak, sums)
            if w:
                last = i
            if not sums:
                out.append(Stretch(start, last + 1, total, peak))
                start = None
    if start is not None:
        out.append(Stretch(start, last + 1, total, peak))
    return out


def _heaviest(stretches: list[Stretch]) -> Stretch | None:
    return max(stretches, key=lambda s: s.total, default=None)


def _together(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether one of two nests of marked articles lies within the other; outside of all is a place of its own."""
    n = min(len(a), len(b))
    return a[:n] == b[:n] and bool(a) == bool(b)


def _shares(found: list[Line], weights: list[int], kind: str, part: Stretch | None = None) -> Counter[int]:
    """Weight in each element of a kind, over all lines or a stretch of them."""
    held: Counter[int] = Counter()
    for i in range(*((part.start, part.end) if part else (0, len(found)))):
        for e in getattr(found[i], kind):
            held[e] += weights[i]
    return held


def excluded(found: list[Line], window: int = WINDOW) -> list[bool]:
    """Which lines are no main text by marks, after the words that the weights gainsay are ignored."""
    dense = [0 if x.hard else weight(x, bool(x.main)) for x in found]
    clear = [0 if x.comment else w for x, w in zip(found, dense)]
    ignored: set[int] = set()
    top = _heaviest(surges(clear, window))
    if not (top and top.peak >= SURGE) and not any(w and x.main for x, w in zip(found, clear)):
        most = _heaviest(surges(dense, window))  # nothing is text but what a comment word names
        if most and most.peak >= SURGE:
            ignored |= {e for e, n in _shares(found, dense, "comment", most).items() if 2 * n > most.total}
    comment = [not ignored.issuperset(x.comment) for x in found]
    clear = [0 if c else w for c, w in zip(comment, dense)]
    top = _heaviest(surges(clear, window))
    bare = any(w and x.main and not x.soft for x, w in zip(found, clear))  # an article is marked outside of such elements
    if top and not bare and any(x.soft for x in found):
        rest = _heaviest(surges([0 if x.soft else w for x, w in zip(found, clear)], window))
        if not rest or 3 * rest.total < top.total:
            ignored |= {e for e, n in _shares(found, clear, "soft", top).items() if 2 * n > top.total}
        marked: Counter[int] = Counter()  # weight of marked articles within an element with such a word
        for x, w in zip(found, clear):
            for e in x.soft:
                if x.main and x.main[-1] > e:
                    marked[e] += w
        ignored |= {e for e, n in marked.items() if n and 2 * n > max(marked.values())}
    return [x.hard or c or not ignored.issuperset(x.soft) for x, c in zip(found, comment)]


def main_text(page: str, window: int = WINDOW) -> str:
    """The text of a page, its lines joined by newlines."""
    found = lines(page)
    out = excluded(found, window)
    begins = {i for i, x in enumerate(found) if (x.heading == 1 and not (i and found[i - 1].heading == 1)) or (i and not _together(x.main, found[i - 1].main))}
    weights = [0 if o else weight(x, bool(x.main)) for x, o in zip(found, out)]
    stretches = surges(weights, window, begins)
    top, article = _heaviest(stretches), ()
    if top:
        held: Counter[tuple[int, ...]] = Counter()
        for i in range(top.start, top.end):
            held[found[i].main] += weights[i]
        article = held.most_common(1)[0][0]
    if article:
        weights = [w if x.main else w // 4 for x, w in zip(found, weights)]
    else:
        weights = [0 if o else weight(x, False) for x, o in zip(found, out)]
    stretches = surges(weights, window, begins)
    if not stretches:  # nothing but links and short lines: a text of one or two such
        weights = [len(x.text) if not o and 2 * x.links <= len(x.text) else 0 for x, o in zip(found, out)]
        stretches = surges(weights, window, begins)

    headed, end = [], 0
    for s in stretches:
        first = s.start
        while first > end and first not in begins and not out[first - 1] and found[first - 1].heading and 2 * found[first - 1].links <= len(found[first - 1].text):
            first -= 1
        several = sum(w > 0 for w in weights[s.start : s.end]) > 1 or first < s.start or found[s.start].heading
        headed.append((s, first, s.peak >= SURGE and (several or s.total >= LONE)))
        end = s.end
    chosen = {i for i, (s, _, strong) in enumerate(headed) if strong or (article and any(w and x.main and _together(x.main, article) for x, w in zip(found[s.start : s.end], weights[s.start : s.end])))}
    if not chosen and headed:
        chosen = {max(range(len(headed)), key=lambda i: headed[i][0].total)}
    spots: Counter[tuple[int, str]] = Counter()
    for i in chosen:
        for j in range(headed[i][0].start, headed[i][0].end):
            spots[found[j].spot] += weights[j]
    whole = spots.total()
    homes = {k for k, n in spots.items() if 4 * n >= whole}
    for i, (s, _, _) in enumerate(headed):  # lesser stretches in the elements that hold the text
        if i not in chosen and 2 * sum(w for x, w in zip(found[s.start : s.end], weights[s.start : s.end]) if x.spot in homes) > s.total:
            chosen.add(i)
    return "\n".join(x.text for i in sorted(chosen) for x, o in zip(found[headed[i][1] : headed[i][0].end], out[headed[i][1] : headed[i][0].end]) if not o)


_FIELDS = [("text", pa.string()), ("n_chars", pa.int64())]


@F.arrow_udf(T.StructType().add("text", "string").add("n_chars", "long"))
def _extract(pages: pa.Array) -> pa.Array:
    texts = [main_text(p.as_py() or "") for p in pages]
    return pa.array([{"text": t, "n_chars": len(t)} for t in texts], pa.struct(_FIELDS))


def extract_text(pages: DataFrame, html_col: str = "html", into: str = "extracted") -> DataFrame:
    """``pages`` with a struct column ``into`` (text, n_chars) in place of the html."""
    if into != html_col and into in pages.columns:
        raise ValueError(f"the table has a column {into!r} already; name another")
    rest = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    return pages.select(*rest, _extract(F.col(f"`{html_col}`").cast("string")).alias(into))


def query(pages: DataFrame) -> DataFrame:
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "extracted.text", "extracted.n_chars")
