"""Main text of web pages by tree scoring.

A page is read into a tree of elements and blocks (runs of text between block-level tags). Each
block outside menus, headers, footers, sidebars, notices, adverts, forms, comments and raw elements
passes points for its length and commas to its container, half of them to the next ancestor and
less to those further up; elements start with points for what they are. Points are discounted by
the share of text inside links. The best container, widened to the article or main element around
it, is kept; where there is no such element, with every sibling that is not mostly links. What is
dropped inside is only what the lists below name.

Texts: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by a blank line. A null or empty page has an empty text, as has a
page without text; markup that is not closed or not nested ends where a browser would end it, or
with the page. Pages of any length and depth are read whole, in time in proportion to their
length. Repeated rows are extracted each on its own; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.frames import column, per_batch, rows_of, texts_of

_TAG = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|/?[A-Za-z][^>]*(?:>|\Z))""",
    re.S,
)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in (
    "script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp",
)}
#: one attribute after the other; a value is taken whole, so nothing inside it is read as a name
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: an element of the key ends open elements of the values, up to the next one that holds them
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
DROPPED = frozenset(
    "head script style noscript template nav footer aside button select option textarea input iframe svg math "
    "canvas audio video object embed dialog menu search datalist title noembed noframes xmp".split()
)
#: words of a class, id or role that mark an element to drop, unless it holds the article
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promoted promotion banner "
    "notice notices cookie cookies consent gdpr newsletter subscribe subscription popup modal overlay paywall "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar sidenav rail widget widgets related "
    "recommended recommendations share sharing social masthead topbar footer complementary contentinfo "
    "login signup search toolbar skip".split()
)
#: those of them that also name parts of articles, as in share-price: inside one only as a whole name, or over links
VAGUE = frozenset(
    "share sharing social notice notices related recommended recommendations banner menu search skip widget widgets "
    "rail promotion overlay sponsor header topbar".split()
)
HEADERS = frozenset("header site-header page-header main-header masthead".split())
COMMENTS = frozenset("comment comments commentlist respond replies reply disqus discussion".split())
START = {"article": 30.0, "main": 20.0, "section": 5.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0,
         "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0, "li": -3.0, "th": -5.0}
HEADINGS = frozenset(("h1", "h2"))


class _Page:
    """Elements as parallel lists, parents before children, and blocks in page order."""

    def __init__(self) -> None:
        self.tags, self.parents, self.drop, self.soft = ["#"], [-1], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links

    def add(self, tag: str, parent: int, attributes: str, inside: bool) -> int:
        drop = tag in DROPPED or tag == "header" and not inside
        soft = FORM if tag == "form" else KEPT
        if attributes and not attributes.isspace():
            for name, value in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name not in _READ:
                    continue
                value = value.strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    drop = True
                elif name == "style":
                    drop |= "display:none" in value.replace(" ", "").lower()
                elif tag not in ("html", "body", "main"):
                    soft = max(soft, self._named(tag, value, inside))
        self.tags.append(tag)
        self.parents.append(parent)
        self.drop.append(drop)
        self.soft.append(soft)
        return len(self.tags) - 1


    @staticmethod
    def _named(tag: str, value: str, inside: bool) -> int:
        """What a class, id or role says of its element."""
        words = {w.lower() for w in _WORD.findall(value)}
        if words & COMMENTS and (inside or tag != "article"):
            return OTHERS
        if tag == "article":
            return KEPT
        names = {n.lower() for n in value.split()}
        if not inside:
            return MARK if words & MARKED or names & HEADERS else KEPT
        if words & MARKED - VAGUE or names & MARKED:
            return MARK
        return LINKS if words & VAGUE else KEPT


#: what becomes of an element: kept; dropped if most of its text is links; dropped unless it holds the article
#: or most of the page; the same for a form, which must also hold a paragraph; dropped unless it holds the article
KEPT, LINKS, FORM, MARK, OTHERS = range(5)
PARAGRAPH = 80


def _read(html: str) -> _Page:
    page = _Page()
    stack, open_ = [0], {"#": 1}  # open elements, and how many there are of each tag
    run: list[str] = []
    linked = 0

    def flush(at: int) -> None:
        nonlocal linked
        if run:
            text = "".join(run)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                page.blocks.append((at, text, min(linked, len(text))))
            run.clear()
        linked = 0

    places: list[int] = []  # of the open elements of these kinds in ``stack``

    def holder() -> int:
        """The innermost open element that is a block."""
        return next((stack[k] for k in reversed(places) if page.tags[stack[k]] in BLOCK), 0)

    def innermost(tags) -> int | None:
        return next((k for k in reversed(places) if page.tags[stack[k]] in tags), None)

    def pop() -> None:
        open_[page.tags[stack.pop()]] -= 1
        if places and places[-1] == len(stack):
            places.pop()

    block = at = 0  # block: the element to which text now belongs
    dropped = 0  # open elements that drop their text
    size = len(html)
    while at < size:
        m = _TAG.search(html, at)
        start = m.start() if m else size
        if start > at and not dropped:
            run.append(html[at:start])
            if open_.get("a"):
                linked += start - at
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if not open_.get(tag):
                if tag in ("p", "br") and not dropped:  # a lone </p> or </br> breaks like an empty element
                    if tag == "p":
                        flush(block)
                    else:
                        run.append(" ")
                continue
            if tag in BLOCK or page.drop[stack[-1]]:
                flush(block)
            while True:
                e = stack[-1]
                dropped -= page.drop[e]
                pop()
                if page.tags[e] == tag:
                    break
            block = holder() if tag in BLOCK else block
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and not dropped:
                run.append(" ")
            continue
        if tag in BLOCK:
            flush(block)
            if open_.get("p") and not dropped:
                cut = innermost(BLOCK)
                if cut and page.tags[stack[cut]] == "p":
                    while len(stack) > cut:
                        pop()
            closes, within = ENDS.get(tag, ((), ()))
            if any(open_.get(c) for c in closes):
                above = bisect_right(places, innermost(within) or 0)
                cut = next((k for k in places[above:] if page.tags[stack[k]] in closes), None)
                while cut is not None and len(stack) > cut:
                    dropped -= page.drop[stack[-1]]
                    pop()
        if tag in VOID:
            if tag == "hr":
                block = holder()
            continue
        inside = bool(open_.get("article") or open_.get("main"))
        e = page.add(tag, stack[-1], m[3], inside)
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else size
            continue
        if tag in BLOCK or tag == "select":
            places.append(len(stack))
        stack.append(e)
        open_[tag] = open_.get(tag, 0) + 1
        if page.drop[e]:
            if not dropped and tag not in BLOCK:
                run.append(" ")
            dropped += 1
        if tag in BLOCK:
            block = e
    flush(block)
    return page


def _text(page: _Page) -> str:
    n = len(page.tags)
    parents, tags = page.parents, page.tags
    chars, links, points, holds, long = [0] * n, [0] * n, [0.0] * n, [False] * n, [False] * n
    for e, text, linked in page.blocks:
        chars[e] += len(text)
        links[e] += linked
        long[e] |= len(text) - linked >= PARAGRAPH
    for e in range(n - 1, 0, -1):
        up = parents[e]
        chars[up] += chars[e]
        links[up] += links[e]
        holds[up] |= holds[e] or tags[e] in ("article", "main")
        long[up] |= long[e]
    # words in a class name may lie: an element that holds the article stays, as does one that holds
    # most of the page, unless it is named for comments, which may be longer than the article
    gone = [False] * n
    for e in range(1, n):
        kind, most = page.soft[e], 2 * chars[e] > chars[0]
        stays = kind == KEPT or holds[e] or kind == LINKS and 2 * links[e] < max(1, chars[e])
        stays |= kind == MARK and most or kind == FORM and most and long[e]
        gone[e] = gone[parents[e]] or page.drop[e] or not stays
    blocks = [b for b in page.blocks if not gone[b[0]]]
    if not blocks:
        return ""
    chars, links = [0] * n, [0] * n
    for e, text, linked in blocks:
        chars[e] += len(text)
        links[e] += linked
        worth = text.count(",") + min(len(text) / 100, 3.0) + (1.0 if len(text) >= 25 else 0.1)
        worth *= 1 - linked / len(text)
        up = e if tags[e] not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "pre", "blockquote") else parents[e]
        for level in range(6):
            if up < 0:
                break
            points[up] += worth / (1, 2, 6, 9, 12, 15)[level]
            up = parents[up]
    for e in range(n - 1, 0, -1):
        chars[parents[e]] += chars[e]
        links[parents[e]] += links[e]
    density = lambda e: links[e] / chars[e] if chars[e] else 0.0
    score = lambda e: (points[e] + START.get(tags[e], 0.0)) * (1 - density(e))
    best = max((e for e in range(n) if points[e] > 0 and not gone[e]), key=lambda e: (score(e), -e), default=0)
    for wanted in ("article", "main"):
        up = best
        while up > 0 and tags[up] != wanted:
            up = parents[up]
        if up > 0:
            best = up
            break
    top, kept = score(best), {best}
    for e in range(1, n):
        if parents[e] == parents[best] and e != best and chars[e] and not gone[e] and density(e) < 0.33:
            like = tags[e] == tags[best] and score(e) >= 0.2 * top or tags[e] in HEADINGS
            # without an article element a low score is no sign: short sections and lists are part of it
            if like or tags[best] not in ("article", "main"):
                kept.add(e)
    within = [False] * n
    for e in range(n):
        within[e] = e in kept or e > 0 and within[parents[e]]
    if best and tags[best] not in ("article", "main"):
        # text that stands in the same parent outside any element of it
        return "\n\n".join(t for e, t, k in blocks if within[e] or e == parents[best] and 2 * k < len(t))
    return "\n\n".join(t for e, t, _ in blocks if within[e])


def main_text(html: str) -> str:
    return _text(_read(html)) if html else ""


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, html: str = "html", id_column: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def make():
        def columns(batch):
            texts = [main_text(h) for h in texts_of(batch, "html")]
            return {
                "page_id": rows_of(batch, "page_id"), "url": rows_of(batch, "url"),
                "text": texts, "n_chars": [len(t) for t in texts],
            }
        return columns

    rows = pages.select(
        column(id_column).cast("long").alias("page_id"), column(url).cast("string").alias("url"),
        column(html).alias("html"),
    )
    return rows.mapInArrow(per_batch(make, _SCHEMA), "page_id long, url string, text string, n_chars long")
