import re
import time
from html import unescape

import pytest

from riskloom.llm.html_extract import extract, main_text

PAGE = """<html><body class="has-sidebar"><div id=wrap class="with-sidebar"><header><h1>Site</h1></header>
<div class="menu">Home <a href=x>About</a></div><div class="content"><h1>Title &amp; co</h1>
<p>First paragraph, with commas, and <a href=x>a link</a>, long enough
   to count here.<p>Second one&nbsp;here, also <i>it</i>alic.<ul><li>One<li>Two</ul><table><tr><td>a<td>b</table></div>
<div class="comments"><p>Great post, I liked it, really, very, much so indeed, you know.</p></div>
<aside>Side, bar, text, many, commas, here.</aside><form><p>Sign, up, now</p></form></div>
<div class="cookie-notice">We use cookies, ok, ok, ok</div><footer>foot</footer></body></html>"""


def article_blocks(html):
    """The article element of the given pages, which hold only these tags."""
    inner = html[html.index("<article>") : html.index("</article>")]
    parts = re.split(r"</?(?:p|h1|article)>", re.sub("</?b>", "", inner.replace("<br>", " ")))
    return "\n\n".join(filter(None, (" ".join(unescape(x).split()) for x in parts)))


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    got = extract(pages).collect()
    assert len(got) == len(source)
    for r in got:
        assert r.text == article_blocks(source[r.page_id].html) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


def test_page_without_article_element():
    assert main_text(PAGE).split("\n\n") == [
        "Title & co", "First paragraph, with commas, and a link, long enough to count here.",
        "Second one here, also italic.", "One", "Two", "a", "b",
    ]


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<script>x = '<p>no</p>'", ""), ("a < b & c <", "a < b & c <"),
    ("<p>a<p>b<div>c</div> d <!-- x > y -->e<style>p{}</style>f", "a\n\nb\n\nc\n\nd ef"),
    ("<article><p>one<br>two</p><footer>f</footer><div class=ad>x</div><form>y</form></article>", "one two"),
    ("<main><article><p>a</p></article></main><nav>n</nav>", "a"),
    ("<article><header><h1>T</h1></header><p>a</p><section class='comments'><p>long, long, long</p></section></article>", "T\n\na"),
    ("<div hidden>x</div><p style='display: none'>y</p><p>z</p>", "z"),
    ("<p title='a > b'>q</p></div></span>", "q"),
    ('<p title="a hidden gem">x</p><p data-hidden="false">y</p><div data-grid="widget"><p>z</p></div>', "x\n\ny\n\nz"),
    ("<p hidden=hidden>a</p><p HIDDEN>b</p><p aria-hidden = 'true'>c</p><p>d</p>", "d"),
    ('<article><p class="share-price">1</p><p class="notice-of-death">2</p><p id="social-studies">3</p></article>', "1\n\n2\n\n3"),
    ('<article><p>1</p><div class="share"><p>no</p></div><div class="ad-slot">no</div><div class="social-links"><a>no</a></div></article>', "1"),
    ('<div><div class="section-header"><h2>H</h2></div><p>text of some length, with commas, to be kept</p></div><div class="site-header">no</div>',
     "H\n\ntext of some length, with commas, to be kept"),
    ("<select><option>a<option>b</select><p>c</p>", "c"),
])
def test_markup(html, text):
    assert main_text(html) == text


def test_article_in_sections_is_kept_whole():
    sections = "".join(f"<section><h2>H{k}</h2><p>Part {k}, with text, and more text to read.</p></section>" for k in range(9))
    got = main_text(f"<body><nav><a href=x>n</a></nav><div class=story>{sections}</div><div id=footer>f</div></body>")
    assert got.count("Part") == 9 and "H8" in got and not got.endswith("f")


@pytest.mark.parametrize("html", [
    "<span>" * 30_000 + "<p>x" * 30_000, "<li>" + "<span>" * 30_000 + "<p>x<hr>" * 30_000, "<p>x</b>" * 50_000, '<a href="' * 50_000, "<div>" * 50_000 + "x", "<!--" * 50_000, "<" * 200_000, "<li>y" * 30_000,
])
def test_hostile_markup_takes_linear_time(html):
    began = time.process_time()
    main_text(html)
    assert time.process_time() - began < 20


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "u", None), (None, None, "<p>a</p>"), (2, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, "u", "")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == ["", "", "a", "a", "a"]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_unequal_sections_and_trailing_lists_without_article():
    long = "".join(f"<p>{k} {'words, ' * 3}{'text ' * 54}</p>" for k in range(8))
    short = f"<section><h2>Second</h2><p>{'short ' * 20}</p></section>"
    got = main_text(f"<body><nav>n</nav><div class=content><section><h2>First</h2>{long}</section>{short}</div><div id=footer>f</div></body>")
    assert got.startswith("First") and "Second" in got and got.endswith("short") and got.count("short") == 20
    got = main_text(f"<body><div class=story>{long}</div><ul><li>one</li><li>two</li></ul><ul><li><a href=x>linked</a></li></ul></body>")
    assert got.endswith("one\n\ntwo")


def test_a_form_round_the_whole_page_is_no_form_to_drop():
    body = "".join(f"<p>Paragraph {k} of the story, with commas, and enough words to be one that people read.</p>" for k in range(5))
    page = f"<body><form action=x><div class=menu>Home</div><div class=story>{body}</div><input value=v><button>Go</button></form></body>"
    assert main_text(page).count("Paragraph") == 5 and "Go" not in main_text(page) and "Home" not in main_text(page)
    assert main_text("<form><p>Name</p><input><p>Password</p><input></form>") == ""
    assert main_text(f"<form><article>{body}</article></form>").count("Paragraph") == 5
    assert "sign" not in main_text(f"<div>{body}</div><form>sign up, now, for a very long newsletter that nobody wants to read, really, at all</form>")


def test_columns_with_clashing_names(spark):
    rows = [(1, "u", "<p>a</p>", "t", 5, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, HTML2 string")
    assert [tuple(r) for r in extract(df).collect()] == [(1, "u", "a", 1)]
