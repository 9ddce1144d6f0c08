"""Main text against a plain reading of the article element over the test pages, and by example."""

import html
import os
import re
import time

import pytest

from colloquy.llm.main_text import extract, main_text

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(page):
    """Blocks of the one article element, cut at the tags that the test pages use for blocks."""
    inner = re.sub(r"(?s)^.*?<article>|</article>.*$", "", page)
    inner = re.sub(r"<[^>]*$", "", inner)
    blocks = re.split(r"</?(?:p|h1)>", inner)
    words = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if False else "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(w for w in words if w)


def test_pages_equal_a_plain_reading(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html", "url").collect()
    for p in pages:
        assert main_text(p["html"]) == plain(p["html"]), p["page_id"]


FRAME = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) x("</p>")</script><style>p{{}}</style></head>
<body class="with-sidebar"><header><h2>Site name</h2><a href=/>home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, and tell you so at some length in this notice here.</div>
{body}
<aside><p>Side matter with quite some words that are not part of the article at all, really.</p></aside>
<form action=x><label>Name</label><input name=n><p>Write to us with whatever you like to say.</p></form>
<section id="comments"><h3>Comments</h3><article class="comment"><p>First! A very long reader comment, so long that it is
longer than the article itself, on and on, with many words and many more words after them, without any end in sight.</p></article></section>
<div class="ad banner">Buy now</div><footer><p>&copy; all rights</p></footer></body></html>"""

WANT = "Title here\nFirst paragraph with a link inside & more.\nSecond one,\ntoo short.\nItem one\nItem two\nThe end of it."


@pytest.mark.parametrize(
    "body",
    [
        "<article><header><h1>Title here</h1></header><p>First paragraph with a <a href=z>link</a> inside &amp; more.<p>Second one,"
        "<div>too short.</div><ul><li>Item one<li>Item two</ul><p>The   end\n of it.<!-- no --></article>",
        "<main><h1>Title here</h1><p>First paragraph with a <b>link</b> inside &#38; more.</p><p>Second one,</p><p>too short.</p>"
        "<div class='share-buttons'><a href=f>Share</a></div><ol><li>Item one</li><li>Item two</li></ol><p>The<br>end of it.</p></main>",
        "<div id=content><h1>Title here</h1><div class=text><p>First paragraph with a link inside &amp; more.</p><p>Second one,</p>"
        "<p>too short.</p><p>Item one</p><p>Item two</p><p>The end of <script>no()</script>it.</p></div></div>",
    ],
)
def test_page_furniture_goes(body):
    assert main_text(FRAME.format(body=body)) == WANT


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("a < b &lt; c", "a < b < c"),
        ("<p>one<p>two &eacute;&nbsp;x", "one\ntwo é x"),
        ("<head><title>t</title><p>no body tag", "no body tag"),
        ("<html><body><p>cut off &am", "cut off &am"),
        ("<p>cut off</p><p class='x", "cut off"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p hidden>no</p><p>yes</p><p style='display: none'>no</p>", "yes"),
        ("<p>x</b></i> y</p></div>", "x y"),
        ("<script>only", ""),
        ("<p>1 > 0</p>", "1 > 0"),
    ],
)
def test_broken_and_small_pages(page, text):
    assert main_text(page) == text


def test_long_and_deep_pages_take_linear_time():
    began = time.perf_counter()
    assert main_text("<p>word " * 100_000).count("\n") == 99_999
    assert main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    main_text("<a b='" * 50_000)
    main_text("<" * 100_000)
    main_text("<article><p>a</article>" * 3_000)
    assert time.perf_counter() - began < 60


def test_tables(spark):
    rows = [(1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (None, None, None, "y"), (3, "v", "", "z")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, text STRING")
    got = sorted(tuple(r) for r in extract(pages.where("page_id IS NOT NULL"), "page_id", "url").collect())
    assert got == [(1, "u", "a"), (1, "u", "a"), (3, "v", "")]
    assert extract(pages, "page_id", "url").count() == 4
    assert extract(pages.limit(0), "page_id", "url").count() == 0
