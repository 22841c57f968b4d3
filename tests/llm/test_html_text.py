"""Main text of pages: built pages with known text, odd pages, the registered query."""

import html as entities
import re
import time

import pytest

from graphloom.llm.html_text import Events, main_blocks, main_text, smoothed, upper_cluster
from graphloom.llm.queries import QUERIES
from tests.conftest import DATA

LONG = "A paragraph of text that goes on for quite a while, with many words in it and not one link, as articles have them."
PARTS = [f"{LONG} First.", "Short.", f"{LONG} Second &amp; more.", f"{LONG} Third."]
TEXT = [entities.unescape(p) for p in PARTS]
BODY = "".join(f"<p>{p}</p>" for p in PARTS)
MENU = "".join(f'<li><a href="/{w}">{w} page</a></li>' for w in ("home", "news", "about", "contact"))


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><ul>{MENU}</ul></nav><div class=ad>{LONG}</div><article>{BODY}</article><footer>&copy; {LONG}</footer>",
        f"<header><h1>The site</h1></header><main>{BODY}<aside>{LONG}</aside></main><section id=comments><article><p>{LONG}</p></article></section>",
        f"<div class='topmenu'><ul>{MENU}</ul></div><div id=content>{BODY}</div><div id=sidebar><p>{LONG}</p></div><div id=footer>{LONG}</div>",
        f"<div><ul>{MENU}</ul></div><div><div>{BODY}</div></div><div><a href=1>one</a> | <a href=2>two</a></div>",
        f"<form id=aspnetForm><div class='page has-sidebar'><article class=post><header></header>{BODY}<footer>by me</footer></article></div></form>",
        f"<article>{BODY}<section><h2>3 Comments</h2><p>{LONG}</p></section><div class='cookie-notice'>{LONG}<button>OK</button></div></article>",
        f"<body class='has-sidebar'><div role=navigation>{LONG}</div><article>{BODY}<form><p>{LONG}<input></form></article>",
        f"<script>var a='<p>{LONG}</p>'</script><style>p{{}}</style><noscript>{LONG}</noscript><article>{BODY}<!-- <p>{LONG}</p> --></article>",
        f"<article>{BODY.replace('</p>', '')}",
        f"<article>{BODY}</article><div class=related><article><p>{LONG}</p></article></div>",
        f"<p hidden>{LONG}</p><article>{BODY}<p style='display: none'>{LONG}</p></article>",
    ],
)
def test_boilerplate_goes_and_the_text_stays(page):
    assert main_blocks(f"<!DOCTYPE html><html><head><title>A title</title></head><body>{page}</body></html>") == TEXT


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("", []), ("   ", []), ("no tags &lt;at all&gt;", ["no tags <at all>"]), ("<p>a\n b\t&nbsp;c<br>d</p>", ["a b c d"]), ("<nav>x</nav>", []),
        ("<p>a<!-- b", ["a"]), ("<p>a</p><div class='x", ["a"]), ("<p>AT&ampT &#233; &eacute;</p>", ["AT&T é é"]), ("<article><h1>T</h1><p>x <b>y</b><i>z</i>", ["T", "x yz"]),
        ("<div class=menu>all of the page calls itself a menu</div>", ["all of the page calls itself a menu"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ],
)
def test_small_and_broken_pages(page, blocks):
    assert main_blocks(page) == blocks


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<b>" * 50_000 + "<p>x" * 1000, "<article>" * 20_000 + "q", "<!--" * 30_000, "<a" * 30_000, "<li>" * 30_000 + "z", "<p>x</p>" * 20_000, "<div class=ad>" * 20_000 + "x"])
def test_time_grows_with_the_page(page):
    began = time.time()
    main_blocks(page)
    assert time.time() - began < 10


def test_blocks_are_what_stands_between_boundaries():
    lines = Events().read("<div>a <b>b</b><p>c<li>d</div>e")
    assert ["".join(data for _, data in line.parts).strip() for line in lines] == ["a b", "c", "d", "e"]


def test_ratios():
    import numpy as np

    flat = np.full(9, 5.0)
    assert np.allclose(smoothed(flat)[2:-2], 5) and upper_cluster(flat).all()
    assert upper_cluster(np.array([0.1, 0.2, 5.0, 6.0, 0.1])).tolist() == [False, False, True, True, False]


def test_nulls_long_pages_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>{LONG} {i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, None, "old", 7), (1, "", "old", 7), (None, long, None, None), (2, "<p>a", "old", 7)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars long")
    out = {(r.page_id, r.html): (r.text, r.n_chars) for r in main_text(pages).collect()}
    want = "\n\n".join(f"{LONG} {i}" for i in range(20_000))
    assert out == {(1, None): ("", 0), (1, ""): ("", 0), (None, long): (want, len(want)), (2, "<p>a"): ("a", 1)}
    assert main_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_query_is_the_article_of_each_page(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = QUERIES["op12_html_text"](spark, str(DATA)).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = pages[r.page_id].html.partition("<article>")[2].partition("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", inner)
        blocks = [" ".join(entities.unescape(re.sub(r"</?(?:b|br)>", " " if "br" in p else "", p)).split()) for p in parts]
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, "\n\n".join(b for b in blocks if b), len(r.text))
