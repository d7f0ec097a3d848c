from __future__ import annotations

import html
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import differences
from fixtures import SMALL, prose

from sediment.llm.extraction import OP12_SQL, Lines, extracted, main_text, op12_html_extraction, smoothed

LONG = "goes on for quite a while, and then some more, as the text of articles does"


def between_tags(page: str) -> str:
    """What an article that holds nothing but text says, by plain regular expressions."""
    inside = re.search(r"(?s)<article>(.*?)</article>", page).group(1)
    cut = re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))
    texts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in cut)
    return "\n".join(t for t in texts if t)


def test_table_against_plain_and_sql(spark):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    found = {(r["page_id"], r["url"]): r for r in op12_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == len(pages)
    for p in pages:
        row = found[p["page_id"], p["url"]]
        assert row["text"] == between_tags(p["html"]) and row["n_chars"] == len(row["text"])
    assert differences(spark, op12_html_extraction, OP12_SQL, SMALL) == []


def test_what_is_no_article():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var t = "</p><p>no";</script></head>
    <body class="has-sidebar"><div id="cookie-notice">We use cookies; {LONG}</div><header><h1>Site</h1><form><input><label>Mail</label></form></header>
    <nav><ul><li><a href="/">Home</a><li><a href="/x">About us</a></ul></nav>
    <main><article class="post with-ads"><header><h1>Headline &amp; more</h1></header>
    <p>First {LONG}.<p>Short.<div class="ad-box">Buy now! {LONG}</div><ul><li>one<li>two</ul><p>Last {LONG}: a<b>b</b>&nbsp;c
    d <span class="sponsored">buy</span> e.</p><blockquote>Quoted.</blockquote><div class="share"><a href=x>Share</a></div>
    <section id="comments"><article class="comment"><p>I say: {LONG} {LONG} {LONG}</p></article></section></article>
    <aside><p>Other stories: {LONG}</p></aside></main><footer>Imprint {LONG}</footer></body></html>"""
    assert main_text(page).split("\n") == ["Headline & more", f"First {LONG}.", "Short.", "one", "two", f"Last {LONG}: ab c d e.", "Quoted."]


def test_no_article_element():
    page = f"""<body><div class="top"><a href=1>One</a> <a href=2>Two</a></div><div id=wrap><div class=col><h2>Headline</h2><p>A {LONG}.</p><p>Short.</p><p>B {LONG}.</p><p>C {LONG}.</div>
    <div class=sidebar>{LONG}</div></div><div><a href=3>Three</a> <a href=4>Four</a></div></body>"""
    assert main_text(page).split("\n") == ["Headline", f"A {LONG}.", "Short.", f"B {LONG}.", f"C {LONG}."]


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>one<p>two", "one\ntwo"),
        ("<nav>menu</nav>", ""),
        ("<div class=ad>x<article><p>y</article>", "y"),
        ("<article></article><p>" + LONG, LONG),
        ("<article><p>a<script>no", "a"),
        ("<article><p>1 &lt; 2 &#x41;&#66; &nosuch; &", "1 < 2 AB &nosuch; &"),
        ("<article><!-- <p>no</p> --><p>a<![CDATA[b]]></p></article>", "a"),
        ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "deep"),
        ("</article></div><p>stray", "stray"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
        ("<article><p>a</p></nav></section><p>b</p></article><p>after", "a\nb"),
        (f"<body><a name=top><div><p>{LONG}<p><a href=x>{LONG}<p>{LONG} too</div><ul><li><a href=y>menu</a></ul>", f"{LONG}\n{LONG}\n{LONG} too"),
    ],
)
def test_edges_of_pages(page, text):
    assert main_text(page) == text


def test_long_page():
    words = prose(1, 300_000)
    assert main_text(f"<article><p>{words}</p><p>end</article>") == words + "\nend"


def test_edges_of_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, `a.b` int"
    rows = [(1, "u", "<p>x", "old", "old", 1), (1, "u", "<p>x", "old", "old", 1), (None, None, None, None, None, None)]
    found = extracted(spark.createDataFrame(rows, schema))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]
    assert extracted(spark.createDataFrame([], schema)).collect() == []


def test_smoothing_keeps_means_and_counts_links():
    assert np.allclose(smoothed(np.ones(9)), 1)
    assert len(smoothed(np.zeros(0))) == 0
    even = smoothed(np.array([0.0, 0, 9, 0, 0]))
    assert even[2] == even.max() and np.allclose(even, even[::-1])
    lines = Lines()
    lines.feed("<p>ab <a href=x>cde</a></p><p>f")
    lines.close()
    assert lines.text == ["ab cde", "f"] and lines.linked == [3, 0] and lines.tags == [4, 1]
