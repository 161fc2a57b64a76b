import html as entities
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import html_text as h

SF = "/root/testdata/sf0.001"
PROSE = "This is a long paragraph of the article that has many words and hardly any tags in it at all. " * 3
MENU = "<nav><ul>" + "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(12)) + "</ul></nav>"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style>{head}</head><body>{body}</body></html>"


CASES = [
    ("", ""), ("<", "<"), ("plain text", "plain text"), ("<p>", ""), ("<!-- only -->", ""), ("<script>var a = '<p>x</p>'", ""),
    (page(MENU + "<article><h1>Head</h1><p>One&nbsp;&amp; two</p><p>Er.</p></article>"), "Head One & two Er."),
    (page("<article><p><b>Open bold.<br><p>Next <i>it</i>al</p>" + "</article>"), "Open bold. Next ital"),
    (page(f"<article><p>{PROSE}</p><div class='ad'>Buy</div><p>Short.</p></article>"), f"{PROSE}Short."),
    (page(f"<header><h1>Site</h1></header><main><p>{PROSE}</p><aside>Side</aside><p>End</p></main><footer>F</footer>"), f"{PROSE}End"),
    (page(f"{MENU}<div id='content'><p>{PROSE}</p><p>Hm.</p><p>{PROSE}</p></div>"
          f"<div class='comments'><p>{PROSE}</p></div><div class='cookie-notice'>We use cookies</div>"), f"{PROSE}Hm. {PROSE}"),
    (page(f"<form><p>{PROSE}</p><input value=x><select><option>a</select></form><article>a\n\n b\t c</article>"), "a b c"),
    (page("<article><header><h2>Title</h2><p class='share'>Share</p></header><p>Text</p></article>"), "Title Text"),
    (page("<article><ul><li>one<li>two</ul><table><tr><td>3<td>4</table>&#x35; &copy; &zzz; &lt;b&gt;</article>"),
     "one two 3 4 5 © &zzz; <b>"),
    (page("<article><p>cut off &am"), "cut off &am"),
    (page("<article>a</b></p></div>b</article></section>c"), "a b"),
    (page('<article class="post sidebar-left"><p>kept</p></article>'), "kept"),
]


@pytest.mark.parametrize("page_, text", CASES)
def test_cases(page_, text):
    assert h.main_text(page_) == " ".join(text.split())


WRAPPERS = ["class='has-sidebar'", "class='no-sidebar'", "class='with-nav'", "class='content widget'", "id='page-no-menu'"]


@pytest.mark.parametrize("name", WRAPPERS)
def test_layout_wrappers(name):
    article = f"<article><header><h2>Head</h2></header><p>{PROSE}</p><p>Short.</p></article>"
    comments = f"<div class='comments'>{f'<article>{PROSE}</article>' * 5}</div><div class='sidebar'>{MENU}Side</div>"
    whole = f"Head {PROSE}Short."
    for tag in ("div", "section"):
        assert h.main_text(page(f"<{tag} {name}>{article}{comments}</{tag}>{comments.replace('article', 'div')}")) == whole
    assert h.main_text(page(f"<div {name}><div {name}>{article}</div>{comments.replace('article', 'div')}</div>")) == whole
    assert h.main_text(page(f"<div {name}><p>{PROSE}</p><p>{PROSE}</p></div><div class='ad'>Buy</div>")) == f"{PROSE}{PROSE}".strip()
    assert h.main_text(page(f"<main><div {name}><p>{PROSE}</p></div><p>End</p></main>")) == f"{PROSE}End"
    assert h.main_text(page(f"<article><p>One <span {name}>mark</span> two {PROSE}</p></article>")) == f"One two {PROSE}".strip()
    parts = "".join(f"<div {name}><p>{k} {PROSE}</p></div>" for k in range(4))
    assert h.main_text(page(parts)) == "".join(f"{k} {PROSE}" for k in range(4)).strip()


ARTICLE = f"<article><h1>Head</h1><p>{PROSE}</p><p>Short.</p></article>"
TRIPLE = f"<p>1 {PROSE}</p><p>2 {PROSE}</p><p>3 {PROSE}</p>"
FURNITURE_CASES = [
    (f"<form action=x>{MENU}{ARTICLE}<input name=q><footer>F</footer></form>", f"Head {PROSE}Short."),
    (f"<form><div>{MENU}<div>{TRIPLE}</div></div></form>", f"1 {PROSE}2 {PROSE}3 {PROSE}"),
    (f"<aside>Side <div>{ARTICLE}</div>", f"Head {PROSE}Short."),
    (f"{MENU}<header>{ARTICLE}</header>", f"Head {PROSE}Short."),
    (f"<div role=dialog>{ARTICLE}</div><div role=navigation>Go</div>", f"Head {PROSE}Short."),
    (f"{MENU}<footer>F</footer>", ""),
    (MENU, ""),
    (f"<ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/a>About us</a></ul>{TRIPLE}<p>Copyright 2020 Firm",
     f"1 {PROSE}2 {PROSE}3 {PROSE}"),
    (f"<h1><a href=/t>Title</a></h1>{TRIPLE}<p><a href=/next>Next</a></p><p>© 2020</p>", f"Title 1 {PROSE}2 {PROSE}3 {PROSE}"),
    (f"<div>{TRIPLE}<ul><li>with <a href=x>a link</a> in it<li><a href=y>one</a></ul><p>4 {PROSE}</p></div>",
     f"1 {PROSE}2 {PROSE}3 {PROSE}with a link in it one 4 {PROSE}"),
    (f"<article><p hidden>Secret</p><p>{PROSE}</p><div hidden=until-found>x</div><p aria-hidden=true>y</p></article>", PROSE),
    (f"<article><p>A <label>word</label> in <button>the</button> text {PROSE}</p><button>Share</button><label>Name</label></article>",
     f"A word in the text {PROSE}"),
    (f"<article><header><h1>Head</h1><p>Standfirst of the article.</p></header><p>{PROSE}</p></article>",
     f"Head Standfirst of the article. {PROSE}"),
    (f"<article><p>{PROSE}</p><form><p>Mail <input></p></form><aside><p>{PROSE}</p></aside><footer><p>Tags</p></footer></article>", PROSE),
]


@pytest.mark.parametrize("body, text", FURNITURE_CASES)
def test_furniture_tags_decide_after_parsing(body, text):
    assert h.main_text(page(body)) == " ".join(text.split())


@pytest.mark.parametrize("start, end", [("<div>", ""), ("<div>", "</div>"), ("<b>", "</section>"), ("<p><button>", "</i>"), ("<ul><li>", "</ul>")])
def test_deep_nesting_takes_linear_time(start, end):
    begun = time.perf_counter()
    assert h.main_text(start * 50_000 + "deep text" + end * 50_000) in ("deep text", "")
    assert time.perf_counter() - begun < 20


def test_line_scores():
    ratio = np.array([1.0, 1.0, 50.0, 60.0, 1.0])
    out = h.smoothed(ratio)
    assert len(out) == 5 and out[2] > out[0] and out.max() < 60
    assert h.smoothed(np.full(4, 7.0)) == pytest.approx(np.full(4, 7.0))


def test_region_without_an_article():
    links = "".join(f"<div><a href=x>go {i}</a></div>" for i in range(20))
    text = h.main_text(page(f"<div>{links}</div><div><p>{PROSE}</p><p>{PROSE}</p></div><div>{links}</div>"))
    assert text == f"{PROSE}{PROSE}".strip()


REGION_CASES = [
    (f"<main><p>{PROSE}</p><p>{PROSE}</p><article><p>{PROSE * 3}</p></article></main>", PROSE * 5),
    (f"<main><article><p>1 {PROSE}</p></article><article><p>{PROSE}</p></article></main><div>{MENU}</div>", f"1 {PROSE}{PROSE}"),
    (f"<article><p>1 {PROSE}</p></article><div><a href=x>Go</a></div><article><p>{PROSE}</p><p>E</p></article>", f"1 {PROSE}{PROSE}E"),
    ("<div><p>intro</p><ul>" + f"<li>{PROSE}</li>" * 20 + "</ul><p>end</p></div>", f"intro {PROSE * 20}end"),
    (f"<div><p>{PROSE}</p><table>" + f"<tr><td>{PROSE}</td></tr>" * 9 + "</table></div>", PROSE * 10),
    (f"<div><p>Lead.</p><p>{PROSE}</p><section><p>{PROSE * 9}</p></section><blockquote>Q</blockquote></div>", f"Lead. {PROSE * 10}Q"),
    (f"<table><tr><td><a href=x>Go</a><br><a href=y>On</a></td><td><p>{PROSE}</p><p>E</p></td></tr></table>", f"{PROSE}E"),
]


@pytest.mark.parametrize("body, text", REGION_CASES)
def test_region_holds_all_content(body, text):
    assert h.main_text(page(body)) == text.strip()


def test_whole_table(spark):
    """The given pages have their text in an article element."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r.page_id: (r.text, r.n_chars) for r in h.op10_html_text(spark, SF).collect()}
    assert len(found) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|<footer)", r.html, re.S)[1]
        parts = re.sub("<[^>]+>", "", re.sub("<(?:/?p|br|/?h1)>", "\0", body)).split("\0")
        text = " ".join(" ".join(entities.unescape(x).split()) for x in parts if x.strip())
        assert found[r.page_id] == (text, len(text))


def test_columns_nulls_and_long_pages(spark):
    rows = [(1, None), (1, None), (None, "<p>a</p>"), (2, "<p>" + "word " * 300_000), (3, "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("own")).withColumn("0", F.lit(1))
    out = h.extract(df)
    assert out.columns == ["page_id", "0", "text", "n_chars"]
    assert sorted(((r.page_id, r.n_chars) for r in out.collect()), key=str) == sorted(
        [(1, 0), (1, 0), (None, 1), (2, 1_499_999), (3, 4)], key=str)
    assert h.extract(df.limit(0)).collect() == []
