import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanworks.operators import html, language
from gleanworks.operators.language import EntityRule


def page(spark, body):
    return spark.createDataFrame([(1, body, "https://h.org/a/b")], "page_id bigint, html string, url string")


@pytest.mark.parametrize("selector, text, matches", [
    ("h1", "Title & more", 1), ("#main", "Title & moreonetwo", 1), (".item", "onetwo", 2), ("li.item", "onetwo", 2), ("div #main li", "onetwo", 2),
    ("table", "", 0), ("p", "first", 1), ("li.item.last", "two", 1), ("*", None, None),
])
def test_selectors(spark, selector, text, matches):
    body = '<div><p>first<div id="main"><h1>Title &amp; more</h1><ul><li class="item">one<li class="item last">two</ul></div></div>'
    row = html.extract_selectors(page(spark, body), "page_id", "html", {"x": selector}).first()
    if text is not None:
        assert (row.content, row.matches) == (text, matches)


def test_selector_errors(spark):
    rows = html.extract_selectors(page(spark, "<p>12345</p>"), "page_id", "html", {"x": {"selector": "h9", "required": True}}).first()
    assert (rows.content, rows.error) == ("", "REQUIRED_MISSING")
    large = html.extract_selectors(page(spark, "<p>12345</p>"), "page_id", "html", {"x": "p"}, max_html=5).first()
    assert (large.content, large.error) == ("", "TOO_LARGE")
    capped = html.extract_selectors(page(spark, "<p>12345</p>"), "page_id", "html", {"x": "p"}, max_text=3).first()
    assert (capped.content, capped.error) == ("123", "CUT")
    whole = html.extract_selectors(page(spark, "<p>" + "x" * 1_000_005 + "</p>"), "page_id", "html", {"x": "p"}).first()
    assert (len(whole.content), whole.error, whole.size) == (1_000_005, None, 1_000_012)
    with pytest.raises(ValueError):
        html.compile_selector("a + b")


def test_paragraphs_close_each_other(spark):
    row = html.extract_selectors(page(spark, "<p><b>one<br><p>two</p>"), "page_id", "html", {"p": "p", "b": "b"})
    assert {r.name: (r.content, r.matches) for r in row.collect()} == {"p": ("onetwo", 2), "b": ("one", 1)}


@pytest.mark.parametrize("raw, clean", [
    ("<p>a</p><script>x()</script>", "<p>a</p>"),
    ('<a href="javascript:x" onclick="y">t</a>', '<a target="_blank" rel="noopener noreferrer">t</a>'),
    ('<a href="/p" title="q">t</a>', '<a href="/p" title="q" target="_blank" rel="noopener noreferrer">t</a>'),
    ('<a href="//evil.org">t</a>', '<a target="_blank" rel="noopener noreferrer">t</a>'),
    ('<td colspan="2" style="x" class="c">1</td>', '<td colspan="2" class="c">1</td>'),
    ("<section>kept <b>bold</b></section>", "kept <b>bold</b>"), ("a &lt; b &amp; c<br>", "a &lt; b &amp; c<br />"),
    ("<p> </p><!-- gone -->x", "x"), ("<h6>six</h6>", "six"), ("<b>open", "<b>open</b>"),
])
def test_sanitise(spark, raw, clean):
    assert html.sanitise(page(spark, raw), "html").first().clean_html == clean


@pytest.mark.parametrize("raw, clean", [
    ("<h1>cut &amp;&amp</h1>", "<h1>cut &amp;&amp</h1>"), ("<h1>cut &am</h1><p>p;</p>", "<h1>cut &am</h1><p>p;</p>"), ("a && b &lt c &quot", "a && b &lt c &quot"),
    ("&am<h6>p;</h6>", "&amp;amp;"), ("&l<b> </b>t;", "&amp;lt;"), ("&am&#112;;", "&amp;amp;"), ("&lt<i>x</i>", "&lt<i>x</i>"), ("&gt</h6>x", "&gt;x"), ("x &foo; &copy &nbsp;y", "x &foo; \u00a9 \u00a0y"),
    ('<a href="/q?a=1&b=2&amp=3&lt">t</a>', '<a href="/q?a=1&amp;b=2&amp;=3&lt;" target="_blank" rel="noopener noreferrer">t</a>'),
    ("<p>\ufdd0amp\ufdd0 &</p>", "<p>\ufdd0amp\ufdd0 &</p>"),
])
def test_sanitise_unfinished_references(spark, raw, clean):
    """Ampersands of cut texts stay as written where they read the same, and never join what follows to a reference."""
    assert html.sanitise(page(spark, raw), "html").first().clean_html == clean


def test_links(spark):
    hrefs = ["/x", "y", "//k.org/z", "#f", "mailto:q@h.org", "/x"]
    body = "".join(f'<a class="c" href="{h}">t</a>' for h in hrefs) + "<a href='s'>q</a><A HREF=u>v</A><link href='no'>"
    body += "<!-- <a href='/hidden'>h</a> --><script>w('<a href=\"/code\">')</script>"
    rows = html.extract_links(page(spark, body), "page_id", "html", "url").orderBy("position").collect()
    assert [r.link for r in rows] == [
        "https://h.org/x", "https://h.org/a/y", "https://k.org/z", "https://h.org/a/b#f", "https://h.org/a/s", "https://h.org/a/u"]


@pytest.mark.parametrize("body, found", [
    ('<a href="a b.html">x</a>', ["https://h.org/a/a%20b.html"]),
    ('<a title="a>b" href="q.html">x</a>', ["https://h.org/a/q.html"]),
    ('<a title="x href=bad" href="good">x</a>', ["https://h.org/a/good"]),
    ('<textarea><a href="hidden"></textarea><a href=shown>', ["https://h.org/a/shown"]),
    ('<a href="a&#47;b&#x2f;c&amp;d">x</a>', ["https://h.org/a/a/b/c&d"]),
    ('<a href="HTTP://EX.org:80/x">x</a><a href="http://ex.org/x">y</a><a href="https://EX.org:443">z</a>', ["http://ex.org/x", "https://ex.org/"]),
    ('<a href="\n /p\n/q \n">x</a>', ["https://h.org/p/q"]),
    ('<a href="/é?q=ü">x</a>', ["https://h.org/%C3%A9?q=%C3%BC"]),
    ('<abbr href="no"><a data-href="no">x</a><a\nHREF=\'yes\'>y</a>', ["https://h.org/a/yes"]),
    ('<a href="">x</a><a href>y</a><a href="javascript:z">z</a>', []),
])
def test_links_as_a_browser_resolves_them(spark, body, found):
    assert [r.link for r in html.extract_links(page(spark, body), "page_id", "html", "url").orderBy("position").collect()] == found


def test_no_link_or_row_is_dropped(spark):
    body = "".join(f'<a href="/{k}">' for k in range(5005)) + f'<a href="/{"x" * 3000}">'
    rows = html.extract_links(page(spark, body), "page_id", "html", "url").collect()
    assert len(rows) == 5006 and [r.too_long for r in rows] == [False] * 5005 + [True]
    table = "<table><tr><th>N</th></tr>" + "".join(f"<tr><td>{k}</td></tr>" for k in range(10_005)) + "</table>"
    assert html.extract_tables(page(spark, table), "page_id", "html").count() == 10_005


def test_tables(spark):
    body = ("<table><tr><th>D</th><th>Dose</th></tr><tr><td>A</td><td>5</td></tr><tr><td>B</td><td>10</td></tr></table>"
            "<table><tr><td>no header</td></tr></table>")
    rows = html.extract_tables(page(spark, body), "page_id", "html").orderBy("row_no").collect()
    assert [r.cells for r in rows] == [{"D": "A", "Dose": "5"}, {"D": "B", "Dose": "10"}]


def text(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_categories(spark):
    rows = text(spark, "Take 5 mg", "a Study", "none", "Clinical trial of dosage").select("doc_id", language.categories(F.col("text")).alias("c")).orderBy("doc_id").collect()
    assert [[c["category"] for c in r.c] for r in rows] == [["DRUG_INFORMATION"], ["CLINICAL_TRIALS"], [], ["DRUG_INFORMATION", "CLINICAL_TRIALS"]]
    assert rows[0].c[0]["subcategories"] == ["DOSAGE", "INTERACTIONS"]


def test_entities_are_substrings(spark):
    rules = [EntityRule("DRUG", r"(?i)\baspirin tablets forte\b", 0.95, literal="aspirin"), *language.ENTITY_RULES]
    sources = ["ü Aspirin tablets forte for someone.long@example.com", "short a@b.co 5 mg", ""]
    rows = language.extract_entities(text(spark, *sources), "doc_id", "text", rules).collect()
    assert {(r.type, r.text) for r in rows} == {("DRUG", "Aspirin tablets forte"), ("EMAIL", "someone.long@example.com")}
    for r in rows:
        assert sources[r.doc_id][r.start:r.end] == r.text and r.confidence >= 0.75
        assert r.is_pii == (r.type == "EMAIL")


def test_analysis_gate(spark):
    both = "trial of 5 mg, write to someone.long@example.com"
    rows = {r.doc_id: r for r in language.analyse(text(spark, both, "Take 5 mg", "", None), "doc_id", "text").collect()}
    assert rows[0].status == "COMPLETED" and rows[0].confidence == pytest.approx((0.8 + 0.925) / 2) and rows[0].pii_detected
    assert (rows[1].reason, rows[1].confidence) == ("LOW_CONFIDENCE", pytest.approx(0.475))
    assert rows[2].reason == rows[3].reason == "UNREADABLE"


def test_key_phrases(spark):
    df = text(spark, "alpha alpha beta common", "gamma common", "common delta delta delta")
    got = [(r.doc_id, r["rank"], r.term) for r in language.key_phrases(df, "doc_id", "text", top=2).orderBy("doc_id", "rank").collect()]
    assert got == [(0, 1, "alpha"), (0, 2, "beta"), (1, 1, "gamma"), (1, 2, "common"), (2, 1, "delta"), (2, 2, "common")]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_key_phrases_shuffle_only_rare_terms(spark, most):
    """Frequent terms meet their document frequencies by broadcast, others by a join, with the same scores."""
    bodies = [f"common often{'s' * (k % 2)} " + f"rare{'abcdefgh'[k % 8] * 3} " * (k % 3) + f"only{'x' * k}" for k in range(40)] + [None, ""]
    df = spark.createDataFrame([(k % 30, b) for k, b in enumerate(bodies)], "doc_id long, text string")
    found = language.key_phrases(df, "doc_id", "text", top=3, broadcast_terms=most)
    split = [re.findall("[a-z]{4,}", b or "") for b in bodies]
    held, counts = Counter(t for s in split for t in set(s)), {}
    for k, s in enumerate(split):
        counts.setdefault(k % 30, Counter()).update(s)
    best = {i: sorted(((-round(n * math.log(len(bodies) / held[t]), 6), t) for t, n in c.items()))[:3] for i, c in counts.items()}
    want = sorted((i, rank, t, -s) for i, b in best.items() for rank, (s, t) in enumerate(b, 1))
    got = sorted((r.doc_id, r["rank"], r.term, r.score) for r in found.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert "_salt" not in found._jdf.queryExecution().toString()


def test_sentiment(spark):
    got = language.sentiment(text(spark, "good bad good", "plain"), "doc_id", "text", {"good": 1.0, "bad": -1.0}).orderBy("doc_id").collect()
    assert [(round(r.polarity, 6), r.hits) for r in got] == [(0.333333, 3), (0.0, 0)]


@pytest.mark.parametrize("selector, content", [
    ("div > p", "onefive"), ("div p", "onetwofive"), ("section > p", "two"), ("body > p", ""), ("p, h2", "onetwohead4five"), ("a[href]", "linkmail"),
    ("a[href^='/']", "link"), ('a[href$=".org"]', "mail"), ("a[rel~=next]", "link"), ("p[lang|=en]", "two"), ("[data-x='a]b']", "five"), ("div>p.k", "five"),
    ("div section > p, h2#t", "twohead4"), ("*[title*=ell]", "head4"), ("p[lang=en]", ""),
])
def test_selector_steps(spark, selector, content):
    body = ("<div><p>one</p><section><p lang='en-GB'>two</p></section></div><h2 id='t' title='hello'>head4</h2><a href='/x' rel='prev next'>link</a>"
            "<a href='mailto:a@b.org'>mail</a><a>none</a><div><p class='k l' data-x='a]b'>five</p></div>")
    assert html.extract_selectors(page(spark, body), "page_id", "html", {"x": selector}).first().content == content


@pytest.mark.parametrize("selector", ["", " ", ">p", "p >", "p,", ",p", "a:hover", "a[", "a[x=]", "a ~ b", "p..x", "p > > a"])
def test_selectors_that_cannot_be_read(selector):
    with pytest.raises(ValueError):
        html.compile_selector(selector)


def test_selectors_by_job(spark):
    """Each page has its own job's selectors; jobs without any, null jobs and selectors that cannot be read."""
    pages = spark.createDataFrame([(1, "a", "<h1>A1</h1><p>x</p>"), (2, "b", "<h1>B2</h1><p>y</p>"), (3, "c", "<h1>C</h1>"), (4, None, "<p>n</p>"), (5, "a", None)], "page_id long, job string, html string")
    rows = [("a", "t", "h1", True), ("a", "t", "h1", True), ("b", "t", "p", None), ("b", "bad", "p::x", False), (None, "z", "h1, p", False), ("d", "t", "h1", True)]
    got = html.extract_by_job(pages, "page_id", "html", "job", spark.createDataFrame(rows, "job string, name string, selector string, required boolean"))
    assert sorted((r.page_id, r.name, r.content, r.matches, r.error) for r in got.collect()) == [
        (1, "t", "A1", 1, None), (2, "bad", "", 0, "BAD_SELECTOR"), (2, "t", "y", 1, None), (4, "z", "n", 1, None), (5, "t", "", 0, "REQUIRED_MISSING")]
