"""Main text of pages, against a plain parser over pages that mark their article."""

import os
import random
from html.parser import HTMLParser

import pytest

from forgelens.llm import html_text
from forgelens.llm.html_text import best_region, extract, fit_weights, main_text
from forgelens.llm.queries import QUERIES

SF_DIRS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
SCHEMA = "page_id bigint, url string, html string, text string, n_chars string, begin string, _page string, key string"


class Article(HTMLParser):
    """The text of a page's article element, block by block."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("h1", "p"):
            self.blocks.append("")
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("h1", "p"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        found = (" ".join(b.split()) for b in self.blocks)
        return "\n".join(b for b in found if b)


@pytest.mark.parametrize("sf_dir", SF_DIRS)
def test_query_equals_a_plain_parser(spark, sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op13_html_text"](spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for page in pages:
        row = got[page.page_id]
        text = Article(page.html).text()
        assert (row.url, row.text, row.n_chars) == (page.url, text, len(text))


def test_pages_without_a_mark_by_learned_weights(spark):
    """The same pages, their article renamed to a container never seen before."""
    if not os.path.isdir(SF_DIRS[1]):
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"{SF_DIRS[1]}/pages.parquet")
    weights = fit_weights(pages)
    rows = pages.collect()
    plain = [r.html.replace("<article>", '<div id="x">').replace("</article>", "</div>") for r in rows]
    good = sum(extract(p, weights)[0] == Article(r.html).text() for p, r in zip(plain, rows))
    assert good / len(rows) > 0.99


def test_scan_finds_the_best_slice():
    rng = random.Random(3)
    for n in [0, 1, 2, *range(3, 30)]:
        for _ in range(20):
            scores = [float(rng.randrange(-3, 4)) for _ in range(n)]
            first, last, best = best_region(scores)
            sums = {(i, j): sum(scores[i:j]) for i in range(n) for j in range(i, n + 1)}
            assert best == max([0.0, *sums.values()])
            if best:
                assert best == sum(scores[first:last])
                assert last == min(j for (i, j), s in sums.items() if s == best)
            else:
                assert (first, last) == (0, 0)


WORDS = "some words of the text that go on for a while"
PAGE = """<!DOCTYPE html><html><head><title>T t</title><style>p{}</style></head><body>
<header class="site"><a href="/">Home page</a></header><nav><ul><li><a href="/a">One</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site for many things</p></div>
<main><header><h1>A &lt;title&gt;</h1></header><p>%s</p><script>var x = "<p>no</p>";</script>
<div class="advert"><p>Buy this now, it is very good indeed</p></div>
<p>Second&nbsp;&amp; <b>bo</b>ld<br>line</p><ul><li>first<li>second</ul>
<form><label>Your name</label><input></form>
<table><tr><td>a<td>b<tr><td>c</table><!-- no --><aside><p>See this and that as well</p></aside><p>Last of all the words</p>
<section id="comments"><article><p>I am a reader and I think that all of this is wrong</p></article></section></main>
<div class="sidebar"><p>other things to read on this site today</p></div><footer><p>&copy; 2024 us and some others</p></footer>""" % WORDS


def test_what_is_no_part_of_an_article_is_left_out():
    expected = f"A <title>\n{WORDS}\nSecond & bold line\nfirst\nsecond\na b\nc\nLast of all the words"
    assert extract(PAGE, {})[0] == expected
    text, begin, end, score = extract(PAGE, {})
    assert PAGE[begin:end].startswith("A &lt;") and PAGE[begin:end].endswith("Last of all the words") and score > 0
    # an advert that is never closed ends where the article begins
    assert extract(f'<div class="ad"><p>Buy this<article><p>{WORDS}</article>', {})[0] == WORDS


def test_odd_pages(spark):
    deep = "<div>" * 50_000 + WORDS + "</div>" * 50_000
    pages = [None, "", " ", "plain text\nwithout tags", "a < b & c &lt; d", "<p>cut <a href='x", "<", "</", "<!-- open",
             "<script>never closed", "<p>x</p></div></p>", f"{'<p>w1 w2 w3</p>' * 100_000}", deep, "<P CLASS=ad>Ad</P>text",
             "&#65;&#x42;&nbsp;&unknown; &amp", "<p>one a<p>two b", "\x00 a b", "<nav>only a menu</nav>"]
    expected = ["", "", "", "plain text without tags", "a < b & c < d", "cut", "<", "</", "", "", "x",
                "\n".join(["w1 w2 w3"] * 100_000), WORDS, "text", "AB &unknown; &", "one a\ntwo b", "\x00 a b", ""]
    rows = [(i, f"u{i}" if i % 2 else None, p, "t", "n", "b", "p", "k") for i, p in enumerate(pages)]
    frame = spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(3)
    weights = fit_weights(frame)
    assert weights == {}
    got = main_text(frame, weights).collect()
    assert got[0].__fields__ == ["page_id", "url", "text", "n_chars", "begin", "end", "score"]
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows) + 1 and sum(r.page_id == 3 for r in got) == 2
    # nothing is learned here: a tag costs as much as a word gains
    assert [by_id[i].text for i in range(len(pages))] == expected
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text(frame.limit(0), weights).count() == 0
    assert fit_weights(frame.limit(0)) == {}


def test_sample_goes_by_distinct_pages(spark, monkeypatch):
    page = lambda i: (i, "u", f"<div class='story'><article><p>{WORDS} {i}</p></article><p>other</p></div>")
    pages = spark.createDataFrame([page(i) for i in range(40)], "page_id bigint, url string, html string")
    copies = spark.range(20_000).selectExpr("id as page_id", "'u' as url", "'<article><i>x</i></article>' as html")
    weights = fit_weights(pages.unionByName(copies))
    assert weights["w p in article"] > 2 and weights["w p in div.story"] < 0
    # what one page alone shows is not learned, however often the page is repeated
    assert "t i" not in weights
    assert extract(page(99)[2], weights)[0] == f"{WORDS} 99"
    monkeypatch.setattr(html_text, "MIN_PAGES", 1)
    assert "t i" in fit_weights(pages.unionByName(copies))
