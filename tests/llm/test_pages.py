"""Main texts of pages against plain extraction and plain counting of repeated stretches."""

import html
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from letterloom.llm import pages, queries

DATA = "/root/testdata/sf0.001"


def article(page):
    """The article of the given pages, which all have one."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [html.unescape(re.sub(r"<[^>]*>", "", p)) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(filter(None, (" ".join(p.split()) for p in parts)))


def covered(rows, run=pages.MIN_RUN):
    """rows: (host, html). For every distinct one the marked words of its stream."""
    streams = {r: pages.stream_of(pages.blocks_of(r[1])) for r in rows}
    seen = {}
    for (host, page), words in streams.items():
        for i in range(len(words) - run + 1):
            seen.setdefault((host, *words[i:i + run]), set()).add(page)
    out = {}
    for (host, page), words in streams.items():
        marks = np.zeros(len(words) + 1, bool)
        for i in range(len(words) - run + 1):
            if len(seen[(host, *words[i:i + run])]) > 1:
                marks[i:i + run] = True
        out[host, page] = marks
    return out


def host(url):
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", (url or "").lower())
    return found[1] if found else ""


def plain(page, marks, run=pages.MIN_RUN):
    blocks = pages.blocks_of(page)
    text = pages.decided_text(blocks)
    return pages.unique_text(blocks, marks, run) if text is None else text


def expected(rows):
    marks = covered({(host(r.url), r.html or "") for r in rows})
    return sorted(plain(r.html or "", marks[host(r.url), r.html or ""]) for r in rows)


def found(df):
    return sorted(r.text for r in df.collect())


def test_query_equals_plain_extraction(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    done = queries.op13_main_text(spark, DATA).collect()
    assert {r.page_id: r.text for r in done} == {r.page_id: article(r.html) for r in rows}
    assert all(r.n_chars == len(r.text) for r in done)


def test_repeated_stretches_of_the_given_pages(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet")
    parts = pages.read_pages(rows).withColumn("wanted", F.lit(True))
    by_page = {r.page: r for r in pages.boilerplate(parts).collect()}
    marks = covered({(host(r.url), r.html) for r in rows.collect()})
    known = {(r.host, tuple(r.stream)): r.page for r in parts.collect()}
    assert sum(m.sum() for m in marks.values()) > 0
    for (name, page), mark in marks.items():
        stream = pages.stream_of(pages.blocks_of(page))
        row = by_page.get(known[name, tuple(stream)])
        got = pages.covered_words(len(stream), row and row.starts, row and row.ends, pages.MIN_RUN)
        assert got.tolist() == mark.tolist()


MENU = "<div><a>Home page</a> <a>All our news</a></div><div>About us and more</div>"
END = "<div>Written by the same people for all of our readers everywhere &copy; 2020</div>"


@pytest.mark.parametrize("sizes", [1, 1 << 24])
def test_pages_without_an_article_lose_what_their_host_repeats(spark, monkeypatch, sizes):
    monkeypatch.setattr(pages, "SLICE", sizes)
    own = [f"<p>Text number {i} says <b>things</b> that are said<br>nowhere else, {i} times.</p>" for i in range(6)]
    texts = [f"Text number {i} says things that are said nowhere else, {i} times." for i in range(6)]
    rows = [(i, f"http://A.example/{i}", f"<body>{MENU}{own[i]}{END}</body>") for i in range(5)]
    rows += [(5, "http://b.example:80/", f"<body>{MENU}{own[5]}{END}</body>")]
    rows += [(6, None, own[5]), (7, None, own[5]), (8, "nowhere", None), (None, None, ""), (9, "x", "<p>&nbsp;</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    done = {r.page_id: r.text for r in pages.main_texts(df).collect()}
    assert [done[i] for i in range(5)] == texts[:5]
    # Alone on its host nothing is repeated, and copies of a page are one page.
    assert done[5].startswith("Home page All our news\n\nAbout us and more\n\nText number 5")
    assert done[6] == done[7] == texts[5]
    assert done[8] == done[9] == done[None] == ""
    assert found(pages.main_texts(df)) == expected(df.collect())


words = st.lists(st.sampled_from(["<p>", "a", "b", "c c", "<div>", "</div>", "d"]), max_size=40).map(" ".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["//h/1", "//k/2"]), words), min_size=1, max_size=8), st.integers(2, 9))
def test_repeated_stretches_equal_plain_counting(spark, rows, run):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    marks = covered({(host(u), h) for u, h in rows}, run)
    assert found(pages.main_texts(df, min_run=run)) == sorted(plain(h, marks[host(u), h], run) for u, h in rows)


@pytest.mark.parametrize("page, text", [
    ("", ""), ("no tags & <3 at all", "no tags & <3 at all"), ("<p>a<p>b", "a\n\nb"),
    ("<nav>menu</nav><article><h1>T</h1><p>x  y\n z&amp;amp; &eacute;&#233;</p></article><footer>f</footer>",
     "T\n\nx y z&amp; éé"),
    ("<article>a<script>var x='</p>';<b></script>b<style>p{}</style><!-- c <p> -->d</article>", "abd"),
    ("<article><p>one<aside>side</aside><p>two<form>say <input></form><div class='share-buttons'>tell</div>"
     "</article><section id=comments><article>nice</article></section>", "one\n\ntwo"),
    ("<main><p>m</p><div class=cookieNotice>ok?</div></main><p>outside", "m"),
    ("<form id=f><main><p>in a form</p></main></form>", "in a form"),
    ("<nav><ul><li>never closed<article><p>kept</p></article>", "kept"),
    ("<div class='page header-fixed'><article><p>kept</p></article></div>", "kept"),
    ("<p>before <span class=ad>buy</span> after</p>", "before after"),
    ("<head><title>t</title><meta charset=x><p>no body tag</p>", "no body tag"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2<tr><td>c3</table></article>",
     "one\n\ntwo\n\nc1\n\nc2\n\nc3"),
    ("<article class='comment'>r</article><article>a</article>", "a"),
    ("<p hidden>h</p><p style='display: none'>n</p><p aria-hidden=true>x</p><p>v</p>", "v"),
    ("<p title='a>b'>q</p><p title='open>r</p></b></i>", "q\n\nr"),
    ("<div itemprop=articleBody>body</div><div>else</div>", "body"),
    ("<article>cut off <b>here", "cut off here"), ("<article>" + "<i>" * 5000 + "deep", "deep"),
    ("<article>" + "w " * 100_000 + "</article>", " ".join("w" * 100_000)),
])
def test_places_and_odd_markup(page, text):
    assert plain(page, np.zeros(len(pages.stream_of(pages.blocks_of(page))) + 1, bool)) == text


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "//h", "<p>x", "old", 3, "e")],
                               "page_id long, url string, html string, text string, page int, `page html` string")
    done = pages.main_texts(df)
    assert done.columns == ["page_id", "url", "page", "page html", "text"]
    assert tuple(done.first()) == (1, "//h", 3, "e", "x")
    assert pages.main_texts(df.limit(0)).collect() == []


STORY = "A long story of the people by the river that every page of this host may print again in full."


def test_copies_of_an_article_keep_its_text(spark):
    """What stands in an article of the host is text on its other pages too, menu and end are not."""
    assert pages.stream_of([(pages.ARTICLE, "a b"), (pages.ASIDE, "c")]) == ["", "a", "b", "", "\n", "", "c", ""]
    printed = [f"<body>{MENU}<p>{STORY}</p>{END}<p>{x}</p></body>" for x in ("Printed on a Monday", "For small phones")]
    rows = [(1, "//h/1", f"<body>{MENU}<article><p>{STORY}</p></article>{END}</body>"),
            (2, "//h/2", printed[0]), (3, "//h/3", printed[1]), (4, "//k/4", printed[0]), (5, "//k/5", printed[1])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    done = {r.page_id: r.text for r in pages.main_texts(df).collect()}
    assert done == {1: STORY, 2: f"{STORY}\n\nPrinted on a Monday", 3: f"{STORY}\n\nFor small phones",
                    4: "Printed on a Monday", 5: "For small phones"}   # no article on this host


def test_short_last_line_of_an_article_is_no_boilerplate(spark):
    """No stretch reaches from an article into what follows it, so a short line there and a
    repeated footer are not taken for one."""
    body = "<p>Text number %d of one host says its own things, %d of them.</p><p>All rights reserved.</p>"
    rows = [(1, "//h/1", f"<article>{body % (1, 1)}</article><footer>{END}</footer>"),
            (2, "//h/2", f"{body % (2, 2)}<footer>{END}</footer>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    done = {r.page_id: r.text for r in pages.main_texts(df).collect()}
    assert done == {i: f"Text number {i} of one host says its own things, {i} of them.\n\nAll rights reserved."
                    for i in (1, 2)}


parts = st.lists(st.sampled_from(["<p>", "a", "b", "c c", "<div>", "</div>", "<article>", "</article>", "<nav>",
                                  "</nav>"]), max_size=40).map(" ".join)


@pytest.mark.parametrize("size", [1, 1 << 19])
@settings(max_examples=8, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from(["//h/1", "//k/2"]), parts), min_size=1, max_size=8),
       run=st.integers(2, 9))
def test_stretches_in_articles_equal_plain_counting(spark, size, rows, run):
    told = set()
    for url, page in rows:
        blocks = pages.blocks_of(page)
        stream, inside = pages.stream_of(blocks), [True] * bool(blocks)
        for i, (p, t) in enumerate(blocks):
            edge = i and (p == pages.ARTICLE) != (blocks[i - 1][0] == pages.ARTICLE)
            inside += [False, True] * bool(edge) + [p == pages.ARTICLE] * len(t.split(" ")) + [True]
        assert len(stream) == len(inside)
        told |= {(host(url), *stream[i:i + run]) for i in range(len(stream) - run + 1) if all(inside[i:i + run])}
    marks = covered({(host(u), h) for u, h in rows}, run)
    for (name, page), mark in marks.items():
        stream = pages.stream_of(pages.blocks_of(page))
        for i in range(len(stream) - run + 1):
            if (name, *stream[i:i + run]) in told:
                mark[i:i + run] = False
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    before, pages.SLICE = pages.SLICE, size
    try:
        assert found(pages.main_texts(df, min_run=run)) == sorted(plain(h, marks[host(u), h], run) for u, h in rows)
    finally:
        pages.SLICE = before
