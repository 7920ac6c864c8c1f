"""Main text: markup by cases and on the given pages, repeated runs against a brute force."""

import html
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from spinewright.llm import maintext

PAGES = "page_id bigint, url string, html string, text string, host string, level int"


def text(page):
    return " ".join(maintext.blocks(page)[1])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain  text\n\there", "plain text here"),
        ("<p>a<p>b<p>c", "a b c"),
        ("<article><h1>T &amp; U</h1><p>wo<b>rd</b>s<br>x</p></article><footer>f</footer>", "T & U words x"),
        ("<body><nav>n<ul><li>m</ul></nav><div class='ad'>buy</div><article><p><b>open<br><p>next</article>", "open next"),
        ('<script>var t="</p><p>no";</script><STYLE>p{}</STYLE><p>yes</p><!-- <p>no</p> --><p>&lt;b&gt; &eacute;&nbsp;&#233; &am</p>', "yes <b> é é &am"),
        ("<header>site</header><main><header><h1>Title</h1></header><p>one</p><aside>x</aside><form>f<input></form><section id='comments'><article class='comment'>c</article></section></main><div>out</div>", "Title one"),
        ("<form action='/'><main><p>inside a form</p></main>bye</form>", "inside a form"),
        ("<div class='content-with-sidebar'><p>kept</p></div>", "kept"),
        ("<div class='post-content'><p>kept</p><div class='share-buttons'>s</div></div><p>out</p>", "kept"),
        ("<div role='navigation'>n</div><div id='cookieConsent'>c</div><div class='siteHeader'>h</div><p>kept</p>", "kept"),
        ("<p title='a>b' data-x=\"<p>\">kept</p>", "kept"),
        ("<p>1 < 2 and <3</p><p/>x</p></nosuch></p>", "1 < 2 and <3 x"),
        ("<article>a<span class='ad'>no</span>b <a class='share' href=x>no</a>c<p class='ad'>no<p>d</article>", "a b c d"),
        ("<table><tr><td>a<td>b<tr><td>c</table><ul><li class='ad'>no<li>d</ul>", "a b c d"),
        ("<div hidden>no</div><div style='display: none'>no</div><p aria-hidden='true'>no</p><p>yes</p>", "yes"),
        ("<p>unclosed <script>no", "unclosed"),
        ("<p>unclosed <a href='x", "unclosed"),
        ("<html><head><title>no</title><p>yes", "yes"),
        ("<article>one</article><p>out</p><article>two</article>", "one two"),
        ("<p>a　b c\x1fd</p>", "a b c d"),
    ],
)
def test_markup(page, want):
    assert text(page) == want


def test_long_and_odd_markup_takes_linear_time():
    for page in ("<div>" * 200_000, "</div>" * 200_000, "<a '" * 200_000, "<!--" * 200_000, "<script>" * 200_000, "<" * 500_000, "<p a='b' " * 200_000, "&" * 500_000, '<p x="' * 100_000, "<span class=ad>" * 100_000):
        text(page)


def brute_repeated(pages, need, run):
    on = defaultdict(set)
    for d, tokens in enumerate(pages):
        for i in range(len(tokens) - run + 1):
            on[tuple(tokens[i : i + run])].add(d)
    out = []
    for d, tokens in enumerate(pages):
        gone = [False] * len(tokens)
        for i in range(len(tokens) - run + 1):
            if len(on[tuple(tokens[i : i + run])]) >= need[d]:
                gone[i : i + run] = [True] * run
        out += gone
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5, 6, 8])
def test_repeated_runs_equal_brute_force(run):
    r = random.Random(run)
    pages = [[r.randint(0, 3) for _ in range(r.randint(0, 40))] for _ in range(40)]
    need = np.array([r.randint(2, 9) for _ in pages])
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    got = maintext.repeated(page, np.array([t for p in pages for t in p]), need, run)
    assert got.tolist() == brute_repeated(pages, need.tolist(), run)


@pytest.mark.parametrize(("group_bytes", "few"), [(1 << 20, 10), (3000, 10), (3000, 0)])
def test_what_a_host_repeats_goes_and_copies_stay(spark, monkeypatch, group_bytes, few):
    monkeypatch.setattr(maintext, "FEW_HOSTS", few)
    notice = "<div class='x7'>We store small files on your device to remember your settings</div>"
    unique = lambda i: " ".join(f"w{i}n{k}" for k in range(12))
    rows = [(i, f"http://a.org/{i}", f"<body>{notice}<div><p>{unique(i)}</p></div><p>All rights of this site are reserved by us</p>") for i in range(40)]
    rows += [(100 + i, f"http://b.org/{i}", f"<body>{notice}<p>the same short story on each of its pages</p>") for i in range(5)]
    rows += [(200 + i, f"http://c.org/{i}", f"<article><p>Often quoted passage of a few more words</p><p>{unique(i)}</p></article>") for i in range(4)]
    rows += [(300 + i, None, f"{notice}<p>{unique(i)}</p>") for i in range(4)]
    pages = spark.createDataFrame([(*r, "t", "h", 1) for r in rows], PAGES).repartition(3)
    got = {r.page_id: r.text for r in maintext.main_text(pages, group_bytes=group_bytes).collect()}
    said = "We store small files on your device to remember your settings"
    assert len(got) == len(rows)
    assert all(got[i] == unique(i) for i in range(40))
    assert all(got[100 + i] == f"{said} the same short story on each of its pages" for i in range(5))
    assert all(got[200 + i] == f"Often quoted passage of a few more words {unique(i)}" for i in range(4))
    assert all(got[300 + i] == f"{said} {unique(i)}" for i in range(4))


def test_nulls_repeated_rows_and_no_rows(spark):
    rows = [(1, "http://a.org/", "<p>x</p>"), (1, "http://a.org/", "<p>x</p>"), (None, None, None), (2, "no scheme", ""), (3, "http:///?#", "<nav>n</nav>")]
    pages = spark.createDataFrame([(*r, "t", "h", 1) for r in rows], PAGES)
    got = sorted((r.page_id or 0, r.url or "", r.text) for r in maintext.main_text(pages).collect())
    assert got == [(0, "", ""), (1, "http://a.org/", "x"), (1, "http://a.org/", "x"), (2, "no scheme", ""), (3, "http:///?#", "")]
    assert maintext.main_text(pages.where("false")).count() == 0


def test_query_over_pages(spark, sf):
    """The given pages have one article each, whose text is its blocks'."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").join(maintext.op13_main_text(spark, sf).withColumnRenamed("url", "u"), "page_id").collect():
        article = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        spaced = re.sub(r"</?(?:p|h1|br)>", " ", article)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", spaced)).split())
        assert (r.text, r.n_chars, r.u) == (want, len(want), r.url)


def test_texts_do_not_hang_on_the_size_of_groups(spark):
    """Lines on 30 to 70 % of a host's pages, unevenly dealt: each goes or stays on all of them, however many groups there are."""
    r = random.Random(3)
    rows = []
    for i in range(60):
        lines = [f"line {k} that stands on some of the pages of this host {k}" for k in range(9) if r.random() < 0.3 + k * 0.05]
        unique = " ".join(f"w{i}n{k}" for k in range(r.randint(3, 40)))
        body = "".join(f"<p>{x}</p>" for x in [*lines, unique])
        rows.append((i, f"http://a.org/{i}", f"<article>{body}</article>" if i % 5 == 0 else f"<div>{body}</div>", "t", "h", 1))
    rows.append((99, "http://a.org/99", "", "t", "h", 1))
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = [sorted((x.page_id, x.text) for x in maintext.main_text(pages, group_bytes=size).collect()) for size in (1 << 20, 9000, 700)]
    assert got[0] == got[1] == got[2]
    assert any("line 8" not in t and i % 5 for i, t in got[0][:-1]) and any("line 0" in t for _, t in got[0])
