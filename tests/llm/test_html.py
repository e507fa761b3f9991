import itertools
import math
import time
from collections import Counter

import numpy as np
import pytest
from layouts import LAYOUTS
from quillon.llm import html, queries

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><p>Site name and slogan.</p></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li><li><a href="/c">Three</a></li></ul></nav>
<div class="cookie-notice"><p>This site sets cookies, and you may accept them or go away.</p></div><div class="ad">Buy this thing now, it is very good.</div>
<article><h1>The title of it</h1><p><b>First &eacute; paragraph with
  some   words, and more of them.<br><p>Second <i>one</i> of the text is here.</p><p>Short.</p><script>x()</script><p>Last paragraph of the story, which is a bit longer than others.
<div class="comments"><div class="comment">What a great article, thanks for it.</div><p class="comment">I do not agree with it at all, sorry.</p></div></article>
<aside class="sidebar"><h3>Related</h3><p>Another story that you may like to read today.</p></aside><form><p>Subscribe to our letter now.</p><input><button>Go</button></form>
<footer>&copy; 2020 example &middot; All rights reserved.</footer>"""
TEXT = "The title of it\nFirst é paragraph with some words, and more of them.\nSecond one of the text is here.\nShort.\nLast paragraph of the story, which is a bit longer than others."


def test_messages_give_exact_marginals():
    page = html.parse("<div class=ad><p>a b</p>c</div><p>Some words here.</p>")
    n, rng = len(page.parent), np.random.default_rng(0)
    tree = html.Tree(rng.normal(size=html.N_FEATURES), rng.normal(size=(html.KINDS, 2, 2)))
    one, total, pair = np.zeros(n), 0.0, np.zeros((n, 4))
    for y in itertools.product((0, 1), repeat=n):
        s = sum(y[i] * tree.node[page.features[i]].sum() for i in range(n)) + sum(tree.edge[page.kind[i], y[page.parent[i]], y[i]] for i in range(1, n))
        p = math.exp(s)
        total += p
        one += p * np.array(y)
        for i in range(1, n):
            pair[i, 2 * y[page.parent[i]] + y[i]] += p
    got, pairs = tree.beliefs(page)
    assert np.allclose(got, one / total) and np.allclose(pairs[1:], pair[1:] / total)


def test_a_page():
    assert html.main_text(PAGE, html.trained()) == TEXT


def test_a_forest_gives_the_beliefs_of_its_trees():
    rng = np.random.default_rng(1)
    pages = [html.parse(h) for h, _ in html.labelled_pages(5, seed=3)] + [html.parse(""), html.parse("<p>a b</p>")]
    tree = html.Tree(rng.normal(size=html.N_FEATURES) / 4, rng.normal(size=(html.KINDS, 2, 2)))
    one, pairs = html.Forest(pages).beliefs(tree)
    each = [tree.beliefs(p) for p in pages]
    assert np.allclose(one, np.concatenate([o for o, _ in each]))
    assert np.allclose(pairs.reshape(-1, 4), np.concatenate([np.array(q) for _, q in each]))


def shares(pages):
    """Precision and recall by characters of runs, a run as often as it is there."""
    right = wrong = missed = 0
    size = lambda c: sum(len(x) * n for x, n in c.items())
    for page, want in pages:
        got, want = Counter(html.main_text(page, html.trained()).split("\n")), Counter(want)
        right, wrong, missed = right + size(got & want), wrong + size(got - want), missed + size(want - got)
    return right / (right + wrong), right / (right + missed)


def test_made_pages_that_were_not_trained_on():
    pages = [(p, c & {t for t in html.parse(p).text if t}) for p, c in html.labelled_pages(300, seed=99)]
    right = wrong = missed = 0
    size = lambda xs: sum(map(len, xs))
    for page, content in pages:
        got = set(html.main_text(page, html.trained()).split("\n")) - {""}
        right, wrong, missed = right + size(got & content), wrong + size(got - content), missed + size(content - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.94  # many are made hard: no title, hardly a name


def test_layouts_that_were_not_trained_on():
    precision, recall = shares(LAYOUTS.values())
    assert len(LAYOUTS) >= 25 and precision > 0.97 and recall > 0.97


@pytest.mark.parametrize("name", ["wrapper with a side word", "article about reviews", "comments told by a heading", "script with an open comment", "attribute with an open comment", "short article, many comments", "about cookies and adverts", "broken markup"])
def test_nothing_of_the_article_is_lost(name):
    page, want = LAYOUTS[name]
    assert html.main_text(page, html.trained()).split("\n") == want


@pytest.mark.parametrize("make", [
    lambda n: "<div>" * n + "</p>" * n, lambda n: "<svg>" * n, lambda n: "<li><ul>" + "<blockquote>" * (n // 3) + "<li></li>" * (n // 3), lambda n: "<blockquote>" * (n // 2) + "<dd>x</dd>" * (n // 2),
    lambda n: "<div " + "a" * n + " x=1>y", lambda n: "<" + "a" * n + ' ">', lambda n: "<a <a " * (n // 6) + ' ">', lambda n: "<p '>" * n,
])
def test_time_grows_with_the_length(make):
    html.trained()
    at = {}
    for n in (10_000, 80_000):
        began = time.process_time()
        html.main_text(make(n), html.trained())
        at[n] = time.process_time() - began
    assert at[80_000] < 30 * max(at[10_000], 0.02)  # 8 times the length; 64 times where it is quadratic


def test_broken_and_odd_markup():
    tree = html.trained()
    for bad in ["", " ", "<", "<p", "no tags, only words in a page.", "<script>never closed", "<a href=\"x>text", "<p>" * 3000, "</div></p>", "<table><tr><td>x<td>y", "<!-- open", "&#x110000; &nosuch; &#0;", "a" * 200_000, "<b " + "x='1' " * 5000 + ">y</b>", "<p>x</p>" + "<a " * 100_000, "<!" * 100_000]:
        assert isinstance(html.main_text(bad, tree), str)
    assert [t for t in html.parse("<p>a</p><!-- b <p>c</p>").text if t] == ["a"]
    assert [t for t in html.parse("<p>a&nbsp;b <b>c</b>d</p>e<br>f<div>g</div>").text if t] == ["a b cd", "e f", "g"]


def test_only_an_open_comment_ends_a_page():
    runs = lambda page: [t for t in html.parse(page).text if t]
    for head in ["<script>var s='<!--';</script>", "<script><!-- code </script>", "<style><!-- p{} </style>", "<textarea><!-- x</textarea>", "<p title='<!--'></p>", "<!-->", "<!--->", "<!-- x --!>", "<!-- x -->"]:
        assert runs(f"{head}<p>a</p><p>b</p>") == ["a", "b"]
        assert html.main_text(PAGE.replace("<style>", head + "<style>", 1), html.trained()) == TEXT
        for tail in ["<!-- c", "<!-- c <p>d</p>", "<!--", "<!-- c <p>d</p> e <!-- f"]:
            assert runs(f"{head}<p>a</p><p>b</p>{tail}") == ["a", "b"]
    assert runs("<p>a</p>" + "<!-- " * 100_000 + "<p>b</p>") == ["a"]


def test_query(spark, tmp_path):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = queries.op1_html(spark, str(tmp_path))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in df.collect()) == sorted([(1, TEXT, len(TEXT))] * 2 + [(2, "", 0), (0, "", 0), (3, TEXT, len(TEXT))])
