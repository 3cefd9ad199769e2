import time

import numpy as np
import pytest

from vigil.llm import html


@pytest.fixture(scope="module")
def weights():
    return html.trained()


def test_messages_equal_enumeration():
    import itertools

    import numpy as np

    page = html.Page("<body><div class=ad><p>x</p></div><article><h1>t</h1><p>word</p></article></body>")
    forest = html.Forest([page])
    rnd = np.random.default_rng(1)
    w, pair = rnd.normal(size=html.N_FEATURES), rnd.normal(size=(html.KINDS**2, 2, 2))
    p, _ = forest.pass_messages(w, pair)
    u = np.bincount(forest.owner, w[forest.feature], len(forest.parent))
    total, marginal = 0.0, np.zeros(len(u))
    for y in itertools.product((0, 1), repeat=len(u)):
        s = sum(u[i] * y[i] for i in range(len(u))) + sum(pair[forest.kind[i], y[up], y[i]] for i, up in enumerate(forest.parent) if up >= 0)
        total += np.exp(s)
        marginal += np.exp(s) * np.array(y)
    assert np.allclose(p[:, 1], marginal / total)


def test_held_out_layouts(weights):
    recall, precision = [], []
    for source, good in html.labelled_pages(60, seed=991):
        got = set(html.main_texts([source], weights)[0].split("\n\n")) - {""}
        recall.append(len(got & good) / len(good))
        precision.append(len(got & good) / max(1, len(got)))
    # a page counts as a page, however many blocks it has
    assert sum(recall) / 60 > 0.95 and sum(precision) / 60 > 0.9


def test_article_of_a_whole_page(weights):
    page = "<!DOCTYPE html><title>T</title><style>p{}</style><nav><ul><li><a href=/x>menu</a></ul></nav><!-- ad --><div class='ad'>Buy &amp; go.</div><article><h1>Head line</h1><p><b>First  part<br>goes\non &lt;here&gt;.<p>Second&nbsp;one &eacute;.</p><script>var t='</p>';</script><aside class=related>Other</aside></article><footer>&copy; me</footer>"
    assert html.main_texts([page], weights) == ["Head line\n\nFirst part goes on <here>.\n\nSecond one é."]


@pytest.mark.parametrize("source", ["", "   ", "<", "<p", "</div></p>", '<a href="x', "<!--", "<script>", "<p>" * 5000, "<div>" * 3000 + "x", '<p class="' * 50, "plain text", "<b><i></b>x</i>", "&#0;&#xZZ;&unknown;"])
def test_broken_markup(weights, source):
    assert isinstance(html.main_texts([source], weights)[0], str)


def test_odd_rows(spark, weights):
    pages = spark.createDataFrame([(1, "u", None, "c"), (1, "u", "", "c"), (None, None, "<article><p>Some words stand here, enough for a paragraph of text.</p></article>", None)], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html.extract(pages, weights).collect()), key=str)
    text = "Some words stand here, enough for a paragraph of text."
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, text, len(text))], key=str)
    assert html.extract(pages.limit(0), weights).count() == 0


def test_messages_node_by_node_equal_those_by_levels(monkeypatch):
    rnd = np.random.default_rng(3)
    tags = ["div", "p", "ul", "li", "section", "table"]
    pages = [html.Page("".join(f"<{t}>x y" if rnd.random() < 0.6 else f"</{t}>" for t in rnd.choice(tags, 80))) for _ in range(30)]
    unary, pair = rnd.normal(size=html.N_FEATURES), rnd.normal(size=(html.KINDS * html.KINDS, 2, 2))
    found = []
    for wide in (1, 16, 10**9):
        monkeypatch.setattr(html, "WIDE", wide)
        forest = html.Forest(pages)
        found.append(forest.pass_messages(unary, pair))
        assert sum(map(len, forest.levels)) + len(forest.deep) == len(forest.parent)
    for p, edge in found[1:]:
        assert np.allclose(p, found[0][0]) and np.allclose(edge, found[0][1])


def test_a_deep_page_takes_time_in_proportion():
    unary, pair = np.zeros(html.N_FEATURES), np.zeros((html.KINDS * html.KINDS, 2, 2))
    took = []
    for n in (25_000, 200_000):
        start = time.process_time()
        forest = html.Forest([html.Page("<div>" * n + "<p>text</p>")] + [html.Page("<div><p>a</p></div>")] * 20)
        p, _ = forest.pass_messages(unary, pair)
        took.append(time.process_time() - start)
        assert len(forest.parent) > n and np.allclose(p, 0.5)
    assert took[1] < 24 * took[0]
