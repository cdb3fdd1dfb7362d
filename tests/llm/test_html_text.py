import itertools
import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillon.llm import html_text
from quillon.llm.common import read_table


def plain_article(html):
    """The article of the given tables' layout."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = html_text.extract(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text == plain_article(html[r.page_id]) and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return html_text.train(read_table(spark, sf_dir, "pages"))


HAND = [
    ("<html><body><div id='top-nav'><a href='/'>Home</a> <a href='/b'>Blog</a></div><div class='post-content'><h2>Baking &amp; bread</h2><p>Mix the flour,\n water and&nbsp;salt. Wait an hour.</p>"
     "<p>Bake it at 230 degrees for forty minutes, then let it cool.</p></div><div class='sidebar'><h3>Popular</h3><ul><li><a href='#'>Ten cakes</a></li></ul></div>"
     "<div id='comments'><p>Great recipe, I made it twice this week!</p></div><footer>&copy; 2024 Bakers</footer></body></html>",
     "Baking & bread\n\nMix the flour, water and salt. Wait an hour.\n\nBake it at 230 degrees for forty minutes, then let it cool."),
    ("<body><header><p>The Daily Paper, since 1901.</p></header><main><article><h1>Storm</h1><p>It rained all night<br>and the river rose.<p>Nobody was hurt, officials said on Monday.</article>"
     "<aside><p>Subscribe to our weekly letter for more stories like this one.</p></aside></main><script>if (a < b) { x = '<p>no</p>' }</script></body>",
     "Storm\n\nIt rained all night and the river rose.\n\nNobody was hurt, officials said on Monday."),
]


@pytest.mark.parametrize(("html", "text"), HAND)
def test_other_layouts(model, html, text):
    assert html_text.main_texts(model, [html]) == [text]


def test_held_out_accuracy_on_layouts(model):
    """Texts and orders of blocks that training has not seen."""
    content = [f"Paragraph number {k} tells of things that happened, and of those that did not; it goes on." for k in range(8)]
    other = ["Start", "Archive page", "Follow", "Cheap shoes are here, order now.", "Some company."]
    wrong = total = 0
    for seed in range(1000, 1100):
        tree = html_text.parse(html_text.layout(["A heading", *content], other, seed))
        p, _ = html_text.sum_product(html_text.Forest([tree]), model)
        for text, y, q in zip(tree.texts, tree.labels, p, strict=True):
            if text:
                total += 1
                wrong += (q >= 0.5) != bool(y)
    assert wrong / total < 0.03


def test_messages_against_all_labelings():
    trees = [html_text.parse("<div><p>one two</p><ul><li>a</li><li>b</li></ul></div>"), html_text.parse("<p>x</p>")]
    rng = np.random.default_rng(2)
    model = html_text.Model(rng.normal(size=html_text.N_FEATURES), rng.normal(size=(2, 2)))
    forest = html_text.Forest(trees)
    (got, pairs), score = html_text.sum_product(forest, model), forest.features @ model.unary
    expected = np.zeros((2, 2))
    for tree, s in zip(trees, forest.start, strict=True):
        n = len(tree.parent)
        weight, moved = np.zeros(n), np.zeros((2, 2))
        total = 0.0
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(score[s + i] * y[i] for i in range(n)) + sum(model.edge[y[tree.parent[i]], y[i]] for i in range(1, n)))
            total += p
            weight += p * np.array(y)
            for i in range(1, n):
                moved[y[tree.parent[i]], y[i]] += p
        assert np.allclose(got[s : s + n], weight / total)
        expected += moved / total
    assert np.allclose(pairs, expected)


def test_edges(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words"), (None, "u", "<p"), (4, "u", "<div>" * 3000 + "deep"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "<p>&#65;&am &lt;b&gt;</p><!-- x -->"), (6, "u", "<p>w w. " * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert html_text.extract(pages.limit(0)).count() == 0
