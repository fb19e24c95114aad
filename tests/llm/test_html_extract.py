import itertools
import random
import time

import numpy as np
import pytest
from loanlens.llm import html_extract as H
from loanlens.llm.common import read_table
from loanlens.llm.html_tree import parse
from loanlens.llm.tree_model import Forest, marginals, train

PAGES = "page_id long, url string, html string"


def brute(parents, scores, edge):
    """Marginals, pair counts and log partition function by enumeration."""
    n = len(parents)
    one, pairs, z = np.zeros(n), np.zeros((2, 2)), 0.0
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(scores[k] for k in range(n) if y[k]) + sum(edge[y[p], y[k]] for k, p in enumerate(parents) if p >= 0))
        z += w
        one += w * np.array(y)
        for k, p in enumerate(parents):
            if p >= 0:
                pairs[y[p], y[k]] += w
    return one / z, pairs / z, np.log(z)


def test_sum_product_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = rng.integers(1, 9)
        parents = np.array([-1 if k == 0 or rng.random() < 0.15 else rng.integers(0, k) for k in range(n)])
        scores, edge = rng.normal(0, 2, n), rng.normal(0, 2, (2, 2))
        for got, want in zip(marginals(Forest(parents, [[] for _ in parents]), scores, edge), brute(parents, scores, edge)):
            assert np.allclose(got, want)


def test_training_reaches_the_gradients_zero():
    rng = np.random.default_rng(2)
    parents = np.array([-1, 0, 0, 1, 1, 2, -1, 6, 6, 7])
    features = [[0, int(rng.integers(1, 4))] for _ in parents]
    labels = rng.integers(0, 2, len(parents))
    forest = Forest(parents, features)
    weights, edge = train(forest, labels, 4, steps=3000, rate=0.02, penalty=0.1)
    one, pairs, _ = marginals(forest, forest.scores(weights), edge)
    gradient = np.bincount(forest.columns, weights=(labels - one)[forest.rows], minlength=4) - 0.1 * weights
    assert np.abs(gradient).max() < 1e-2


@pytest.mark.parametrize("source, blocks", [
    ("", []), ("plain &amp; simple", ["plain & simple"]),
    ("<p>one<p>two <b>bold</b> x<br>y", ["one", "two bold x y"]),
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
    ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", ["yes"]),
    ("<div title='a > b'>in</div>", ["in"]),
    ("<p>cut &am", ["cut &am"]), ("<p>cut <a hre", ["cut"]), ("</p></div>x", ["x"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ('<p>a</p><svg class="i"/><p>rest</p>', ["a", "rest"]), ("<p>a <svg/> b</p><p>c</p>", ["a b", "c"]),
    ("<p>a</p><svg a='x>y'\nb=\"/>\"/><p>b</p><svg c='/>'><text>no</text></svg><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><svg-icon name='x'></svg-icon><p>b</p>", ["a", "b"]),
    ("<template-x><p>a</p></template-x><style-y/><p>b</p><svg><g/>no</svg >c", ["a", "b", "c"]),
    ("<script>no</script\n>a<script src=x/>no</script><SVG\tid=i>no</SVG>b", ["ab"]),
    ("<p>a&nbsp;\n\t b&#233;&copy</p>", ["a bé©"]), ("a < b <p>c", ["a < b", "c"]),
])
def test_blocks(source, blocks):
    assert [t for _, t in parse(source).blocks] == blocks


@pytest.fixture(scope="module")
def model(spark):
    return H.train_model(read_table(spark, "/root/testdata/sf0.01", "pages"))


def test_made_layouts_that_training_has_not_seen(spark, model):
    rng = random.Random(99)
    sources = [r.html for r in read_table(spark, "/root/testdata/sf0.1", "pages").where("page_id >= 300").limit(100).collect()]
    texts = [t for s in sources for _, t in parse(s).blocks]
    wrong = total = 0
    for _ in range(200):
        page, labels = H.labelled_layout(H.layout(rng, [rng.choice(texts) for _ in range(rng.randint(1, 9))], texts))
        one = model.content([page])[0]
        wrong += sum((one[n] >= 0.5) != bool(labels[n]) for n, _ in page.blocks)
        total += len(page.blocks)
    assert wrong < 0.02 * total


def test_pages_with_an_article_element(spark, model):
    pages = read_table(spark, "/root/testdata/sf0.1", "pages").where("page_id >= 300").limit(300)
    for r in H.extract(pages, model).collect():
        page = parse(next(iter([r.text])))  # markup is gone
        assert not any(n.tag != "page" for n in page.nodes)
    for r in pages.collect():
        page = parse(r.html)
        labels = H.article_labels(page)
        assert model.texts([r.html]) == ["\n".join(t for n, t in page.blocks if labels[n])]


def test_parts_of_a_page(model):
    page = """<html><head><title>T</title></head><body><div class="site-header"><p>My site</p></div>
    <ul class="menu"><li><a href=/>Home</a><li><a href=/x>More</a></ul><div id="cookie-notice">We use cookies.</div>
    <div class="post"><h1>The river</h1><p>The river rose in the night, and nobody slept.</p>
    <div class="advert">Buy boots now.</div><p>By noon the road was under water &amp; closed.</p>
    <div class="comments"><p>first! a nice post, I like it.</p></div></div>
    <form><p>Your e-mail</p><button>Join</button></form><div class="footer">&copy; us</div></body></html>"""
    assert model.texts([page]) == [
        "The river\nThe river rose in the night, and nobody slept.\nBy noon the road was under water & closed."]


def test_an_icon_before_the_article_and_in_it(model):
    page = """<html><head><title>T</title></head><body><ul class="menu"><li><a href=/><svg class="i"/>Home</a></ul>
    <svg-icon name="pen"></svg-icon><article><h1>The river</h1><p>The river rose in the night, and nobody slept.</p>
    <svg class="rule"/><p>By noon the road was under water and closed.</p></article></body></html>"""
    assert model.texts([page]) == [
        "The river\nThe river rose in the night, and nobody slept.\nBy noon the road was under water and closed."]


@pytest.mark.parametrize("n", [5, 15, 34, 35, 200, 5000])
def test_pages_cut_off_inside_a_tag(n):
    cut = "<p>The river rose.</p><div " + " ".join(f'a{k}="v{k}"' for k in range(n))
    for tail in ("", ' b="', " b='x", "=", '"' * n, "'" * n, '"\'' * n):
        start = time.process_time()
        page = parse(cut + tail)
        assert [text for _, text in page.blocks] == ["The river rose."]
        assert time.process_time() - start < 2


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\">", "<a \"'>'", '<svg "', "<svg ", "<script ", "</div ", "<!--",
                                   "<!x", "<div>", "<li></li></y>", "<x><li></li>", '<a "><b \'>', "<", "<a='"])
def test_a_megabyte_of_unfinished_markup(piece):
    start = time.process_time()
    page = parse("<p>The river rose.</p>" + piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 10
    assert page.blocks[0][1] == "The river rose."


def test_quotes_in_tags():
    texts = lambda source: [text for _, text in parse(source).blocks]
    assert texts('<p title="a > b">one</p>two') == ["one", "two"]
    assert texts("<p title='it\"s > b'>one</p>two") == ["one", "two"]
    assert texts('<p title=5">one</p>two') == ["one", "two"]  # no partner: a character as any other
    assert texts('<p title="5>one</p>two') == ["one", "two"]
    assert texts('<p title="5>one</p><p title="6">two</p>') == ["two"]  # the partner is in the next tag
    assert texts("<script>if (a < b) '</p>'</script>one<SVG><g>x</g></svg >two") == ["onetwo"]


def test_trees_of_odd_markup():
    def tree(source):
        return [(n.tag, n.parent) for n in parse(source).nodes[1:]]
    assert tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [
        ("ul", 0), ("li", 1), ("li", 1), ("ul", 3), ("li", 4), ("li", 1)]
    assert tree("<table><tr><td>a<td>b<tr><th>c</table><p>x<div>y") == [
        ("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 2), ("th", 5), ("p", 0), ("div", 0)]
    assert tree("<div></p></div></div><dl><dt>a<dd>b<dt>c") == [
        ("div", 0), ("dl", 0), ("dt", 2), ("dd", 2), ("dt", 2)]


def test_query_on_odd_rows(spark, model, clashing):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (2, None, ""),
            (5, "u", "<article>" + "<p>long text here.</p>" * 5000 + "</article>"), (6, "u", "<div>" * 3000 + "deep")]
    got = H.extract(clashing(spark.createDataFrame(rows, PAGES)), model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[5].text == "\n".join(["long text here."] * 5000) and by[5].n_chars == len(by[5].text)
    assert by[1].text == "" and by[1].n_chars == 0 and by[2].url is None
    empty = spark.createDataFrame([], PAGES)
    assert H.extract(empty, H.train_model(empty)).count() == 0
