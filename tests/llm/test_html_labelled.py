"""Precision and recall on pages labelled by hand, written apart from the made
layouts: each page's main text, block by block."""

import pytest
from loanlens.llm import html_extract as H
from loanlens.llm.common import read_table

#: (page, main text)
PAGES = [
    ("""<!doctype html><html><head><title>Harbour news</title><style>p{margin:0}</style></head><body>
<div id="top"><a href="/">Harbour News</a> <a href="/sport">Sport</a> <a href="/town">Town</a> <a href="/sea">Sea</a></div>
<div id="wrap"><h1>Ferry returns after a winter of repairs</h1>
<p>The ferry that links the two banks of the estuary sailed again on Monday after four months in dry dock.</p>
<p>Its captain, who has steered it for nineteen years, said the new engine was quieter than the gulls.</p>
<ul><li>First sailing at six in the morning</li><li>Last sailing at ten at night, later on market days</li></ul>
<p>Fares stay as they were until the summer.</p></div>
<div id="legal">Harbour News, Quay Street 4. All rights reserved.</div></body></html>""",
     ["Ferry returns after a winter of repairs",
      "The ferry that links the two banks of the estuary sailed again on Monday after four months in dry dock.",
      "Its captain, who has steered it for nineteen years, said the new engine was quieter than the gulls.",
      "First sailing at six in the morning", "Last sailing at ten at night, later on market days",
      "Fares stay as they were until the summer."]),
    ("""<html><body><header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Recipes</a></li></ul></nav></header>
<main><section><h2>Bread without a machine</h2><p>Mix the flour and the water with your hands and let them rest for an hour
before the salt goes in.</p><blockquote>Patience does most of the kneading.</blockquote>
<p>Bake it in a covered pot; take the lid off for the last quarter of an hour.</p>
<div class="ad-slot">Sponsored: knives that stay sharp</div>
<pre>500 g flour
350 g water</pre></section>
<section class="comments"><h3>12 comments</h3><p>Lovely, mine came out flat though.</p><p>Try more water!</p></section></main>
<footer><p>Contact us or read our privacy policy.</p></footer></body></html>""",
     ["Bread without a machine",
      "Mix the flour and the water with your hands and let them rest for an hour before the salt goes in.",
      "Patience does most of the kneading.", "Bake it in a covered pot; take the lid off for the last quarter of an hour.",
      "500 g flour 350 g water"]),
    ("""<html><body><table><tr><td class="left"><a href="1">Index</a><br><a href="2">Archive</a><br><a href="3">Links</a></td>
<td class="middle"><h3>Notes on a long walk</h3><p>We set out before the sun and had the ridge to ourselves until noon, when
the first walkers from the valley came up.</p><p>On the far side the path is lost in bracken; follow the wall instead.</p></td>
</tr></table><div class="bottom"><a href="4">Up</a> | <a href="5">Mail</a></div></body></html>""",
     ["Notes on a long walk",
      "We set out before the sun and had the ridge to ourselves until noon, when the first walkers from the valley came up.",
      "On the far side the path is lost in bracken; follow the wall instead."]),
    ("""<html><body><div class="cookie-banner">This site uses cookies. <button>Fine</button></div>
<div class="layout"><div class="story"><h1>Library opens at night</h1><p>From the first of the month the reading room stays
open until midnight, with one librarian and a pot of tea.</p><p>Students had asked for it in a letter with four hundred
names.</p><figure><img src="x.jpg"><figcaption>The reading room at eleven in the evening.</figcaption></figure>
<p>The trial runs until the examinations are over.</p></div>
<aside><h4>Most read</h4><ol><li><a href="a">Bridge closed</a></li><li><a href="b">Goat found</a></li></ol></aside></div>
<form action="/join"><label>Newsletter</label><input name="m"><button>Join</button></form></body></html>""",
     ["Library opens at night",
      "From the first of the month the reading room stays open until midnight, with one librarian and a pot of tea.",
      "Students had asked for it in a letter with four hundred names.", "The reading room at eleven in the evening.",
      "The trial runs until the examinations are over."]),
    ("""<html><body><article><h1>Why the clock ran slow</h1><p>The tower clock lost a minute a day, and nobody could say
why until a boy looked behind the dial.</p><p>A family of swifts had nested there; their straw brushed the pendulum.</p>
<div class="share"><a href="#">Share</a> <a href="#">Print</a></div>
<p>The council has voted to leave the nest, and the minute, where they are.</p></article>
<div class="related"><h3>Related</h3><p><a href="x">Swifts return to the old mill</a></p></div></body></html>""",
     ["Why the clock ran slow",
      "The tower clock lost a minute a day, and nobody could say why until a boy looked behind the dial.",
      "A family of swifts had nested there; their straw brushed the pendulum.",
      "The council has voted to leave the nest, and the minute, where they are."]),
    ("""<html><body><div class="x1"><div class="x2"><a href="/">Start</a><a href="/n">New</a><a href="/o">Old</a></div></div>
<div class="x3"><div class="x4">The orchard keeps forty kinds of apple, most of them without a name that anyone else uses.</div>
<div class="x4">Visitors may taste what has fallen. What hangs is for the press, and the press is for the winter.</div>
<div class="x4">In a good year there is cider for the whole street; in a bad one for the choir alone.</div></div>
<div class="x5"><a href="/i">Imprint</a><a href="/p">Privacy</a></div></body></html>""",
     ["The orchard keeps forty kinds of apple, most of them without a name that anyone else uses.",
      "Visitors may taste what has fallen. What hangs is for the press, and the press is for the winter.",
      "In a good year there is cider for the whole street; in a bad one for the choir alone."]),
]


def precision_and_recall(model):
    """By characters of blocks, over all pages."""
    right = given = wanted = 0
    for (_, want), text in zip(PAGES, model.texts([page for page, _ in PAGES])):
        got = text.split("\n") if text else []
        given += sum(map(len, got))
        wanted += sum(map(len, want))
        for block in want:
            if block in got:
                got.remove(block)
                right += len(block)
    return right / max(1, given), right / wanted


@pytest.fixture(scope="module")
def pages(spark):
    return read_table(spark, "/root/testdata/sf0.01", "pages")


def test_pages_labelled_by_hand(pages):
    precision, recall = precision_and_recall(H.train_model(pages))
    print("with word lists", precision, recall)
    assert precision >= 0.9 and recall >= 0.9


def test_without_the_word_lists(pages, monkeypatch):
    """The features of part names (menu, footer, comments ...) off, in training
    and use: what is left are tags, names as such, amounts and places."""
    monkeypatch.setattr(H, "KIND_OF", {})
    monkeypatch.setattr(H, "KIND_OF_TAG", {})
    precision, recall = precision_and_recall(H.train_model(pages))
    print("without word lists", precision, recall)
    assert precision >= 0.95 and recall >= 0.8
