"""Main text: hostile pages in linear time, whole blocks, and pages written by hand; labels against all labellings."""

import itertools
import time

import numpy as np
import pytest

from weirflow.llm import crf, html_crf


@pytest.fixture(scope="module")
def model():
    return html_crf.fit(html_crf.labelled_pages(html_crf.TRAIN_PAGES, html_crf.SEED))


HOSTILE = {
    "nested": "<div>" * 200_000, "open tags": "<a " * 350_000, "a sign before": "> x" + "<a " * 350_000, "inline": "<span>" * 150_000 + "<p>x" * 20_000,
    "headings": "<h1>x" * 60_000, "end tags of nothing": "<div>" * 80_000 + "</x>" * 80_000, "ends inside": "<b>" * 80_000 + "</i>" * 80_000 + "<p>x</b>" * 40_000,
    "elements that never end": "<span/>" * 150_000, "lists": "<ul><li>x" * 40_000, "names": '<div class="' + " ".join(f"n{i}" for i in range(100_000)) + '">x',
    "a name each": "".join(f"<div class=k{i}>x" for i in range(40_000)), "quotes": '<a "' * 250_000 + ">", "comments": "<!--" * 250_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_time_is_linear(model, kind):
    page = HOSTILE[kind]
    start = time.process_time()
    html_crf.main_texts([page], model)
    assert time.process_time() - start < 20  # walking the stack takes many minutes here


def test_nested_blocks_keep_their_order_and_nearest_block():
    found = html_crf.blocks("<div>a<section><b>b<i>c<p>d<h2>e</section>f</div>g</p>h")
    assert [(b.text, b.tag) for b in found] == [("a", "div"), ("bc", "section"), ("d", "p"), ("e", "h2"), ("f", "div"), ("g", "body"), ("h", "body")]
    assert found[2].path == {"in=div", "in=section", "in=p"} and found[5].path == set()
    assert [b.text for b in html_crf.blocks("one<!-- two > three")] == ["one"]
    assert [b.text for b in html_crf.blocks("one <!-- two > three <p>")] == ["one"]
    assert [b.text for b in html_crf.blocks("<p>x > 1 and <a")] == ["x > 1 and <a"]


def test_phrases_count_anywhere_in_a_block():
    long = html_crf.Block("p", frozenset(), "word " * 500 + "all rights reserved.", 0)
    assert "says" in html_crf.block_features(long)


def test_scores_take_all_features(model):
    known, chain = model
    deep = "".join(f'<div class="{c}">' for c in ["nav menu", "sidebar widget", "content post", "footer legal", "comment reply"] * 3) + "<p>some text of a page.</p>"
    items = html_crf.blocks(deep, known)
    ids = html_crf._ids(html_crf.context_features(items), known, 200)
    assert np.allclose(html_crf._scores(items, known, chain, {}), chain.emissions(ids))


PAGES = [
    ("""<html><head><title>t</title></head><body><div id="wrap"><div class="menu-main"><a href="/">Start</a> <a href="/n">News</a></div>
  <main><h1>Harvest begins early</h1><p>After a warm spring the growers of the valley have begun to pick apples two weeks before the usual date.</p>
  <p>Prices are expected to stay <b>flat</b>, said the head of the cooperative on Monday.</p></main>
  <footer>&copy; The Valley Paper</footer></div></body></html>""",
     ["Harvest begins early", "After a warm spring the growers of the valley have begun to pick apples two weeks before the usual date.",
      "Prices are expected to stay flat, said the head of the cooperative on Monday."]),
    ("""<body><nav><ul><li><a href=a>Home</a><li><a href=b>Shop</a></ul></nav><article><h1>How to sharpen a knife</h1>
  <p>Wet the stone and hold the blade at a steady angle while you draw it towards you.<p>Turn it over after ten strokes and repeat.
  <ul><li>Do not press hard, as this bends the edge.</li><li>Clean the stone with water when you are done.</li></ul></article>
  <aside><h3>Related</h3><ul><li><a href=c>Ten pans</a></ul></aside><div class="cookie-banner"><p>We use cookies to improve your visit.</p></div></body>""",
     ["How to sharpen a knife", "Wet the stone and hold the blade at a steady angle while you draw it towards you.", "Turn it over after ten strokes and repeat.",
      "Do not press hard, as this bends the edge.", "Clean the stone with water when you are done."]),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_pages_written_by_hand(model, page, want):
    assert html_crf.main_texts([page], model)[0].split("\n\n") == want


def test_labels_are_the_best_of_all():
    r = np.random.default_rng(3)
    for states in (2, 3):
        chain = crf.Chain(r.normal(size=(9, states)), r.normal(size=(states, states)), r.normal(size=states), r.normal(size=states))
        lengths = np.array([3, 0, 7, 1, 5, 1, 6 if states == 2 else 4])
        ids = r.integers(0, 10, (int(lengths.sum()), 3))
        got, scores, at = chain.decode(ids, lengths), chain.emissions(ids), 0
        for n in lengths:
            e = scores[at:at + n]
            best = max(itertools.product(range(states), repeat=int(n)), key=lambda y: chain.start[y[0]] + chain.end[y[-1]] + sum(e[t][k] for t, k in enumerate(y))
                       + sum(chain.step[a, b] for a, b in itertools.pairwise(y))) if n else ()
            assert tuple(got[at:at + n]) == best
            at += n
    assert len(chain.decode(np.zeros((0, 3), int), np.array([0]))) == 0
