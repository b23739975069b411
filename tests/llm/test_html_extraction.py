"""Blocks of pages and their labels: markup cases, gradients by differences, pages and layouts held out."""

import random
import re
import time
from html import unescape

import numpy as np
import pytest
from vecflow.llm import block_labeller as L
from vecflow.llm.html_blocks import leaf_blocks

FOUR = "/root/testdata/sf0.01"
PROSE = ["The council met on Tuesday to discuss the new bridge, which has been planned for many years.", "Engineers said that the river bed is softer than expected; work may begin in spring.", "Residents fear that traffic will grow. The mayor promised that it would not."]
WORDPRESS = f"""<!DOCTYPE html><html><head><title>Bridge</title><script>var x = "<p>no</p>";</script></head><body class="home single-post">
<a class="skip-link" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><div class="site-branding"><a href="/">The River Post</a></div>
<nav class="main-navigation"><ul><li><a href="/">Home<li><a href="/news">News</ul></nav></header>
<div id="content" class="site-content"><article class="post entry"><header class="entry-header"><h1 class="entry-title">A new bridge</h1></header>
<div class="entry-content"><p>{PROSE[0]}<p>{PROSE[1].replace("; ", " &amp;<b>also</b>; ")}</p><div class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a></div><p>{PROSE[2]}</p></div></article>
<div id="comments" class="comments-area"><h2>2 comments</h2><ol class="comment-list"><li class="comment"><cite>anna</cite><p>I am glad that the bridge is built at last, it took them very long.</p></li></ol>
<form class="comment-form"><label>Name</label><textarea>say &lt; it</textarea><button>Send</button></form></div></div>
<aside id="secondary" class="widget-area"><section class="widget"><h3>Most read</h3><ul><li><a href="/a">Mayor resigns</a></li></ul></section></aside>
<div class="cookie-notice">We use cookies to improve your experience.</div><footer class="site-footer"><p>Copyright 2024 The River Post</p></footer></body></html>"""
TABLE = f"""<html><body><table><tr><td class="menu"><a href=a>Home</a><br><a href=b>Contact</a><td class="content"><h1>A new bridge</h1>{PROSE[0]}<p>{PROSE[1]}<p>{PROSE[2]}<td class="ads">Buy now and save 50%</table><div class="footer">All rights reserved.</div>"""
BARE = f"<p>{PROSE[0]}</p><p>{PROSE[1]}</p><p>{PROSE[2]}</p>"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(f"{FOUR}/pages.parquet"))


def texts(html):
    return [b.text for b in leaf_blocks(html)]


def test_markup():
    assert texts("a<p>b <i>c</i>d<p>e&nbsp;&lt; f\n\n g<br>h") == ["a", "b cd", "e < f g h"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"]
    assert texts("<script>a<p>b</script>c<style>d</style><!-- e > f --><title>t</title>g") == ["cg"]
    assert texts("<head><title>x</title></head><body>y") == ["y"] and texts("<head><meta><body>y") == ["y"]
    assert texts("a < b > c <3 d") == ["a < b > c <3 d"] and texts("a<p class='x>y'>b</p x>c") == ["a", "b", "c"]
    assert texts("a<!-->b<!doctype x>c<?php d ?>e</>f") == ["abcef"]
    assert texts("<p>a<span>b</p>c</span>d") == ["ab", "cd"] and texts("a<p>b</div>c") == ["a", "bc"]
    assert texts(None) == texts("") == texts(" \n ") == texts("<p></p>") == [] and texts("a<p>b<p c") == ["a", "b"]
    assert texts("<noscript>a</noscript><template>b</template>c<script>d") == ["c"] and texts("<p =\"x>a") == ["a"]
    path = leaf_blocks('<div class="siteHeader main-news" id=Top hidden><p>x')[0].path
    assert path == ("<div>", "site", "header", "main", "new", "top", "(hidden)", "<p>")
    assert [b.linked for b in leaf_blocks("<p>ab <a href=x>cde</a> f")] == [3]


@pytest.mark.parametrize("part", ["<a ", '<a ="', "<!--", "<div>", "<p><b>", "</p>", "<li>x", '<a x="<b', "&#", "<", "<td>x</td></b>", "<a><div>x</a>"])
def test_broken_markup_is_read_in_linear_time(part):
    began = time.time()
    leaf_blocks(part * (400_000 // len(part)) + ">x")
    assert time.time() - began < 30


def test_gradients():
    model, r = L.Labeller(1), np.random.default_rng(0)
    model.w = {k: x.astype(np.float64) for k, x in model.w.items()}
    x, mask, y = r.normal(size=(5, 3, L.INPUTS)), np.ones((5, 3)), (r.random((5, 3)) > 0.5) * 1.0
    mask[3:, 1] = mask[2:, 2] = 0
    _, grads, dx = model.gradients(x, mask, y)
    for values, g in [*((model.w[k], v) for k, v in grads.items()), (x, dx)]:
        flat, g = values.reshape(-1), g.reshape(-1)
        for i in r.integers(0, len(flat), 4):
            own, sides = flat[i], []
            for flat[i] in (own + 1e-5, own - 1e-5):
                sides.append(model.gradients(x, mask, y)[0])
            flat[i] = own
            assert abs((sides[0] - sides[1]) / 2e-5 - g[i]) < 1e-6


def test_batches_and_padding_do_not_show(model, spark, monkeypatch):
    pages = [L.features(leaf_blocks(x.html)) for x in spark.read.parquet(f"{FOUR}/pages.parquet").limit(60).collect()] + [L.features([])]
    together = model.main_blocks(pages)
    monkeypatch.setattr(L, "CELLS", 1)
    assert all((a == b).all() for a, b in zip(together, model.main_blocks(pages)))


def test_given_pages_held_out(spark, model):
    """All pages of a larger table, of which the model saw none or few."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    got = L.main_texts(model, [x.html for x in rows])
    want = [" ".join(unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", x.html, re.S)[1])).split()) for x in rows]
    assert sum(a != b for a, b in zip(got, want)) <= len(rows) // 1000


def test_layouts_held_out(spark, model):
    r = random.Random(99)
    read = [leaf_blocks(x.html) for x in spark.read.parquet(f"{FOUR}/pages.parquet").collect()]
    articles = [[b.text for b, k in zip(x, L.known_labels(x)) if k] for x in read]
    made = [L.arranged(r, r.choice(articles)[:20], [b.text for x in read for b in x if len(b.text.split()) > 4]) for _ in range(300)]
    got = model.main_blocks([L.features(b) for b, _ in made])
    wrong = sum((a != y).sum() for a, (_, y) in zip(got, made))
    assert wrong < 0.01 * sum(len(y) for _, y in made)


def test_pages_by_hand(model):
    got = L.main_texts(model, [WORDPRESS, TABLE, BARE, None, "", "<nav>Home</nav>"])
    assert got[0] == f"A new bridge {PROSE[0]} {PROSE[1].replace('; ', ' &also; ')} {PROSE[2]}"
    assert got[1] == f"A new bridge {' '.join(PROSE)}" and got[2] == " ".join(PROSE)
    assert got[3] == got[4] == got[5] == ""


def test_odd_tables(spark, model):
    schema = "page_id int, url string, html string, text string, n_chars string"
    rows = [(1, None, WORDPRESS, "x", "y"), (1, "u", None, None, None), (None, "u", BARE, "z", None)]
    got = L.extracted(spark.createDataFrame(rows, schema), model).collect()
    assert sorted((x.page_id or 0, x.n_chars) for x in got) == sorted([(1, len(L.main_texts(model, [WORDPRESS])[0])), (1, 0), (0, len(" ".join(PROSE)))])
    empty = spark.createDataFrame([], schema)
    assert L.extracted(empty, L.fit(empty)).collect() == []
    assert L.fit(spark.createDataFrame(rows[:1], schema), epochs=1).w["out"].any()
