"""Pages written by hand, none of them like those that the model learns from."""

import pytest

from tessera.llm import html_extract

BLOG = """<!DOCTYPE html><html lang=en><head><title>Rivers - My blog</title><link rel=stylesheet href=x.css></head>
<body class="single post-template"><div id="page" class="site"><a class="skip-link" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><p class="site-title"><a href="/">My blog</a></p>
<nav id="site-navigation" class="main-navigation"><ul><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li><li><a href="/x">Archive</a></li></ul></nav></header>
<main id="primary" class="site-main"><article id="post-12" class="post-12 post type-post"><h1 class="entry-title">How rivers bend</h1>
<div class="entry-content"><p>Water on the outside of a bend runs faster, and it takes the bank with it.</p>
<p>On the inside it runs slowly. Sand settles there, and the bend grows.</p><h2>What stops it</h2>
<p>At some point the neck is so narrow that a flood cuts through.</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><div class="comment-body"><p>Great read, thank you!</p></div></li></ol></div></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly made by hand. Copyright 2020.</div></footer></div></body></html>"""

PAPER = """<html><body><div class="content"><h1>Notes on sorting</h1>
<section class="introduction"><h2>1 Introduction</h2><p>Sorting is old, and still there is something to say about it.</p></section>
<section class="related-work"><h2>2 Related work</h2><p>Others have looked at merging, which we leave aside.</p><p>Nav bar words, in prose.</p></section>
<div class="text-ads-review"><p>We read a hundred adverts, and sorted them by length.</p></div>
<section id="references"><h2>References</h2><p>A. Author, On order, 1970.</p></section></div></body></html>"""

NEWS = """<body><div class="cookie-banner" role="dialog"><p>We use cookies to improve this site. Do you agree?</p><button>Yes</button></div>
<div class="topbar"><a href=/login>Log in</a> <a href=/sub>Subscribe</a></div>
<nav role=navigation><a href=/w>World</a><a href=/s>Sport</a><a href=/m>Money</a></nav>
<article><header><h1>Bridge opens after ten years</h1></header><p>The bridge was opened on Monday, ten years late.</p>
<div class="advertisement"><p>Buy two, get one free!</p></div><figure><img src=b.jpg><figcaption>The new bridge at dawn.</figcaption></figure>
<p>“It is a good bridge,” said the mayor, who cut the ribbon.</p></article>
<div class="newsletter-signup"><h3>Get our newsletter</h3><form><input type=email><p>We never share your address.</p></form></div>
<section class="related-articles-list"><h3>Related</h3><ul><li><a href=/1>Old bridge closes</a></li><li><a href=/2>River floods</a></li></ul></section>
<footer><p>All rights reserved. Imprint and contact.</p></footer></body>"""

RECIPE = """<main><h1>Bread</h1><p>This makes one loaf.</p><ul><li>500 g of flour</li><li>7 g of yeast</li></ul><ol><li>Mix the flour, yeast and water.</li><li>Wait for an hour.</li><li>Bake until it sounds hollow.</li></ol>
<table><tr><th>Time</th><td>two hours</td></tr></table></main><div class="share-buttons"><a href=/f>Share</a><a href=/t>Post</a></div>"""


def blocks(page):
    return html_extract.main_blocks(page, html_extract.MODEL)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (BLOG, ["How rivers bend", "Water on the outside of a bend runs faster, and it takes the bank with it.", "On the inside it runs slowly. Sand settles there, and the bend grows.", "What stops it", "At some point the neck is so narrow that a flood cuts through."]),
        (PAPER, ["Notes on sorting", "1 Introduction", "Sorting is old, and still there is something to say about it.", "2 Related work", "Others have looked at merging, which we leave aside.", "Nav bar words, in prose.", "We read a hundred adverts, and sorted them by length.", "References", "A. Author, On order, 1970."]),
        (NEWS, ["Bridge opens after ten years", "The bridge was opened on Monday, ten years late.", "The new bridge at dawn.", "“It is a good bridge,” said the mayor, who cut the ribbon."]),
        (RECIPE, ["Bread", "This makes one loaf.", "500 g of flour", "7 g of yeast", "Mix the flour, yeast and water.", "Wait for an hour.", "Bake until it sounds hollow.", "Time", "two hours"]),
    ],
    ids=["blog", "paper", "news", "recipe"],
)
def test_pages_of_other_makes(page, want):
    assert blocks(page) == want


def test_names_are_weak_signs():
    assert blocks('<article><h1>Title of it</h1><div class="text-ads-review"><p>First, a sentence.</p></div><section class="related-work"><p>Nav bar words, in prose.</p></section></article>') == ["Title of it", "First, a sentence.", "Nav bar words, in prose."]
    assert html_extract._marks(' class="related-work"')[0] == (html_extract._WEAK,)
    assert html_extract._marks(' class="x cookie-notice"')[0] == html_extract._marks(" id=siteFooter2")[0] == (html_extract._BAD,)


def test_kept_weights_are_those_of_training():
    weights, pair = html_extract.train()
    assert html_extract.MODEL[0] == pytest.approx(weights, abs=1e-4) and [x for p in html_extract.MODEL[1] for x in p] == pytest.approx([x for p in pair for x in p], rel=1e-4)


def test_query_against_plain_pages(spark, sf):
    """Every page of the table: the article's own blocks, read from its markup by another parser."""
    import re
    from html import unescape

    from tessera.llm import queries

    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op8_html_text(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        article = re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>|<div class=.ad.>.*?</div>", "", article, flags=re.S)
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        text = "\n\n".join(p for p in parts if p)
        assert got[r.page_id] == (text, len(text)), r.page_id
