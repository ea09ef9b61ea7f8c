"""Pages put together at random around a known article, broken markup, long pages."""

import random
import time

import pytest

from tripleflow.llm import html_extract
from tripleflow.llm.html_extract import main_blocks

WORDS = "river stone, market early, winter paper window, garden yellow seven, letter music answer, number".split()
def site_header(t):  # inside an article, a header is the article's own
    return f"<header class='masthead'><p>{t}</p></header>"


# Parts that are not of the article, with text of any length.
AROUND = [
    lambda t: f"<nav><ul><li><a href='/'>{t}</a></li><li>{t}</li></ul></nav>",
    site_header,
    lambda t: f"<footer><p>{t}</p><p>{t}</p></footer>",
    lambda t: f"<aside><h3>{t}</h3><p>{t}</p></aside>",
    lambda t: f'<div class="ad-slot"><p>{t}</p></div>',
    lambda t: f'<div id="sidebar"><p>{t}</p><p>{t}</p></div>',
    lambda t: f'<div class="cookie-notice" role="dialog"><p>{t}</p></div>',
    lambda t: f"<form action='/go'><p>{t}</p><input name=q><button>{t}</button></form>",
    lambda t: f"<script>var s = '<p>{t}</p>';</script><style>p {{ color: red }}</style>",
    lambda t: f"<!-- <p>{t}</p> --><noscript><p>{t}</p></noscript>",
    lambda t: f'<section class="comments"><article><p>{t}</p></article><div class="comment-body">{t}</div></section>',
    lambda t: f'<div class="share-buttons"><a href="/s">{t}</a></div>',
    lambda t: f'<div style="display: none"><p>{t}</p></div>',
    lambda t: f'<ul class="related-links"><li><a href="/x">{t}</a></li></ul>',
]
# How a block of the article may be written; the text is the same.
BLOCKS = [
    lambda t: f"<p>{t}</p>",
    lambda t: f"<p>{t}",
    lambda t: f"<h2>{t}</h2>",
    lambda t: f"<blockquote><p>{t}</p></blockquote>",
    lambda t: f'<div class="share-price"><p>{t}</p></div>',
    lambda t: f'<section id="search-results"><p>{t}</p></section>',
    lambda t: f'<div title="hidden form, an ad"><p>{t}</p></div>',
    lambda t: f"<ul><li>{t}</ul>",
    lambda t: f"<p>{t.replace(' ', '  <b> </b>', 1)}</p>",
    lambda t: f"<table><tr><td>{t}</table>",
    lambda t: f"<i><p>{t}</i>",
]
AROUND_ALL = [
    lambda body: f"<article>{body}</article>",
    lambda body: f"<main><article class='post promo'>{body}</article></main>",
    lambda body: f'<div class="page with-sidebar"><div id="content">{body}</div></div>',
    lambda body: f"<form id=whole><div class='main-content'>{body}</div></form>",
]


def _text(rng, least=12):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(least, 40))).strip(",")


@pytest.mark.parametrize("seed", range(400))
def test_the_article_and_nothing_else(seed):
    rng = random.Random(seed)
    wanted = [_text(rng) for _ in range(rng.randrange(4, 9))]
    body = ""
    for k, text in enumerate(wanted):
        body += rng.choice(BLOCKS[:3] if k < 2 else BLOCKS)(text)
        if rng.random() < 0.3:
            body += rng.choice([a for a in AROUND if a is not site_header])(_text(rng))
    parts = [rng.choice(AROUND)(_text(rng)) for _ in range(rng.randrange(0, 6))]
    cut = rng.randrange(len(parts) + 1)
    page = "<html><body>" + "".join(parts[:cut]) + AROUND_ALL[seed % len(AROUND_ALL)](body) + "".join(parts[cut:])
    assert main_blocks(page) == wanted, page


def test_attributes_are_read_as_such():
    page = "<article><p>One sentence, and more.</p><p data-id='ad' alt=\"hidden\">Two, as long.</p><p hidden>Three</p></article>"
    assert main_blocks(page) == ["One sentence, and more.", "Two, as long."]


def test_a_list_of_links_called_article_is_not_the_text():
    links = "".join(f"<li><a href='/{i}'>a headline of some length, number {i}</a></li>" for i in range(30))
    text = "A long paragraph, with commas, and words, that is the text of this page, for sure."
    assert main_blocks(f"<article><ul>{links}</ul><div><p>{text}</p></div></article>") == [text]


BROKEN = {
    "open inline": lambda n: "<b>" * n + "<p>x</p>" * n,
    "unmatched end": lambda n: "<div>" * n + "</i>" * n,
    "open tag": lambda n: '<a x="' * n,
    "quotes": lambda n: "<a '>'" * n + '"',
    "items in blocks": lambda n: "<div>" * n + "<li>x</li>" * n,
    "items in lists": lambda n: "<ul><li>" * n + "</ol>" * n,
    "blocks in links": lambda n: "<a><div>x</a>" * n,
    "cells": lambda n: "<table><td><tr>x" * n,
    "comments": lambda n: "<!--" * n + ">",
    "ends": lambda n: "</" * n + ">" + "<script" * n,
    "references": lambda n: "&amp" * n + "&#" * n,
}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_pages_take_linear_time(kind):
    def seconds(n):
        start = time.process_time()
        main_blocks(BROKEN[kind](n))
        return time.process_time() - start

    seconds(1000)
    assert seconds(32_000) < 0.5 + 5 * 4 * seconds(8000)


def test_an_empty_table_and_a_long_page(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert html_extract.extract(spark.createDataFrame([], schema)).collect() == []
    paragraph = "a line of text, and some more of it, "
    page = "<article>" + f"<p>{paragraph * 3}</p>" * 30_000 + "</article>"
    (row,) = html_extract.extract(spark.createDataFrame([(1, "u", page, "x", 0)], schema)).collect()
    assert row.text == "\n".join([(paragraph * 3).strip()] * 30_000) and row.n_chars == len(row.text)
