"""Main text of pages of many shapes; weights fitted to pages whose text is known."""

from __future__ import annotations

import pytest

from earthworks.llm import html_extract
from tests.llm.test_models import gold

# ruff: noqa: E501
P = "A long enough paragraph of words that tells something about the matter at hand."
Q = "Another paragraph follows it with more words, so that the page has some prose."
CASES = {
    "layout": (
        f'<body><div class="layout has-sidebar"><h1>Title</h1><p>{P}</p><p>{Q}</p><div class="sidebar"><p>Latest things to read on this site today</p></div></div></body>',
        f"Title\n{P}\n{Q}"),
    "layout2": (
        f'<body><div class="layout-sidebar"><div><h1>Title</h1><p>{P}</p><p>{Q}</p></div><div class="sidebar"><p>Latest things</p></div></div></body>',
        f"Title\n{P}\n{Q}"),
    "share": (
        f'<body><nav><a href=1>Home</a></nav><div class="research-share"><p>{P}</p><p>{Q}</p></div></body>',
        f"{P}\n{Q}"),
    "privacy": (
        f'<main><section class="privacy"><h1>Privacy</h1><p>{P}</p><p>{Q}</p></section></main><footer>c</footer>',
        f"Privacy\n{P}\n{Q}"),
    "entry": (
        f'<div class="entry"><div class="entry-header"><h1>The title</h1></div><p>{P}</p><p>{Q}</p><div class="entry-footer">Tags: a, b</div></div>',
        f"The title\n{P}\n{Q}"),
    "math": (
        f'<article><p>{P} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding="tex">x=2</annotation></math> and so on.</p></article>',
        f"{P} x=2 and so on."),
    "links": (
        f'<article><h1>T</h1><p>{P}</p><ul><li><a href=1>First source</a></li><li><a href=2>Second</a></li></ul><p>{Q}</p></article>',
        f"T\n{P}\nFirst source\nSecond\n{Q}"),
    "fallback": (
        f'<article><p>{P} <object data=x>a chart of sales</object> <canvas>drawn</canvas></p><video src=v><p>no video here</p></video></article>',
        f"{P} a chart of sales drawn\nno video here"),
    "svg": (f'<article><p>{P} <svg><title>icon</title><text>42 km</text></svg></p></article>', f"{P} 42 km"),
    "form": (
        f'<body><form action=x><div class=menu><a href=1>a</a></div><h1>T</h1><p>{P}</p><p>{Q}</p></form></body>',
        f"T\n{P}\n{Q}"),
    "realform": (
        f'<body><article><h1>T</h1><p>{P}</p><p>{Q}</p></article><form><p>Leave us your mail and your name, please</p></form></body>',
        f"T\n{P}\n{Q}"),
    "related": (
        f'<body><article><h1>T</h1><p>{P}</p><p>{Q}</p></article><section class=related><article><h3>Other</h3><p>Teaser text of another thing</p></article></section></body>',
        f"T\n{P}\n{Q}"),
    "comments": (
        f'<body><article><h1>T</h1><p>{P}</p></article><div id=comments>'+''.join(f'<div class=comment><p>{Q} {k}</p></div>' for k in range(9))+'</div></body>',
        f"T\n{P}"),
    "hascomments": (
        f'<body><div class="page comments-open"><h1>T</h1><p>{P}</p><p>{Q}</p><div class=comment-list><p>{Q} I say</p></div></div></body>',
        f"T\n{P}\n{Q}"),
    "cookie": (
        f'<body><div class="cookie-notice">We use cookies to improve your experience here, is that fine?</div><article><h1>T</h1><p>Few words.</p></article></body>',
        "T\nFew words."),
    "plain": (
        "plain words without any tag, enough of them to be content",
        "plain words without any tag, enough of them to be content"),
    "noarticle": (
        f'<body><div id=top><a href=1>x</a> <a href=2>y</a></div><h1>T</h1><p>{P}</p><p>{Q}</p><div class="advert">Buy now, cheap and good things for everybody</div></body>',
        f"T\n{P}\n{Q}"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_pages_of_many_shapes(name):
    page, text = CASES[name]
    assert html_extract.main_text(page) == text


def test_fitted_weights_extract_pages_that_they_have_not_seen(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    half = len(pages) // 2
    weights = html_extract.fitted([*((p, gold(p)) for p in pages[:half]), *list(CASES.values()) * 3])
    assert all(html_extract.main_text(p, weights) == gold(p) for p in pages[half:])
    assert all(html_extract.main_text(p, weights) == t for p, t in CASES.values())


def test_without_pages_the_prior_stays():
    assert html_extract.fitted([("", "")]) == html_extract.PRIOR
