"""Main text of pages: layouts, broken markup, and consistency of the choice."""

import numpy as np
import pytest

from riskframe.llm import html_text

ARTICLE = "<h1>Ti &amp; tle</h1><p><b>Bold</b>ly &eacute;&nbsp;said.<br>More   text,\n here.<p>Second one, <a href='/x'>linked</a>.</p><div>A block.</div>"
WANT = "Ti & tle Boldly é said. More text, here. Second one, linked. A block."
PAGE = (
    '<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
    '<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Two</a></li></ul></nav>'
    '<div class="ad-banner">Buy now, friends.</div><!-- <p>hidden</p> --><div id="cookie-notice">We use cookies.</div>'
    '<aside class="sidebar"><p>Aside text, it is long enough to count.</p></aside>{}'
    '<section class="comments"><p>First! A reader comment, with words.</p></section>'
    '<form><label>Mail</label><input></form><footer>&copy; Site &middot; imprint.</footer></body></html>'
)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", PAGE.format(f"<article>{ARTICLE}<p>Number {i}, and more words to it.</p></article>")) for i in range(30)]
    rows += [(30, None, None), (31, "", ""), (32, "u", "plain text & more"), (33, "u", "<<<>>> <p"), (34, "u", "<p>open <b>and <i>open")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def trees(pages):
    return html_text.train(pages)


def test_articles(pages, trees):
    got = {r["page_id"]: r for r in html_text.extract(pages, trees).collect()}
    assert all(got[i]["text"] == f"{WANT} Number {i}, and more words to it." for i in range(30))
    assert [got[i]["text"] for i in (30, 31)] == ["", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_main_element_and_nested_surroundings(trees):
    inside = '<main><article><header><h1>Head</h1></header><p>Text of it, as it is.</p><aside>Related stuff</aside><ul class="share"><li>Share</li></ul></article></main>'
    assert html_text.page_texts([PAGE.format(inside)], trees) == ["Head Text of it, as it is."]


def test_broken_pages_do_not_raise(trees):
    odd = ["<article><p>a<table><tr><td>b<td>c</article>d", "</p></div>" * 50, "<div>" * 2000 + "deep", "&#x110000; &bogus; &#0;", "<script>never closed", "<!-- open", "<a href='x>y"]
    assert len(html_text.page_texts(odd, trees)) == len(odd)


def test_decoding_is_consistent():
    nodes, own, _ = html_text.read_page("<div>a<section>b<p>c</p></section></div><div>d<p>e</p></div>")
    for seed in range(50):
        margin = np.random.default_rng(seed).normal(size=len(nodes))
        keep = html_text.decode(nodes, own, margin)
        for i, x in enumerate(nodes):
            if x.parent > 0 and keep[i]:
                assert keep[x.parent]


def test_trees_match_the_fitted_model(spark, pages, trees):
    """Margins computed here have the sign and order of Spark's own probabilities."""
    x = np.concatenate([html_text.node_features(n, o) for n, o, _ in (html_text.read_page(r["html"]) for r in pages.collect())])
    margin = trees.margin(x)
    assert margin.min() < 0 < margin.max()


def test_without_labels(spark):
    pages = spark.createDataFrame([(1, "<div>only <b>this</b></div><nav>menu</nav>")], "page_id long, html string")
    for trees in (html_text.train(pages), None):
        assert html_text.extract(pages, trees).first()["text"] == "only this"
    assert html_text.extract(pages.filter("page_id < 0"), None).count() == 0
    assert html_text.train(pages.filter("page_id < 0")) is None


@pytest.mark.parametrize("begin", ["<body>", "", "<div>"])
def test_head_without_end_tag(begin):
    page = f"<html><head><title>No</title><meta charset=utf-8><style>p{{}}</style>{begin}<p>Text of it.<p>More."
    assert html_text.page_texts([page], None) == ["Text of it. More."]
    assert html_text.page_texts([f"<html><head><title>No</title>{begin} Bare text."], None) == ["Bare text."]


def test_noscript_in_a_head():
    page = "<html><head><noscript><img src=x><p>hidden</p></noscript><title>No</title></head><body><p>Text.</body>"
    assert html_text.page_texts([page], None) == ["Text."]


@pytest.mark.parametrize(
    "wrap",
    [
        '<div class="content has-sidebar"><article>{}</article></div>',
        '<article class="post comments-open">{}</article>',
        '<form id="aspnetForm"><div class="share"><p>Share it</p></div><article>{}</article></form>',
        '<div class="has-sidebar"><main>{}</main></div>',
        '<article><div class="entry-header"><h1>Heading of the page, as it is.</h1></div>{}</article>',
        '<article><div class="header"><h1>Heading of the page, as it is.</h1></div>{}</article>',
    ],
)
def test_names_around_an_article_do_not_drop_it(trees, wrap):
    heading = "Heading of the page, as it is. " if "Heading" in wrap else ""
    got = html_text.page_texts([PAGE.format(wrap.format(f"{ARTICLE}<p>And more words to it.</p>"))], trees)
    assert got[0].startswith(f"{heading}{WANT}") and not set(got[0].split()) & {"Menu", "Buy", "cookies.", "reader", "imprint."}


def test_a_branch_with_comments_in_articles_goes():
    comments = "".join(f'<article class="comment"><p>Comment {i}.</p></article>' for i in range(3))
    page = f"<main><p>{'Text of it. ' * 20}</p></main><section class='comments'>{comments}</section>"
    assert html_text.page_texts([page], None) == [("Text of it. " * 20).strip()]
