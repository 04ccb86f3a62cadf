"""Whole pages of everyday templates, labelled by hand, and pages that try the parser."""

import time

import pytest

from traceloom.llm import html_text

TITLE = "How rivers find the sea"
P1 = "Rivers follow the slope of the land, and where it is nearly flat they wander in wide loops."
P2 = "Over centuries the loops grow, meet, and are cut off, which leaves lakes shaped like a horn."
P3 = "At the coast the water slows down and drops its load of silt, and a delta begins to form."
WANT = "\n".join([TITLE, P1, P2, P3])
BODY = f"<h1>{TITLE}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>'
FOOT = "<footer><p>Copyright the river society, all rights reserved by it for ever.</p></footer>"
IMPRINT = "<div><p>Imprint and contact</p></div>"
COMMENTS = '<div id="comments" class="comments-area"><h2>Comments</h2>' + "".join(f'<div class="comment"><p>Reader {i} says that this is a fine piece on rivers, and that one should read it twice or more.</p></div>' for i in range(12)) + "</div>"
SIDE = '<div class="sidebar"><h3>Popular</h3><ul><li><a href="/x">Ten more stories</a></li></ul><p>Sign up for our letter.</p></div>'

PAGES = {
    "builder": NAV + '<div class="elementor">' + "".join(f'<div class="elementor-widget elementor-widget-text"><div class="elementor-widget-container">{x}</div></div>' for x in (f"<h1>{TITLE}</h1>", f"<p>{P1}</p>", f"<p>{P2}</p>", f"<p>{P3}</p>")) + "</div>" + IMPRINT + FOOT,
    "side by side": NAV + f'<div class="side-by-side"><div class="col">{BODY}</div></div>' + IMPRINT + FOOT,
    "widget body": NAV + f'<div class="widget-body">{BODY}</div>' + IMPRINT + FOOT,
    "form page": NAV + f'<div class="form-page"><div>{BODY}</div></div>' + IMPRINT + FOOT,
    "sidebar layout": f'<div class="page-sidebar-right">{NAV}<div class="inner">{BODY}</div>{SIDE}</div>' + IMPRINT + FOOT,
    "page-wide form": f'<form id="aspnetForm" method="post"><input type="hidden" name="__VIEWSTATE">{NAV}<div id="content">{BODY}</div>{SIDE}</form>' + IMPRINT + FOOT,
    "plain page-wide form": f'<form action="/">{NAV}<div>{BODY}</div></form>' + IMPRINT,
    "blog with long comments": NAV + f'<div class="post">{BODY}</div>' + COMMENTS + SIDE + FOOT,
    "article with long comments": NAV + f"<article>{BODY}</article>" + COMMENTS + FOOT,
    "comments inside the layout": NAV + f'<div class="content-sidebar"><div class="entry">{BODY}</div>{COMMENTS}</div>{SIDE}' + FOOT,
    "table layout": f'<table><tr><td class="nav"><a href="/a">One</a> <a href="/b">Two</a></td><td>{BODY}</td></tr></table>' + FOOT,
    "cookie notice": f'<div class="cookie-banner"><p>We use cookies to make this site better for everyone who reads it.</p><button>Fine</button></div>{NAV}<main>{BODY}</main>' + FOOT,
    "search form in the page": NAV + f'<div class="text"><form class="search"><label>Search our pages</label><input></form>{BODY}</div>' + FOOT,
    "newsletter form": NAV + f"<div>{BODY}</div><form><p>Get our letter every week, it is free of charge.</p><input></form>" + FOOT,
}


def text_of(html):
    page = html_text.parse(f"<html><head><title>{TITLE}</title></head><body>{html}</body></html>")
    own = html_text.best_container(page)
    return html_text.text_by(page, [own[0]] if own else [])


@pytest.mark.parametrize("name", PAGES)
def test_everyday_pages_give_their_article(name):
    assert text_of(PAGES[name]) == WANT


def test_a_list_of_articles():
    three = "".join(f"<article><h2>{TITLE} {i}</h2><p>{P1}</p><p>{P2}</p></article>" for i in range(3))
    got = text_of(NAV + f'<div class="share-page">{three}</div>' + IMPRINT + FOOT)
    assert got == "\n".join(x for i in range(3) for x in (f"{TITLE} {i}", P1, P2))


def test_only_a_form():
    """A page that holds nothing else is its form's text."""
    assert text_of(f"<form><p>{P1}</p></form>") == P1


def test_pages_of_a_host(spark):
    rows = [(i, f"https://site{i}.example/{j}", f"<html><body>{page}</body></html>") for i, page in enumerate(PAGES.values()) for j in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract_text(df).collect()} == {WANT}


@pytest.mark.parametrize(
    "html",
    ["<i>" * 50_000 + "text" + "</u>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000 + "text", "<i>" * 50_000 + "<p>text</p>" * 2 + "<li>x" * 50_000, "<div class='sidebar'>" * 50_000 + "text" + "</div>" * 50_000, "<ul><li>" * 50_000 + "text", "<form>" * 30_000 + "<p>text</p>" * 20_000],
    ids=["unmatched", "blocked", "inline", "doubts", "lists", "forms"],
)
def test_odd_pages_parse_in_linear_time(html):
    began = time.perf_counter()
    page = html_text.parse(html)
    html_text.best_container(page)
    assert time.perf_counter() - began < 4
    assert html_text.kept_blocks(page)
