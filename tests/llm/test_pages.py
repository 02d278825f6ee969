"""Main text where names, places or the template of the host could take too much or too little."""

from __future__ import annotations

import time

import pytest

from sievework.llm import op7_template


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


def text_of(body):
    return op7_template.main_text(page(body), None)


@pytest.mark.parametrize("names", ["class='with-sidebar'", "class='no-header'", "class='page has-comments'", "id=search-page", "class='sidebar'", "role=form"])
def test_wrappers_keep_the_article(names):
    assert text_of(f"<nav>menu</nav><div {names}><article><p>Whole text</p></article></div>") == "Whole text"


def test_form_around_the_page():
    assert text_of("<form id='aspnetForm'><nav>menu</nav><main><p>Whole text</p></main></form>") == "Whole text"


def test_names_inside_the_article():
    body = "<h2 id='related'>Related</h2><section id=search>Search</section><div class='legal'>Legal</div><p>and <span class=\"tags\">tags</span></p>"
    assert text_of(f"<article>{body}</article>") == "Related Search Legal and tags"


def test_names_outside_the_article():
    assert text_of("<div class='comments'><article>Reply</article></div><article>Text</article><aside><article>Next</article></aside>") == "Text"
    assert text_of("<main><div class='wide ad'>Buy</div><article>Text</article></main>") == "Text"


def test_article_of_its_own():
    """The article counts whether it is a token of the template or not."""
    body = "<div class=teaser>Beside</div><article id='post-17' class='post-17 post'><h1>Head</h1><p>Text</p></article><p>%s</p>" % ("after " * 50)
    assert text_of(body) == "Head Text"


def test_labels_are_the_same_on_all_pages():
    tokens = [set(op7_template.Tree(f"<body><article id='post-{k}' class='post-{k} hentry'><p id='how-to-{w}-it'>").tokens())
              for k, w in ((1, "read"), (223, "write"))]
    assert tokens[0] == tokens[1]
    assert op7_template.token_of(("body", "article.post-0 post-0 hentry", "p")) in tokens[0]


def test_pages_without_article_keep_all_kinds_of_blocks():
    body = "<h1>Head</h1><p>First text.</p><ul><li>one<li>two</ul><table><tr><td>cell</table><blockquote>quote</blockquote><p>Last text.</p>"
    menu = "<ul><li><a href=/>home</a><li><a href=/a>about</a></ul>"
    want = "Head First text. one two cell quote Last text."
    assert text_of(body) == want and text_of(menu + body) == want and text_of(f"<div>{menu}<div>{body}</div></div>") == want
    assert text_of("<div id=a><p>small part</p></div><div id=b><p>a larger part of the text</p></div>") == "small part a larger part of the text"
    assert text_of(menu) == "home about"


def extracted(spark, bodies):
    rows = [(k, f"http://h.org/{k}", page(b)) for k, b in enumerate(bodies)]
    got = {r.page_id: r.text for r in op7_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[k] for k in range(len(rows))]


def test_slots_are_decided_by_their_text(spark):
    """A notice inside the article goes where all articles of the host have it; what differs, and what copies share, stays."""
    notice, words = "<div class='x7'><p>Jetzt abonnieren</p></div>", "one two three four five".split()
    bodies = [f"<article><p>Long text of page {w}</p>{notice}<div class='legal'>Case {w}</div></article>" for w in words]
    assert extracted(spark, bodies) == [f"Long text of page {w} Case {w}" for w in words]
    copies = [f"<article><h1>Head</h1><p>Long text of a copied page</p>{notice}</article><p>{w}</p>" for w in words]
    assert extracted(spark, copies) == ["Head Long text of a copied page Jetzt abonnieren"] * 5
    shared = [f"<article><p>Long text of page {w}</p><p>Shared line</p></article>" for w in words]
    assert extracted(spark, shared) == [f"Long text of page {w} Shared line" for w in words]


def test_slots_without_article(spark):
    words = "one two three four five".split()
    bodies = [f"<div class='k1'><p>Long text of page {w}</p><div class='m'><a href='/{w}'>to {w}</a></div><div class='b'>Beilage</div></div>" for w in words]
    assert extracted(spark, bodies) == [f"Long text of page {w}" for w in words]
    assert extracted(spark, bodies[:2])[0] == "Long text of page one to one Beilage"
    copies = [f"<div><p>Long text of a copied page</p><div class='b'>Beilage</div></div><i>{w}</i>" for w in words]
    assert extracted(spark, copies)[0] == "Long text of a copied page Beilage one"


@pytest.mark.parametrize("page", ["<div>" * 90_000 + "x", "<a " * 350_000, '<a "' * 250_000, "<script " * 120_000, "<p>" + "<div><p>x" * 100_000,
                                  "<b>" * 6_000 + "<div>" * 6_000 + "</b>" * 6_000])
def test_long_pages_take_linear_time(page):
    start = time.process_time()
    op7_template.Tree(page)
    assert time.process_time() - start < 20


def test_tags_end_at_brackets():
    assert list(op7_template.page_tokens('<a href="x>y" <b>t</b><i')) == [
        ("text", "", "<"), ("text", "", 'a href="x>y" '), ("open", "b", ""), ("text", "", "t"), ("close", "b", ""), ("text", "", "<"), ("text", "", "i")]
