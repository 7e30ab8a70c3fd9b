"""Regions of pages chosen by slots, near copies, names, and reading forwards."""

import json
import time

import pytest

from freshet.llm import wrappers


def texts(pages, group=None):
    streams = sorted({json.dumps(wrappers.tree_stream(p, True)) for p in pages})
    known = json.loads(wrappers.rules(json.dumps(wrappers.infer(streams))))
    return [" ".join(wrappers.main_texts(p, known)) for p in pages], known


def neutral(i):
    """No telling name: a menu, a headline, the story, reader talk on half of the pages, adverts on a quarter."""
    points = f"<ul><li>point {i}</li></ul>" if i % 3 == 0 else ""
    talk = f"<div class='z9'><p>reader {i} says hello and a lot more than that, again and again</p></div>" if i % 2 else ""
    advert = f"<div class='q'>Buy thing {i} now</div>" if i % 4 == 0 else ""
    return (f"<body><div class='a1'><p>Home</p><p>About us</p></div><h1>Title {i}</h1><div class='k3 x{i}'><div class='k4'>"
            f"<p>Story number {i} is told here at length.</p><p>It goes on {i}.</p>{points}</div></div>{talk}{advert}"
            "<div class='e'>imprint</div></body>")


def test_slots_and_optional_groups_choose_the_region():
    got, known = texts([neutral(i) for i in range(20)])
    assert known["region"] == {"element": ["body", "div.k0.x0", "div.k0"], "heads": ["body/h1"]}
    for i, text in enumerate(got):
        assert text == f"Title {i} Story number {i} is told here at length. It goes on {i}." + (f" point {i}" if i % 3 == 0 else "")
    few, known = texts([neutral(i) for i in range(4)])  # too few pages to tell
    assert known == {"template": {}, "region": None} and all("Story number" in t for t in few)


ARTICLE = "<body><article><p>Alpha one.</p><p>Beta two.</p><p>Gamma three.</p></article></body>"


@pytest.mark.parametrize("n", [2, 12, 40])
def test_near_copies_keep_their_article(n):
    pages = [ARTICLE.replace("three", str(i)) for i in range(n)]
    assert texts(pages)[0] == [f"Alpha one. Beta two. Gamma {i}." for i in range(n)]
    counted = [f"<body><article><p>One article.</p></article><p>Seen {i} times</p></body>" for i in range(n)]
    assert set(texts(counted)[0]) == {"One article."}


def test_a_notice_of_many_pages_is_template():
    pages = [f"<body><article><p>Read our rules.</p><p>Story {i} is long enough.</p><p>End {i}.</p></article></body>" for i in range(12)]
    assert texts(pages)[0] == [f"Story {i} is long enough. End {i}." for i in range(12)]


def test_names():
    gone = ("comment-body comment-content user-comments ad-slot ad-container newsletter-signup related-articles nav-wrapper sidebar-inner"
            " gdpr-banner footer-inner sponsored-content commentSection site-footer main-nav cookie-consent share-buttons")
    stays = "has-sidebar no-sidebar no-cookies with-menu page promo-free content article-body entry-header x7 share-price story"
    assert all(wrappers.names_boilerplate(x) for x in gone.split())
    assert not any(wrappers.names_boilerplate(x) for x in stays.split())
    assert wrappers.element("article", " class='comment'").endswith("!")
    assert wrappers.element("article", " class='promo-free'").endswith("*")
    assert wrappers.element("main", " class='with-sidebar'").endswith("*")
    page = "<body class='has-sidebar'><article><p>text</p><article class='comment'><p>me too</p></article></article></body>"
    assert wrappers.main_texts(page, {}) == ["text"]


@pytest.mark.parametrize("broken", ["x<a ", '<a "', "<!x ", "</script ", "<script></script ", "<a '\"", "<p class='", "<", "<!--", "&", "<br", "<div>x</p>"])
def test_reading_takes_time_in_proportion(broken):
    began = time.process_time()
    for n in (1, 3, 20_000):
        wrappers.main_texts(broken * n, {})
        wrappers.tree_stream(broken * n, True)
    assert time.process_time() - began < 20


def test_reading_broken_tags():
    assert wrappers.main_texts("a < b and <p>c<b>d</b> <3</p>", {}) == ["a < b and", "cd <3"]
    assert wrappers.main_texts('<p title="x > y">in</p><p title="open>out</p>', {}) == ["in", "out"]
    assert wrappers.main_texts("<p>text <unclosed", {}) == ["text <unclosed"]
