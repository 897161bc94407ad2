"""Pages whose main text stands in several elements, or under names that speak of other elements."""

from __future__ import annotations

import time

from evalmill.llm.html_extract import main_text

LONG = [f"Paragraph {i} of the body goes on for a good while, with words enough to be content." for i in range(30)]
BODY = "".join(f"<p>{x}</p>" for x in LONG)
MENU = "<nav><a>Home</a> <a>About</a></nav>"


def page(inside: str) -> list[str]:
    return main_text(f"<html><body>{MENU}{inside}<footer>Made by somebody</footer></body></html>").split("\n\n")


def test_lines_beside_a_nested_body_stay():
    assert page(f"<article><h1>Title</h1><p>The lead.</p><div class=body>{BODY}</div></article>") == ["Title", "The lead.", *LONG]
    assert page(f"<main><h1>Title</h1><article>{BODY}</article></main>") == ["Title", *LONG]


def test_a_short_last_section_stays():
    last = "A last section, which is short but has a line of text of its own."
    assert page(f"<div><section>{BODY}</section><section><p>{last}</p></section></div>") == [*LONG, last]


def test_names_of_wrappers_do_not_empty_a_page():
    side = "<div class=sidebar><p>Other things that one may read here some day.</p></div>"
    for name in ("layout has-sidebar", "no-sidebar", "with-comments", "reviews", "discussion", "related"):
        assert page(f"<div class='{name}'><div>{BODY}</div>{side}</div>") == LONG, name


def test_comments_longer_than_the_article_are_still_no_content():
    talk = "".join(f"<p>Reader {i} says something that is of no use to anybody at all, at length.</p>" for i in range(50))
    assert page(f"<article>{BODY}</article><div class=comments>{talk}</div>") == LONG


def test_menus_without_names_are_dropped_by_their_ratio():
    links = "".join(f"<li><a href=/{i}>Section number {i}</a></li>" for i in range(12))
    inside = f"<div><div><ul>{links}</ul></div><div><h1>Title</h1>{BODY}</div><div><ul>{links}</ul></div></div>"
    assert main_text(f"<html><body>{inside}</body></html>").split("\n\n") == ["Title", *LONG]
    more = "<div><p>" + " ".join(f"<a>Topic {i}</a>" for i in range(20)) + "</p></div>"
    beside = f"<div>{more}<section>{BODY}</section><section>{BODY}</section></div>"
    assert main_text(f"<html><body>{beside}</body></html>").split("\n\n") == LONG + LONG


def test_time_grows_with_the_length_of_a_page():
    for opened, closed in (("<div>", ""), ("<div class=ad>", ""), ("<div><li>x", "</li>"), ("<header><h1>a", "</h1>"), ("<b>", "</i>")):
        began = time.perf_counter()
        main_text(f"<article>{BODY}</article>" + opened * 20_000 + closed * 20_000)
        assert time.perf_counter() - began < 4, opened


ODD = ["<![ x", "<![>", "<![1]", "<![CDATA[ x", "<![foo[", "<!", "<!-", "<!--", "-->", "<?", "</", "</>", "<a ", '<a "', "<p", ">", "<", "&#", "&#x110000;", "<!DOCTYPE", "<script>", "<!-->", "\0", "]]>", "<svg/"]


def test_no_page_stops_the_parser():
    import random

    draw = random.Random(9)
    page = "<html><body><nav><a href='/'>home</a></nav><article><h1>Title</h1><p>Some words of an article, long enough to count.</p></article></body></html>"
    for _ in range(10_000):
        text = page
        for _ in range(draw.randrange(1, 5)):
            at = draw.randrange(len(text))
            text = text[:at] + draw.choice(ODD) + text[at + draw.randrange(4) :]
        main_text(text)


def test_odd_sections_are_text_and_open_ends_are_cut():
    assert main_text("<p>see <![1] for this</p>") == "see <![1] for this"
    assert main_text("<p>a</p><!-- x") == "a" and main_text("<p>a</p>b <a href='") == "a\n\nb"
    assert main_text("<p>a <![if IE]>b<![endif]> c</p>").split() == ["a", "b", "c"]


def test_time_grows_with_the_page():

    for odd in ("<a ", "<!--", "</", "<", "<![ "):
        began = time.monotonic()
        main_text("<p>words</p>" + odd * (1_000_000 // len(odd)))
        assert time.monotonic() - began < 5, odd
