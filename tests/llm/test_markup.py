"""Markup that is hostile to a parser: time linear in the page, and what is read of it."""

import random
import time

import pytest

from terravane.llm import htmltext


def text(page):
    return [b[1] for b in htmltext.parse(page)[0]]


HOSTILE = {
    "tags without end": "<a ",
    "quotes without end": "<a href='",
    "ends inside quotes": "<a '>'",
    "ends inside mixed quotes": "<a '>' \">\"",
    "declarations": "<!-",
    "comments": "<!-- ",
    "lists": "<dl><dt>",
    "list items": "<ul><li>x",
    "ends of nothing": "<div></ul>",
    "paragraphs": "<p>x",
    "held spans": "<span class=share>x ",
    "names of brackets": "</a<a",
    "attributes": "<div a='b' a=\"c\" ",
    "entities": "&amp",
}


@pytest.mark.parametrize("unit", HOSTILE.values(), ids=HOSTILE.keys())
@pytest.mark.parametrize("tail", ["", ">", "<b>x</b>"])
def test_time_is_linear(unit, tail):
    def took(n):
        best = 9e9
        for _ in range(2):
            start = time.process_time()
            htmltext.parse(unit * n + tail)
            best = min(best, time.process_time() - start)
        return best

    assert took(32_000) < 10 * took(8_000) + 0.1  # sixteen times as long if quadratic


def test_many_custom_elements():
    page = "".join(f"<x{i} class='share'>y" for i in range(20_000))
    start = time.process_time()
    htmltext.parse(page)
    assert time.process_time() - start < 5


def test_ends_of_tags():
    assert text("<p title='a > b'>one</p>") == ["one"]
    assert text("<p title='a > b>one</p>two") == ["b>one", "two"]  # a quote that never ends: the first bracket ends the tag
    assert text("a <b 'x") == ["a <b 'x"]
    assert text("a <b x <!-- c --> d") == ["a d"]  # the first bracket ends the tag
    assert text("<p>a<!-- > <p> --> b") == ["a b"]
    assert text("<p>a<!-- never") == ["a"]
    assert text("1 < 2 <p> 3 </ 4") == ["1 < 2", "3 </ 4"]


def test_random_nestings():
    """No text is lost, and no element is closed twice."""
    rng = random.Random(6)
    names = "div p ul li dl dt dd table tr td article section blockquote".split()
    for _ in range(300):
        page = "".join(f"<{rng.choice(['', '', '/'])}{rng.choice(names)}>{rng.choice(['', 'x'])}" for _ in range(60))
        blocks, nodes = htmltext.parse(page)
        assert sum(b[1].count("x") for b in blocks) == page.count(">x")
        opened = [t for t in page.split("<")[1:] if not t.startswith("/")]
        assert len(nodes) <= len(opened)
