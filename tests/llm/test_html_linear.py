"""Time in proportion to the page, whatever the page is made of."""

import gc
import time

import pytest

from millrace.llm.html_text import INDENT, page_text


def seconds(page):
    gc.disable()  # whose passes over all that the session holds are no part of it
    try:
        began = time.process_time()
        page_text(page)
        return time.process_time() - began
    finally:
        gc.enable()


@pytest.mark.parametrize("unit", ["<ul><li>", "<ul><li>x", "<", "a< ", "<p>a", "<div>", "<b>x", "<table><tr><td>", "<blockquote>q", "x<br>", "</", "<a b='", "&lt;&", "<!-- x -->y", "<svg><text>t"])
def test_twice_the_page_takes_twice_the_time(unit):
    size = 100_000
    one = min(seconds(unit * (size // len(unit))) for _ in range(3))
    two = min(seconds(unit * (2 * size // len(unit))) for _ in range(3))
    assert two < 4 and (two < 0.5 or two <= 3.3 * one), (one, two)  # four times if it went with the square


def test_deep_lists_keep_their_text():
    lines = page_text("<ul><li>x" * 500).split("\n")
    assert len(lines) == 500 and all(x.endswith("- x") for x in lines)
    assert [len(x) - 1 for x in lines[:4]] == [2, 4, 6, 8] and max(map(len, lines)) == INDENT + 1
