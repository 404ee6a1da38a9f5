"""Pages against another parser, spans, visibility, depth and length."""

import random
import re
import time

import pytest

from millrace.llm.html_text import page_text
from tests.llm.slow_html import visible_words
from tests.oracle import DATA


def words(text):
    return sorted(w for w in re.split(r"[ \t\n\r\f]+", text) if w)


def bare(ws):
    """Without the markers of lists."""
    return sorted(w for w in ws if not re.fullmatch(r"-|\d+\.", w))


def test_all_pages_against_another_parser(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        assert bare(words(page_text(r.html))) == bare(visible_words(r.html)), r.page_id


def test_generated_markup_against_another_parser():
    rng = random.Random(6)
    for _ in range(400):
        n, out, depth = 0, [], []
        for _ in range(rng.randint(1, 30)):
            kind = rng.random()
            if kind < 0.45:
                n += 1
                out.append(f"w{n} ")
            elif kind < 0.8:
                tag = rng.choice(["div", "p", "b", "span", "ul", "li", "ol", "section", "h2", "em"])
                style = rng.choice(["", "", "", " hidden", ' style="visibility:hidden"', ' style="visibility:visible"', ' style="display:none"'])
                out.append(f"<{tag}{style}>")
                depth.append(tag)
            elif depth:
                out.append(f"</{depth.pop()}>")
        page = "".join(out)
        assert bare(words(page_text(page))) == bare(words(" ".join(visible_words(page)))), page


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td colspan=2>long heading<tr><td>a<td>b</table>", "long heading\na          b"),
        ("<table><tr><td>a<td>b<td>c<tr><td colspan=2>x<td>y</table>", "a  b  c\nx     y"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"),
        ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
        ("<p>a<a href='x", "a"),
        ("a</br>b", "a\nb"),
        ("1 < 2 </ 3> 4 <3", "1 < 2 4 <3"),
        ("<svg><text><![CDATA[x<y]]></text></svg>", "x<y"),
        ("<a title='>'>x</a> <a b=c\">y</a>", "x y"),
    ],
)
def test_cases(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x", "x" + "<a " * 330_000, "<table><tr><td>" * 60_000 + "x", "<b><table><td>" + "<div>" * 80_000 + "</b>" * 150_000 + "x", "<p>x" * 250_000, "<table>" + "<tr><td rowspan=9>a<td>b" * 40_000])
def test_a_megabyte_takes_seconds(page):
    began = time.process_time()
    assert "x" in page_text(page) or "a  b" in page_text(page)
    assert time.process_time() - began < 30  # twice the page, on a slow machine


def test_tables_nest_to_any_depth():
    text = page_text("<table><tr><td>l<td>" * 3000 + "deep")
    assert text.endswith("deep") and text.count("l") == 3000
