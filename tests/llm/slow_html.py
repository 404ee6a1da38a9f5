"""The visible words of a page by another parser than the library's: Python's html.parser feeds a naive list of open elements."""

import re
from html.parser import HTMLParser

GONE = {"head", "script", "style", "template", "noscript", "iframe", "noembed", "noframes", "object", "audio", "video", "canvas", "datalist", "title", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "div", "dl", "dd", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": ({"li"}, {"ul", "ol", "table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "dd": ({"dt", "dd"}, {"dl"}), "dt": ({"dt", "dd"}, {"dl"})}


class Words(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []  # open: (name, shown, seen)

    def close_until(self, names, walls):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                del self.open[i:]
                return
            if self.open[i][0] in walls:
                return

    def handle_starttag(self, tag, attrs):
        a, style = dict(attrs), (dict(attrs).get("style") or "").replace(" ", "").lower()
        if tag in ENDS_P:
            self.close_until({"p"}, {"td", "th", "caption", "table", "button"})
        if tag in SAME:
            self.close_until(*SAME[tag])
        shown, seen = self.open[-1][1:] if self.open else (True, True)
        shown = shown and tag not in GONE and "display:none" not in style and "hidden" not in a
        seen = False if "visibility:hidden" in style else True if "visibility:visible" in style else seen
        if tag == "img" and shown and seen and a.get("alt"):
            self.words += a["alt"].split()
        if tag not in VOID:
            self.open.append((tag, shown, seen))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "body", "html"):
                return

    def handle_data(self, data):
        if all(x for x in (self.open[-1][1:] if self.open else ())):
            self.words += re.split(r"[ \t\n\r\f]+", data.strip(" \t\n\r\f")) if data.strip(" \t\n\r\f") else []


def visible_words(page):
    p = Words()
    p.feed(page or "")
    p.close()
    return p.words
