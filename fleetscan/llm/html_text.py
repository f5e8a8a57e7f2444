"""Main text of web pages by the distribution of text over lines (operator 12).

Markup is stripped to lines: a line is the text between two tags of block elements.  What
elements mark as something else than the article (menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts) leaves an empty line.  A line's length is its text
outside of links.  The lengths are summed over sliding windows of lines; the sum surges where a
window reaches the threshold and dives where one has nothing left, and the text from surge to
dive is a stretch.  The stretch with most text is the article.

Where a page names its article (``article``, ``main``), lines outside of it count nothing and
windows of empty lines part several articles, so short ones are found too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Lines of a window, and characters at which the text of a window surges in a page that names
#: no article.
WINDOW, SURGE = 3, 86

#: Elements of HTML by what they mean here.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "audio", "video", "xmp")
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr", "label", "img", "picture", "source"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
APART = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "head", "select", "button", "datalist", "fieldset", "search"))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "note", "status", "toolbar"))
#: Elements whose opening ends an open one of the same kind.
SELF_ENDING = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
#: Words that open or close the name of a class or id of something beside the article.
BESIDE = re.compile(
    r"(?:ads?|adverts?|advertis\w+|adsense|adslot|adbox|banners?|sponsor\w*|promos?|promotions?|promoted|sidebars?|aside|nav|navs|navbar|navigation|menus?|submenu|breadcrumbs?|masthead|topbar|footers?|copyright|colophon|cookies?|consent|gdpr|notices?|notifications?"
    r"|alerts?|disclaimer|popups?|modal|overlay|newsletters?|subscribe|subscription|signup|login|search|searchbox|forms?|comments?|commentlist|commentform|replies|respond|disqus|discussion|share|sharing|shares|social|related|recommended|recommendations|toolbar|pagination|pager|skiplink)$"
)
_HEADER = re.compile(r"header$")
_KEEPS = frozenset(("has", "no", "with", "without", "is"))
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+(?:>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)",
    re.S | re.I,
)


@dataclass
class Line:
    """A line's text, the part of its length outside of links, and whether it is in an article."""

    text: str
    weight: int
    named: bool


def beside(name: str, rest: str, named: bool) -> bool:
    """Whether an element's name, role, class or id puts it beside the article. ``named``: in
    an article, whose own header belongs to it."""
    if name in APART or (name == "header" and not named):
        return True
    if name in ("html", "body", "main") or not rest:
        return False
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _NAMES.findall(one)]
                if words and not _KEEPS.intersection(words) and any(BESIDE.match(w) or (not named and _HEADER.match(w)) for w in (words[0], words[-1])):
                    return True
    return False


class Lines:
    """The lines of a page, gathered tag by tag in one pass."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.parts: list[tuple[str, bool]] = []
        self.links = self.articles = 0
        self.skip: str | None = None
        self.depth = self.inner = 0
        at = 0
        for m in _MARKUP.finditer(page):
            if m.start() > at and not self.skip:
                self.parts.append((page[at : m.start()], self.links > 0))
            at = m.end()
            if m["name"]:
                self.tag(m["name"].lower(), bool(m["close"]), m["rest"])
        if at < len(page) and not self.skip:
            self.parts.append((page[at:], self.links > 0))
        self.end_line()

    def end_line(self) -> None:
        """The text so far is a line, its references decoded and its white space single."""
        if self.parts:
            text = " ".join(html.unescape("".join(t for t, _ in self.parts)).split())
            if text:
                linked = sum(len(t.strip()) for t, in_link in self.parts if in_link)
                self.lines.append(Line(text, max(len(text) - linked, 0), self.articles > 0))
            self.parts = []

    def gap(self, lines: int) -> None:
        self.end_line()
        self.lines += [Line("", 0, self.articles > 0)] * lines

    def tag(self, name: str, close: bool, rest: str) -> None:
        if self.skip:
            self.skipped(name, close, rest)
            return
        if name in ("article", "main"):
            if not close and beside(name, rest, self.articles > 0):
                self.begin_skip(name)
                return
            self.gap(WINDOW)
            self.articles = max(0, self.articles + (-1 if close else 1))
            return
        if name == "a":
            self.links = 0 if close else 1
        if name not in INLINE:
            self.end_line()
        if not close and name not in VOID and not rest.endswith("/") and beside(name, rest, self.articles > 0):
            self.begin_skip(name)

    def begin_skip(self, name: str) -> None:
        """What stands beside is one empty line, however much of it there is in a row, and none within
        a named article, which it doesn't end."""
        if name not in INLINE:
            self.gap(not self.articles and bool(self.lines) and bool(self.lines[-1].text))
        self.skip, self.depth, self.inner = name, 1, 0

    def skipped(self, name: str, close: bool, rest: str) -> None:
        """In an element that is left out: its end, or what ends it without a tag."""
        if self.skip == "head" and name not in ("head", "meta", "link", "base"):
            self.skip = None
            self.tag(name, close, rest)
        elif name in ("body", "html") and close:
            self.skip = None
        elif name == self.skip:
            if close:
                self.depth -= 1
            elif name in SELF_ENDING:
                self.skip = None
                self.tag(name, close, rest)
                return
            else:
                self.depth += 1
            if not self.depth:
                self.skip = None
        elif self.skip in SELF_ENDING and name not in INLINE and name not in VOID and name != "p":
            # A block ends a paragraph; the end of what an item stands in ends the item.
            if self.skip == "p" or (close and not self.inner):
                self.skip = None
                self.tag(name, close, rest)
            else:
                self.inner += -1 if close else 1


def stretches(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """From surge to dive: where the sum over the ``window`` lines from one on reaches
    ``surge``, up to where it is 0."""
    sums, total = [0] * len(weights), 0
    for i in range(len(weights) - 1, -1, -1):
        total += weights[i] - (weights[i + window] if i + window < len(weights) else 0)
        sums[i] = total
    out, begin = [], None
    for i, s in enumerate(sums):
        if begin is None and s >= surge:
            begin = i
        elif begin is not None and not s:
            out.append((begin, i))
            begin = None
    if begin is not None:
        out.append((begin, len(sums)))
    return out


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's text, lines joined by a space; empty where the page has none."""
    lines = Lines(page).lines
    named = any(x.named and x.text for x in lines)
    if named:
        weights = [len(x.text) if x.named else 0 for x in lines]
        surge = 1
    else:
        weights = [x.weight for x in lines]
        if not any(weights):
            weights = [len(x.text) for x in lines]
        surge = max(1, min(surge, max((sum(weights[i : i + window]) for i in range(len(weights))), default=1)))
    found = stretches(weights, window, surge)
    if not found:
        return ""
    begin, end = max(found, key=lambda s: (sum(weights[s[0] : s[1]]), -s[0]))
    # A window reaches the threshold some lines before the text, which may be links.
    begin = next(i for i in range(begin, end) if weights[i])
    return " ".join(x.text for x in lines[begin:end] if x.text and (x.named or not named))


def extract(pages: DataFrame, payload: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the column ``text`` (added, or in the place of one of that name): the main
    text of each page.

    Null and empty pages have an empty text, and so have pages without any. Pages of any length
    are read whole, in time that grows with their length; rows that repeat are rows of their
    own; an empty table stays empty. Other columns stay as they are, whatever their names: only
    the page goes through Python, as one more column.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda p: main_text(p or ""))

    return pages.withColumn(text, run(F.coalesce(F.col(payload).cast("string"), F.lit(""))))
