"""Text of HTML pages, whole or of selected elements (standard library parser, in Arrow batches)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = {"script", "style", "noscript", "template", "head"}
BREAKS = {"p", "div", "li", "ul", "ol", "br", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "title"}


_AMPERSAND = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|([a-zA-Z][a-zA-Z0-9]*;))?")


def _only_closed(page: str) -> tuple[str, str]:
    """A page for the parser, and a character not in it that stands for each ampersand that begins no closed reference."""
    bare = next(c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE))) if c not in page)
    return _AMPERSAND.sub(lambda m: m[0] if m[1] and (m[2] is None or m[2] in html5) else bare + m[0][1:], page), bare


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN and self.hidden > 0
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_text(html: str | None, closed: bool = False) -> str | None:
    if html is None:
        return None
    html, bare = _only_closed(html) if closed else (html, "&")
    reader = _Reader()
    reader.feed(html)
    reader.close()
    lines = (" ".join(x.split()) for x in "".join(reader.parts).replace(bare, "&").split("\n"))
    return "\n".join(x for x in lines if x)


def texts_of(pages: pd.Series) -> pd.Series:
    return pages.map(visible_text)


def html_text(page: Column | str) -> Column:
    return F.pandas_udf(texts_of, "string")(page)


# --- selected elements -----------------------------------------------------------------------

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Where the text of each kind of page stands, and the parts of an assessment in their order.
TEXT_LAYERS = ".textLayer, .react-pdf_Page__textContent"
ASSESSMENT = (".js-due-date", ".overview-attempts-section", ".ql-editor.bb-editor")
TOPIC = '.ql-editor[contenteditable="false"]'

_STEP = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*)|\.(?P<class>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?:="(?P<value>[^"]*)")?\]""")


@lru_cache
def selector(text: str) -> tuple[tuple[tuple[str, str, str | None], ...], ...]:
    """Alternatives of a selector, each what one element must have: tag, classes, id, attributes. No other selectors are known."""
    found = []
    for part in text.split(","):
        wanted, at = [], 0
        part = part.strip()
        while at < len(part):
            m = _STEP.match(part, at)
            if m is None:
                raise ValueError(f"not a selector of one element: {part!r}")
            kind = m.lastgroup if m.lastgroup != "value" else "name"
            wanted.append((kind, m[kind].lower() if kind == "tag" else m[kind], m["value"]))
            at = m.end()
        if not wanted:
            raise ValueError(f"an empty selector in {text!r}")
        found.append(tuple(wanted))
    return tuple(found)


def _fits(wanted: tuple[tuple[str, str, str | None], ...], tag: str, attrs: dict[str, str | None]) -> bool:
    classes = (attrs.get("class") or "").split()
    test = {"tag": lambda n, _: n == tag, "class": lambda n, _: n in classes, "id": lambda n, _: attrs.get("id") == n, "name": lambda n, v: n in attrs and (v is None or attrs[n] == v)}
    return all(test[kind](name, value) for kind, name, value in wanted)


class _Selected(HTMLParser):
    """Collects the text of every element that fits, in the order in which they begin; an element may stand in another."""

    def __init__(self, wanted, bare="&"):
        super().__init__(convert_charrefs=True)
        self.bare = bare
        self.wanted, self.texts, self.open = wanted, [], []  # open: (tag, index of the text that it gathers, or None)
        self.gathering: list[int] = []

    def handle_starttag(self, tag, attrs):
        own = {name: value and value.replace(self.bare, "&") for name, value in attrs}
        fits = any(_fits(w, tag, own) for w in self.wanted)
        if fits:
            self.texts.append([])
        if tag not in VOID:
            self.open.append((tag, len(self.texts) - 1 if fits else None))
            if fits:
                self.gathering.append(len(self.texts) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        """Ends the last open element of the name and all in it; an end without a beginning is passed over."""
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            ended = {i for _, i in self.open[at:] if i is not None}
            self.gathering = [i for i in self.gathering if i not in ended]
            del self.open[at:]

    def handle_data(self, data):
        for i in self.gathering:
            self.texts[i].append(data.replace(self.bare, "&"))


def selected(page: str | None, wanted: str, closed: bool = False) -> list[str] | None:
    """The texts of all elements that fit a selector; none is an empty list, a null page null.

    A browser also reads ``&amp`` without its semicolon as ``&``, and so is it read here, unless only ``closed``
    references are to be decoded: in a title cut in the middle of one, what is left of it then stays.
    """
    if page is None:
        return None
    page, bare = _only_closed(page) if closed else (page, "&")
    reader = _Selected(selector(wanted), bare)
    reader.feed(page)
    reader.close()
    return ["".join(x) for x in reader.texts]


def selected_texts(page: Column | str, wanted: str, closed: bool = False) -> Column:
    selector(wanted)  # a bad selector is an error here, not in a task
    return F.pandas_udf(lambda pages: pages.map(lambda x: selected(x, wanted, closed)), "array<string>")(page)


def _first_filled(page: str, wanted: str, closed: bool = False) -> str:
    """The text of the first element that fits, trimmed; '' without one."""
    return next(iter(selected(page, wanted, closed)), "").strip()


def layered(page: str | None, layers: str = TEXT_LAYERS, closed: bool = False) -> str | None:
    """The text layers of a document, a blank line between; null without text."""
    return "\n\n".join(selected(page, layers, closed) or []).strip() or None


def parts(page: str | None, wanted: Sequence[str] = ASSESSMENT, closed: bool = False) -> str | None:
    """The first element of each selector that has one with text, a line each; null without any."""
    return None if page is None else "\n".join(t for w in wanted if (t := _first_filled(page, w, closed))) or None


def item_text(page: Column | str, kind: Column | str, layers: str = TEXT_LAYERS, assessment: Sequence[str] = ASSESSMENT, topic: str = TOPIC, closed: bool = False) -> Column:
    """The text of a page by how its item is read (``content.classify``): file, assessment, discussion, else the visible text; ``closed`` as in ``selected``."""
    read = {"file": lambda x: layered(x, layers, closed), "assessment": lambda x: parts(x, assessment, closed), "discussion": lambda x: parts(x, [topic], closed)}

    def of(pages: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([read.get(k, lambda page: visible_text(page, closed))(x) or None for x, k in zip(pages, kinds, strict=True)], dtype="object")

    return F.pandas_udf(of, "string")(page, kind)
