"""Readable text or Markdown from HTML: content root, boilerplate, blocks and lists; an Arrow-batched function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SKIP = frozenset(("script", "style", "noscript", "head", "title", "meta", "link", "svg"))
BOILERPLATE = frozenset(("nav", "footer", "header", "aside", "form", "iframe"))
_NAMED = re.compile(r"\b(nav|menu|footer|sidebar|ads?|advert(isement)?|comment|social|breadcrumb|cookie|popup|share)\b", re.I)
BLOCKS = frozenset(("p", "div", "section", "article", "main", "blockquote", "pre", "table", "tr", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_CLOSES_P = BLOCKS | {"header", "footer", "nav", "aside", "form", "hr", "dl", "figure", "fieldset", "address"}
_AUTO = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "body": ({"head"}, set())}


@dataclass
class Element:
    tag: str
    attrs: dict = field(default_factory=dict)
    inner: list = field(default_factory=list)


class _Tree(HTMLParser):
    """Elements by HTML's rules for omitted end tags, at any depth; where each tag is open is kept, so that no tag walks the stack."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.open = [self.root]
        self.where: dict[str, list[int]] = {}

    def _last(self, tags: set) -> int:
        return max([places[-1] for t in tags if (places := self.where.get(t))], default=0)

    def _end(self, tags: set, bounds: set) -> None:
        i = self._last(tags)
        if i and i > self._last(bounds):
            while len(self.open) > i:
                self.where[self.open.pop().tag].pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES_P:
            self._end({"p"}, {"td", "th", "li", "div", "table"})
        if tag in _AUTO:
            self._end(*_AUTO[tag])
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inner.append(e)
        if tag not in VOID:
            self.where.setdefault(tag, []).append(len(self.open))
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._end({tag}, set() if tag in ("table", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot") else {"table"})

    def handle_data(self, data: str) -> None:
        self.open[-1].inner.append(data)


def _first(e: Element, tag: str) -> Element | None:
    todo = [e]
    while todo:
        x = todo.pop()
        if x.tag == tag:
            return x
        todo += [y for y in reversed(x.inner) if isinstance(y, Element)]
    return None


class _Out:
    """Text under construction."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.tail = ""

    def add(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.tail = (self.tail + s[-2:])[-2:]

    def blank(self) -> None:
        if self.tail:
            self.add("" if self.tail.endswith("\n") else "\n")
            self.add("" if self.tail == "\n\n" else "\n")


Steps = Iterator["Steps"]


class _Writer:
    """Rendering by generators that yield the generators of what is inside, so that depth costs no Python stack."""

    def __init__(self, strip: bool, markdown: bool, headings: bool, lists: bool, links: bool) -> None:
        self.strip, self.headings, self.lists, self.links = strip, markdown and headings, markdown and lists, markdown and links

    def run(self, e: Element) -> str:
        out = _Out()
        stack = [self.element(e, out)]
        while stack:
            inner = next(stack[-1], None)
            if inner is None:
                stack.pop()
            else:
                stack.append(inner)
        return "".join(out.parts)

    def dropped(self, e: Element) -> bool:
        return e.tag in SKIP or self.strip and (e.tag in BOILERPLATE or any(_NAMED.search(e.attrs.get(k, "")) for k in ("class", "id")))

    def children(self, e: Element, out: _Out) -> Steps:
        for x in e.inner:
            if isinstance(x, str):
                out.add(x)
            else:
                yield self.element(x, out)

    def element(self, e: Element, out: _Out) -> Steps:
        if self.dropped(e):
            return
        if e.tag == "br":
            out.add("\n")
        elif e.tag in ("ul", "ol"):
            out.blank()
            items = (x for x in e.inner if isinstance(x, Element) and x.tag == "li" and not self.dropped(x))
            for i, x in enumerate(items, 1):
                out.add((f"{i}. " if e.tag == "ol" else "- ") if self.lists else "")
                yield self.children(x, out)
                out.add("\n")
            out.blank()
        elif e.tag in BLOCKS:
            out.blank()
            if self.headings and e.tag[0] == "h" and e.tag[1:].isdigit():
                out.add("#" * int(e.tag[1:]) + " ")
            yield self.children(e, out)
            out.blank()
        elif e.tag == "a" and self.links and "href" in e.attrs:
            own = _Out()
            yield self.children(e, own)
            label = "".join(own.parts).strip()
            out.add(f"[{label}]({e.attrs['href']})" if label else "")
        else:
            yield self.children(e, out)


def normalise(text: str) -> str:
    """Blanks to one, at most one empty line, lines and the whole trimmed, in this order."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text))
    return "\n".join(x.strip() for x in text.split("\n")).strip()


def render(html: str | None, strip_boilerplate: bool = True, markdown: bool = False, keep_headings: bool = True, keep_lists: bool = True, keep_links: bool = False) -> str:
    """Text of the first article, else main, else body, else of the whole page."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    root = next((x for t in ("article", "main", "body") if (x := _first(tree.root, t)) is not None), tree.root)
    return normalise(_Writer(strip_boilerplate, markdown, keep_headings, keep_lists, keep_links).run(root))


def extract(html: Column, **options: bool) -> Column:
    """render over a column; options are its arguments."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: render(x, **options))

    return run(html)
