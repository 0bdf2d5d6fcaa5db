"""Elements of pages by CSS selectors: a small tree from the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import Column

from tidemark.functions.batches import each

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that a start tag of the same kind ends, unless one of the others is open in between.
_ENDS = {"p": frozenset(), "li": frozenset({"ul", "ol"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"tr", "table"}), "option": frozenset({"select"})}
_BLOCKS = {"p", "div", "ul", "ol", "li", "article", "section", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "header", "footer", "nav", "aside", "main"}


class Element:
    __slots__ = ("attrs", "children", "classes", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = frozenset(attrs.get("class", "").split())
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """All elements inside, in the order of the page."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Element):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        return re.sub(r"\s+", " ", " ".join(x.strip() for x in self._pieces() if x.strip())).strip()

    def _pieces(self) -> list[str]:
        out, stack = [], [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    out.append(child)
                elif child.tag not in ("script", "style"):
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()
        return out


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("", {}, None)

    def _end(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        at = self.here
        while at.parent is not None:
            if at.tag == tag:
                self.here = at.parent
                return
            if at.tag in within:
                return
            at = at.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS:
            self._end("p")
        if tag in _ENDS:
            self._end(tag, _ENDS[tag])
        new = Element(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(new)
        if tag not in _VOID:
            self.here = new

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.here.tag == tag and tag not in _VOID:
            self.here = self.here.parent

    def handle_endtag(self, tag: str) -> None:
        self._end(tag)

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)


def tree(html: str | None) -> Element:
    out = _Tree()
    out.feed(html or "")
    out.close()
    return out.root


_PART = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)?(?P<rest>(?:\#[\w-]+|\.[\w-]+|\[[^\]]*\])*)$""")
_REST = re.compile(r"""\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*["']?([^"'\]]*)["']?\s*)?\]""")
_TESTS = {"=": lambda a, b: a == b, "^=": lambda a, b: a.startswith(b), "$=": lambda a, b: a.endswith(b), "*=": lambda a, b: b in a, "~=": lambda a, b: b in a.split()}


class Simple:
    """A tag, id, classes and attributes of one element."""

    def __init__(self, text: str) -> None:
        found = _PART.match(text)
        if not text or not found:
            raise ValueError(f"not a selector: {text!r}")
        self.tag = (found["tag"] or "*").lower()
        self.id, self.classes, self.attrs = None, set(), []
        for name, kind, attr, test, value in _REST.findall(found["rest"]):
            if name:
                self.id = name
            elif kind:
                self.classes.add(kind)
            else:
                self.attrs.append((attr.lower(), test, value))

    def matches(self, e: Element) -> bool:
        return (
            self.tag in ("*", e.tag) and (self.id is None or e.attrs.get("id") == self.id) and self.classes <= e.classes
            and all(a in e.attrs and (not test or bool(value or test == "=") and _TESTS[test](e.attrs[a], value)) for a, test, value in self.attrs)
        )


@lru_cache(maxsize=256)
def compiled(selector: str) -> list[list[tuple[str, Simple]]]:
    """For each alternative (between commas) its parts from right to left, each with what links it to the part on its right:
    a blank (somewhere inside) or ``>`` (a child)."""
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        tokens = re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", one)
        if not tokens or tokens[0] == ">" or tokens[-1] == ">":
            raise ValueError(f"not a selector: {selector!r}")
        parts, link = [], ""
        for token in reversed(tokens):
            if token == ">":
                link = ">"
            else:
                parts.append((link or " ", Simple(token)))
                link = ""
        out.append(parts)
    return out


def _holds(e: Element, parts: list[tuple[str, Simple]], i: int) -> bool:
    if not parts[i][1].matches(e):
        return False
    if i + 1 == len(parts):
        return True
    up = e.parent
    while up is not None and up.tag:
        if _holds(up, parts, i + 1):
            return True
        if parts[i + 1][0] == ">":
            return False
        up = up.parent
    return False


def select(root: Element, selector: str, most: int | None = None) -> list[Element]:
    """Elements inside ``root`` that some alternative of the selector picks, in the order of the page."""
    out = []
    for e in root.walk():
        if any(_holds(e, parts, 0) for parts in compiled(selector)):
            out.append(e)
            if len(out) == most:
                break
    return out


#: What a listing is read by where nothing is set.
LISTING, LINK, TITLE, DATE = "article, .post, .item", "a[href]", "h1, h2, h3, a[href]", "time"


def listed(html: str | None, listing: str = LISTING, link: str = LINK, title: str = TITLE, date: str = DATE, most: int = 20) -> list[dict]:
    """The first ``most`` items of a listing page: link as it stands, title, date, text; those without a link are left out."""
    out = []
    for item in select(tree(html), listing, most):
        a, head, when = (next(iter(select(item, s, 1)), None) for s in (link, title, date))
        href = a.attrs.get("href", "").strip() if a else ""
        if href:
            at = (when.attrs.get("datetime") or when.text()) if when else ""
            out.append({"href": href, "title": (head.text() if head else "") or href, "date": at or None, "summary": item.text()})
    return out


def listed_column(html: Column, listing: str = "", link: str = "", title: str = "", date: str = "", most: int = 20) -> Column:
    """Items of listing pages as an array of structs; an empty selector stands for the usual one."""
    chosen = (listing or LISTING, link or LINK, title or TITLE, date or DATE)
    for s in chosen:
        compiled(s)  # a wrong one fails here

    return each(lambda x: listed(x, *chosen, most), "array<struct<href:string,title:string,date:string,summary:string>>", html)


def texts_column(html: Column, selector: str) -> Column:
    """Texts of all elements that a selector picks."""
    compiled(selector)

    return each(lambda x: [e.text() for e in select(tree(x), selector)], "array<string>", html)
