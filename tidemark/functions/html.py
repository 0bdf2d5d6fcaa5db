"""HTML to text, Markdown and metadata, with the parser of the standard library in Arrow batches."""

from __future__ import annotations

import json
import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column

from tidemark.functions.batches import each
from tidemark.functions.text import SOCIAL_HOSTS, URL

_SILENT = {"script", "style", "nav", "header", "footer", "aside"}
_TEXT = {"p", "li", "blockquote", "h2", "h3"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end an open paragraph when they begin.
_BLOCK = _HEADINGS | {"p", "li", "ul", "ol", "blockquote", "div", "table", "section", "article", "pre"}
TEXT_LIMIT, SUMMARY_LIMIT, DESCRIPTION_LEAST, DESCRIPTION_LIMIT, MOST_LINKS = 20_000, 500, 50, 300, 10


class _Page(HTMLParser):
    """One pass that gathers everything the functions below need. An element's text is that of all elements in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.silent, self.open = 0, []
        self.blocks: list[tuple[str, list[str]]] = []  # tag and pieces of text, in the order in which they begin
        self.links: list[tuple[str, str]] = []
        self.meta: dict[str, str] = {}
        self.title: list[str] | None = None
        self._link: list | None = None

    def _begin(self, tag: str) -> None:
        if tag in _BLOCK:
            self._end("p")
        if tag == "li":
            self._end("li", {"ul", "ol"})
        block = (tag, [])
        self.open.append(block)
        if tag in _TEXT or tag in _HEADINGS:
            self.blocks.append(block)
        elif tag == "title" and self.title is None:
            self.title = block[1]

    def _end(self, tag: str, within: frozenset | set = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("content"):
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a["content"])
        if tag in _SILENT:
            self.silent += 1
        elif self.silent:
            return
        elif tag in _BLOCK or tag == "title":
            self._begin(tag)
        elif tag == "a" and a.get("href"):
            self._link = [a["href"].strip(), []]
            self.links.append(self._link)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            return
        elif tag == "a":
            self._link = None
        elif tag in _BLOCK or tag == "title":
            self._end(tag)

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if self.silent or not piece:
            return
        for _, parts in self.open:
            parts.append(piece)
        if self._link:
            self._link[1].append(piece)

    def first(self, tag: str, between: str = "") -> str:
        """Text of the first element that has any."""
        return next((x for t, parts in self.blocks if t == tag and (x := between.join(parts))), "")


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def followed(urls: list[str]) -> list[str]:
    """The first different http(s) URLs whose hosts are followed."""
    out: dict[str, None] = {}
    for url in map(str.strip, urls):
        host = re.match(r"https?://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", url, re.IGNORECASE)
        if url.startswith(("http://", "https://")) and host and host[1].lower() not in SOCIAL_HOSTS and len(out) < MOST_LINKS:
            out.setdefault(url)
    return list(out)


def links_of(html: str | None) -> list[str]:
    """All different links of a page as they stand in it."""
    return list(dict.fromkeys(h for h, _ in parse(html).links))


def text_of(html: str | None) -> dict:
    """Title (first h1, else title), text of the text blocks, the first of them, and the links followed."""
    page = parse(html)
    blocks = [x for tag, parts in page.blocks if tag in _TEXT and (x := " ".join(parts))]
    text = "\n\n".join(blocks)
    found = [re.sub(r"[.,;:!?]+$", "", u) for u in re.findall(URL, text)]
    return {
        "title": page.first("h1") or "".join(page.title or []),
        "text": text[:TEXT_LIMIT],
        "summary": blocks[0][:SUMMARY_LIMIT] if blocks else "",
        "links": followed([h for h, _ in page.links] + found),
    }


def fragment_text(html: str | None) -> str:
    """Text of a fragment: tags out, entities read, no blank before punctuation."""
    return re.sub(r" +([,.;:!?])", r"\1", _squeeze(unescape(re.sub(r"<[^>]+>", " ", html or ""))))


def markdown_of(html: str | None) -> str:
    """Headings, list items, quotes and paragraphs as Markdown."""
    marks = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "li": "- ", "blockquote": "> ", "p": ""}
    return "\n\n".join(marks[tag] + x for tag, parts in parse(html).blocks if tag in marks and (x := "".join(parts)))


def meta_of(html: str | None) -> dict:
    """Title, description and language of a page, and its card: OpenGraph, else Twitter."""
    page = parse(html)
    m = page.meta

    def first(*names: str) -> str | None:
        return next((m[n] for n in names if m.get(n)), None)

    start = page.first("p")
    return {
        "title": first("og:title") or "".join(page.title or []) or page.first("h1") or None,
        "description": first("og:description", "description") or (start[:DESCRIPTION_LIMIT] if len(start) > DESCRIPTION_LEAST else None),
        "lang": "ru" if any(ord(c) > 127 for c in (html or "")[:200]) else "en",
        **{f"og_{k}": first(f"og:{k}", *([f"twitter:{k}"] if k in ("title", "description", "image") else [])) for k in _CARD},
    }


_CARD = ("title", "description", "image", "url", "type", "site_name")


def _dated(value: object) -> str | None:
    """The first date of a JSON-LD value: its own, else one of what it holds by the keys that pages use."""
    if isinstance(value, list):
        return next((x for x in map(_dated, value) if x), None)
    if not isinstance(value, dict):
        return None
    own = value.get("datePublished") or value.get("dateCreated")
    return str(own) if own else next((x for x in (_dated(value.get(k)) for k in ("@graph", "mainEntity", "itemListElement")) if x), None)


def published_of(html: str | None) -> str | None:
    """When a page says in JSON-LD that it was published, as it is written there."""
    for body in re.findall(r"""<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", html or "", re.DOTALL | re.IGNORECASE):
        try:
            found = _dated(json.loads(body))
        except ValueError:
            continue
        if found:
            return found
    return None


def text_column(html: Column) -> Column:
    return each(text_of, "struct<title:string,text:string,summary:string,links:array<string>>", html)


def markdown_column(html: Column) -> Column:
    return each(markdown_of, "string", html)


def fragment_column(html: Column) -> Column:
    return each(fragment_text, "string", html)


def meta_column(html: Column) -> Column:
    return each(meta_of, "struct<" + ",".join(f"{x}:string" for x in ("title", "description", "lang", *[f"og_{k}" for k in _CARD])) + ">", html)


def links_column(html: Column) -> Column:
    return each(links_of, "array<string>", html)


def published_column(html: Column) -> Column:
    return each(published_of, "string", html)
