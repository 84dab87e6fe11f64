"""HTML pages to title, cleaned body, text and images, in Arrow batches over the standard tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import resolve

#: Elements that are dropped with all they hold, that break lines, that have no end tag.
DROPPED = frozenset("script style noscript iframe svg canvas template form nav header footer aside object embed".split())
LINE_BREAKING = frozenset("p div br li tr section article h1 h2 h3 h4 h5 h6 blockquote pre td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the same kind when they begin.
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


@dataclass
class Page:
    title: str = ""
    clean_html: str = ""
    text: str = ""
    images: list[dict] = field(default_factory=list)


def collapse(text: str) -> str:
    """Lines with their white space collapsed, at most one empty line in a row, none at the ends."""
    out: list[str] = []
    for line in (" ".join(x.split()) for x in text.split("\n")):
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


def _pixels(value: str | None) -> int:
    digits = (value or "").strip().removesuffix("px")
    return int(digits) if digits.isdigit() else 0


class _Cleaner(HTMLParser):
    """One pass over a page; end tags that are missing are implied."""

    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.page = base, Page()
        self.open: list[str] = []
        self.dropped: list[str] = []
        self.html: list[str] = []
        self.text: list[str] = []
        self.in_title = self.in_body = self.saw_body = False
        self.seen: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "title":
            self.in_title = not self.page.title and not self.saw_body
        elif tag == "body":
            if not self.saw_body:  # what came before belongs to the head
                self.html.clear()
                self.text.clear()
                self.saw_body = True
        elif tag == "img":
            self._image(dict(attrs))
        if self.dropped:
            if tag == self.dropped[-1] and tag not in VOID:
                self.dropped.append(tag)
            return
        if tag in DROPPED:
            if tag not in VOID:
                self.dropped.append(tag)
            return
        if tag in ("html", "head", "body", "title", "meta", "link"):
            return
        while self.open and self.open[-1] in _CLOSES.get(tag, ()):
            self._close(self.open[-1])
        if tag in LINE_BREAKING:
            self.text.append("\n")
        self.html.append(f"<{tag}{''.join(f' {k}="{escape(v or "")}"' for k, v in attrs)}>")
        if tag not in VOID:
            self.open.append(tag)

    def _close(self, tag: str) -> None:
        while self.open:
            last = self.open.pop()
            self.html.append(f"</{last}>")
            if last in LINE_BREAKING:
                self.text.append("\n")
            if last == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if self.dropped:
            if tag == self.dropped[-1]:
                self.dropped.pop()
        elif tag in self.open:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.page.title = self.page.title or data.strip()
        elif not self.dropped:
            self.html.append(escape(data, quote=False))
            self.text.append(data)

    def _image(self, attrs: dict[str, str | None]) -> None:
        url = resolve(self.base, attrs.get("src") or attrs.get("data-src")) if attrs.get("src") or attrs.get("data-src") else ""
        if url and url not in self.seen:
            self.seen.add(url)
            self.page.images.append({"url": url, "alt": attrs.get("alt") or "", "width": _pixels(attrs.get("width")), "height": _pixels(attrs.get("height"))})


def clean_page(html: str | None, base: str | None = None) -> Page:
    """Title, pruned HTML, text and images of a page; empty parts for a null or empty page."""
    parser = _Cleaner(base)
    parser.feed(html or "")
    parser.close()
    while parser.open:
        parser._close(parser.open[-1])
    page = parser.page
    page.clean_html, page.text = "".join(parser.html).strip(), collapse("".join(parser.text))
    return page


_IMAGE = pa.struct([("url", pa.string()), ("alt", pa.string()), ("width", pa.int32()), ("height", pa.int32())])


def cleaned(pages: DataFrame, id_column: str = "id", html_column: str = "raw_html", url_column: str = "url") -> DataFrame:
    """(id, title, clean_html, text, images) of every row with HTML; rows without give none. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [clean_page(h, u) for h, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d.title for d in done], pa.string()), pa.array([d.clean_html for d in done], pa.string()), pa.array([d.text for d in done], pa.string()), pa.array([d.images for d in done], pa.list_(_IMAGE))],
                names=["id", "title", "clean_html", "text", "images"],
            )

    chosen = pages.select(F.col(id_column).cast("string").alias("id"), html_column, url_column).where(F.col(html_column).isNotNull())
    return chosen.mapInArrow(run, "id string, title string, clean_html string, text string, images array<struct<url: string, alt: string, width: int, height: int>>")


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.depth, self.inside, self.all = 0, [], []
        self.roots: frozenset[str] = frozenset()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if tag not in VOID and (self.depth or named.get("id") in self.roots):
            self.depth += 1
        if tag == "a" and named.get("href"):
            self.all.append(named["href"])
            if self.depth:
                self.inside.append(named["href"])

    def handle_endtag(self, tag: str) -> None:
        self.depth = max(0, self.depth - 1)


def result_links(html: str | None, roots: frozenset[str] = frozenset({"rso", "search", "b_results", "links"})) -> list[str]:
    """Links of a result page: those inside its result blocks, or all where it has none; each once, in order."""
    parser = _Links()
    parser.roots = roots
    parser.feed(html or "")
    return list(dict.fromkeys(parser.inside or parser.all))


def title_of(html: Column) -> Column:
    """Title by expression alone; entities stay as they are."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
