"""HTML pages to text and records, with the standard library's parser inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that are left out, those whose text is read, and others that end a paragraph. Fixed values.
DROPPED = frozenset(["script", "style", "noscript", "svg", "nav", "footer", "header", "form"])
READ = frozenset(["p", "li", "h1", "h2", "h3"])
_ENDS_P = READ | frozenset(["h4", "h5", "h6", "div", "section", "article", "main", "aside", "ul", "ol", "dl", "table", "blockquote", "pre", "hr", "figure", "fieldset", "details", "address"]) | DROPPED - {"script", "style", "noscript", "svg"}
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
#: Words of the domain; blocks with one are preferred where so many have one. Fixed values.
TERMS = ["esg", "sustainability", "climate", "emissions", "net zero", "decarbonization", "disclosure", "reporting", "regulation", "transition", "supply chain", "green finance", "investor", "risk"]
ENOUGH = 4
#: Meta elements that date a page, the first that is there. Fixed values.
PUBLISHED = [("property", "article:published_time"), ("name", "date"), ("name", "dc.date")]
UPDATED = [("property", "article:modified_time"), ("name", "last-modified"), ("name", "updated")]
_DATES = ["%Y/%m/%d", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y", "%B %d %Y", "%b %d %Y", "%m/%d/%Y"]


def clean(text: str) -> str:
    """White space as single spaces, no NUL, none at the ends."""
    return re.sub(r"\s+", " ", text).replace("\0", "").strip()


class _Article(HTMLParser):
    """The texts of paragraphs, items and headings in the order in which they begin, outside dropped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list[str]] = []
        self.meta: dict[tuple[str, str], str] = {}
        self.time: str | None = None
        self.title = ""
        self._open: list[tuple[str, list[str] | None]] = []
        self._dropped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        got = {k: v for k, v in attrs if v}
        if self._dropped:
            self._dropped += tag in DROPPED
            return
        if tag == "meta" and "content" in got:
            for kind in ("property", "name"):
                if kind in got:
                    self.meta.setdefault((kind, got[kind]), got["content"])
        if tag == "time" and self.time is None:
            self.time = got.get("datetime")
        if tag in _ENDS_P:
            self._end("p", {"button"})
        if tag == "li":
            self._end("li", {"ul", "ol"})
        if tag in DROPPED:
            self._dropped = 1
        elif tag not in _VOID:
            block: list[str] | None = [] if tag in READ else None
            if block is not None:
                self.blocks.append(block)
            self._open.append((tag, block))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, a slash opens an element that is not void
        if tag == "svg":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._dropped:
            self._dropped -= tag in DROPPED
        else:
            self._end(tag, set())

    def _end(self, tag: str, within: set[str]) -> None:
        """Ends the innermost open ``tag``, unless an element of ``within`` is opened inside it."""
        for i in reversed(range(len(self._open))):
            if self._open[i][0] == tag:
                del self._open[i:]
                return
            if self._open[i][0] in within:
                return

    def handle_data(self, data: str) -> None:
        if self._dropped:
            return
        if self._open and self._open[-1][0] == "title":
            self.title += data
        for _, block in self._open:
            if block is not None:
                block.append(data)


def parse(html: str | None) -> _Article:
    parser = _Article()
    parser.feed(html or "")
    parser.close()
    return parser


def page_date(value: str | None, latest: date) -> str | None:
    """A date as YYYY-MM-DD in UTC; null for a bare year, for no date and for one after ``latest``."""
    value = (value or "").strip()
    if not value or re.fullmatch(r"(19|20)\d\d", value):
        return None
    found = None
    try:
        found = datetime.fromisoformat(value)
    except ValueError:
        for form in _DATES:
            try:
                found = datetime.strptime(value, form)
                break
            except ValueError:
                continue
        else:
            try:
                found = parsedate_to_datetime(value)
            except (ValueError, TypeError):
                return None
    if found.tzinfo:
        found = found.astimezone(UTC)
    return found.date().isoformat() if found.date() <= latest else None


def _extract(shortest: int, most_blocks: int, most_chars: int, terms: list[str], latest: date):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for html in batch.column(1).to_pylist():
                page = parse(html)
                blocks = [b for b in (clean("".join(parts)) for parts in page.blocks) if len(b) >= shortest]
                named = [b for b in blocks if any(t in b.lower() for t in terms)]
                kept = named if len(named) >= ENOUGH else blocks
                published = next((page.meta[m] for m in PUBLISHED if m in page.meta), page.time)
                updated = next((page.meta[m] for m in UPDATED if m in page.meta), None)
                for column, value in zip(columns, (clean(page.title), " ".join(kept[:most_blocks])[:most_chars], page_date(published, latest), page_date(updated, latest)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], [batch.schema.names[0], "title", "article", "published", "updated"])

    return run


def article_text(
    pages: DataFrame, key: str = "page_id", html: str = "html", shortest: int = 45, most_blocks: int = 18, most_chars: int = 4500, terms: list[str] | None = None, today: date | None = None
) -> DataFrame:
    """key, title, article, published, updated: the first long blocks of each page, and its dates.

    Blocks are paragraphs, items and headings outside scripts, styles and chrome, of ``shortest`` characters
    or more; a block inside another counts in both. If ENOUGH of them have a word of ``terms`` (TERMS),
    only these are taken. Dates more than two days ahead of ``today`` count for nothing. Null and empty
    pages have an empty title and article.
    """
    kind = pages.schema[key].dataType.simpleString()
    latest = (today or datetime.now(UTC).date()) + timedelta(days=2)
    run = _extract(shortest, most_blocks, most_chars, TERMS if terms is None else terms, latest)
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, title string, article string, published string, updated string")


class _Rows(HTMLParser):
    """The cells of every table row, or the items of every list."""

    def __init__(self, row: str, cell: str) -> None:
        super().__init__(convert_charrefs=True)
        self.row, self.cell = row, cell
        self.rows: list[list[str]] = []
        self._cells: list[str] | None = None
        self._text: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == self.row:
            self._cells = []
        elif tag == self.cell and self._cells is not None:
            self._text = []

    def handle_endtag(self, tag: str) -> None:
        if tag == self.cell and self._text is not None:
            self._cells.append(" ".join("".join(self._text).split()))
            self._text = None
        elif tag == self.row and self._cells is not None:
            self.rows.append(self._cells)
            self._cells = None

    def handle_data(self, data: str) -> None:
        if self._text is not None:
            self._text.append(data)


def _row_reader(row: str, cell: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for html in batch.column(1).to_pylist():
                parser = _Rows(row, cell)
                parser.feed(html or "")
                parser.close()
                found.append(parser.rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.list_(pa.string())))], [batch.schema.names[0], "rows"])

    return run


def page_rows(pages: DataFrame, key: str = "page_id", html: str = "html", row: str = "tr", cell: str = "td") -> DataFrame:
    """key, position, cells: a row for each element ``row``, with the texts of its ``cell`` elements."""
    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(key, html).mapInArrow(_row_reader(row, cell), f"{key} {kind}, rows array<array<string>>")
    return found.select(key, F.posexplode("rows").alias("position", "cells"))
