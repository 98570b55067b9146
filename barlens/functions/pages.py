"""The quarterly table of a page, by one pass over its tags that keeps them balanced."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SECTION = "quarters"
LABEL_CHARS = 200
# Fixed values of HTML: elements without an end tag, and those that end where another begins or what they are in ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDED_BY = {
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "tr": frozenset({"td", "th", "tr"}),
    **{part: frozenset({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}) for part in ("thead", "tbody", "tfoot")},
    "li": frozenset({"li"}), "option": frozenset({"option"}), "p": frozenset({"p"}),
}
AROUND_TABLES = frozenset({"section", "article", "main", "body", "html"})
SILENT = frozenset({"script", "style", "template"})


class _Quarters(HTMLParser):
    """The first element whose id is that of the section, its text, and the head and body of its first table. Rows
    of a table within a cell belong to that cell's text. End tags without a start are left out, and what is still open
    within an element ends with it; but an end tag does not reach out of a cell or a table, unless it is of a part of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.section = self.table = None  # where they stand among the open elements
        self.done = self.has_table = False
        self.said: list[str] = []
        self.heads: list[str] = []
        self.lines: list[list[list[str]]] = []
        self.part: str | None = None  # thead or tbody of the table, the first of each
        self.seen_parts: set[str] = set()
        self.cell: list[str] | None = None

    def _end_from(self, at: int) -> None:
        """Closes the open elements from a place on."""
        del self.open[at:]
        if self.table is not None and at <= self.table + 3 and not self._within("td", "th"):
            self.cell = None
        if self.table is not None and not any(t in ("thead", "tbody") for t in self.open[self.table + 1 :]):
            self.part = None
        if self.table is not None and at <= self.table:
            self.table, self.part, self.cell, self.done = None, None, None, True
        if self.section is not None and at <= self.section:
            self.section, self.done = None, True

    def _within(self, *tags: str) -> bool:
        return self.table is not None and any(t in tags for t in self.open[self.table + 1 :])

    def _inner(self) -> int:
        """The place after the innermost open table."""
        return max((k + 1 for k, t in enumerate(self.open) if t == "table"), default=0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        if ended := ENDED_BY.get(tag):
            at = self._inner()
            stands = [k for k in range(at, len(self.open)) if self.open[k] in ended]
            if tag in ("p", "li", "option"):
                stands = stands[-1:] if self.open and self.open[-1] in ended else []
            if stands:
                self._end_from(stands[0])
        self.open.append(tag)
        if self.done:
            return
        if self.section is None:
            if dict(attrs).get("id") == SECTION:
                self.section = len(self.open) - 1
            return
        if tag == "table" and self.table is None:
            self.table, self.has_table = len(self.open) - 1, True
        elif self.table is not None and self._inner() == self.table + 1:
            if tag in ("thead", "tbody") and tag not in self.seen_parts:
                self.part = tag
                self.seen_parts.add(tag)
            elif tag == "tr" and self.part == "tbody":
                self.lines.append([])
            elif tag == "th" and self.part == "thead":
                self.cell = []
                self.heads.append(self.cell)  # type: ignore[arg-type]
            elif tag in ("td", "th") and self.part == "tbody" and self.lines:
                self.cell = []
                self.lines[-1].append(self.cell)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers read it, only void elements end at once

    def handle_endtag(self, tag: str) -> None:
        least = 0
        if tag not in AROUND_TABLES:
            bound = ("table",) if tag in ("table", "tr", "td", "th", "thead", "tbody", "tfoot") else ("table", "td", "th")
            least = max((k + (t != tag or tag != "table") for k, t in enumerate(self.open) if t in bound), default=0)
        for at in range(len(self.open) - 1, least - 1, -1):
            if self.open[at] == tag:
                self._end_from(at)
                return

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())  # of any white space, as a label is compared
        if not text or self.section is None or any(t in SILENT for t in self.open[-1:]):
            return
        self.said.append(text)
        if self.cell is not None:
            self.cell.append(text)


def quarters(html: str | None) -> tuple[bool, str, list[str], list[list[str]]]:
    """(whether the section has a table, the beginning of its text, the heads of the table, its rows of cells)."""
    parser = _Quarters()
    parser.feed(html or "")
    parser.close()
    rows = [[" ".join(c) if k == 0 else "".join(c) for k, c in enumerate(line)] for line in parser.lines if line]
    return parser.has_table, " ".join(parser.said)[:LABEL_CHARS], ["".join(h) for h in parser.heads], rows


def with_quarters(pages: DataFrame) -> DataFrame:
    """(symbol, url, is_consolidated_url) of pages, with has_table, label, heads and lines of their quarterly table."""
    kept = ("symbol", "url", "is_consolidated_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                read = [quarters(html) for html in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *(pa.array([r[k] for r in read], kind) for k, kind in enumerate(kinds))], names=[*kept, "has_table", "label", "heads", "lines"]
                )

    made = "has_table boolean, label string, heads array<string>, lines array<array<string>>"
    return pages.select(*kept, "html").mapInArrow(run, f"symbol string, url string, is_consolidated_url boolean, {made}")
