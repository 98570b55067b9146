"""Column functions for cells of pages and documents; all are built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(cell: Column) -> Column:
    """A cell's number without thousands separators and percent signs; empty cells, dashes and other text are null."""
    return F.trim(F.regexp_replace(cell, "[,%]", "")).try_cast("double")


def month_end(header: Column) -> Column:
    """The last day of a month written like Mar 2024; null for other text."""
    clean = F.trim(header)
    return F.last_day(F.when(clean.rlike(r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{4}$"), F.to_date(F.concat(F.lit("01 "), clean), "dd MMM yyyy")))


def quarter_start(end: Column) -> Column:
    """The first day of the month two before that of end."""
    return F.add_months(F.date_trunc("month", end).cast("date"), -2)


def row_label(text: Column) -> Column:
    """A row's label in lower case without the plus sign that unfolds it."""
    return F.lower(F.trim(F.regexp_replace(F.trim(text), r"\++$", "")))


def xbrl(xml: Column, names: list[str]) -> Column:
    """A document as Spark's XML parser reads it, prefixes left out: its contexts with their periods, the named
    facts with the contexts they are of, and bad, which is not null where the text is no well-formed document."""
    fact = "array<struct<_contextRef: string, _VALUE: string>>"
    fields = ["context: array<struct<_id: string, period: struct<startDate: string, endDate: string>>>", *(f"{n}: {fact}" for n in names), "bad: string"]
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "attributePrefix": "_", "valueTag": "_VALUE"}
    return F.from_xml(xml, f"struct<{', '.join(fields)}>", options)


def xbrl_fact(document: Column, names: tuple[str, ...], context: str) -> Column:
    """The first number of the first of the named facts that has one in a context."""
    numbers = lambda n: F.transform(F.filter(document[n], lambda f: f["_contextRef"] == context), lambda f: F.trim(f["_VALUE"]).try_cast("double"))
    return F.coalesce(*(F.get(F.array_compact(numbers(n)), F.lit(0)) for n in names))


def xbrl_day(document: Column, name: str, context: str) -> Column:
    """The startDate or endDate of a context; null where it has none."""
    found = F.get(F.filter(document["context"], lambda c: c["_id"] == context), F.lit(0))
    return F.try_to_date(F.trim(found["period"][name]), "yyyy-MM-dd")
