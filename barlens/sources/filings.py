"""Quarterly filings from an exchange's index with XBRL documents, and from pages with a quarterly table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.config import Fundamentals
from barlens.functions.pages import with_quarters
from barlens.functions.text import month_end, number, quarter_start, row_label, xbrl, xbrl_day, xbrl_fact

# Names of facts in the exchange's taxonomy, and the context of the quarter.
FACTS = {
    "revenue": ("RevenueFromOperations", "Revenue"),
    "pat": ("ProfitLossForPeriod", "ProfitLossForThePeriod", "ProfitLossForPeriodFromContinuingOperations"),
    "basic_eps": ("BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations", "BasicEarningsLossPerShareFromContinuingOperations", "BasicEarningsPerShare"),
    "diluted_eps": ("DilutedEarningsLossPerShareFromContinuingAndDiscontinuedOperations", "DilutedEarningsLossPerShareFromContinuingOperations", "DilutedEarningsPerShare"),
}
QUARTER = "OneD"
#: Amounts of quarterly tables are in crores.
CRORE = 1e7

INDEX_SCHEMA = "symbol string, audited string, consolidated string, broadCastDate string, fromDate string, toDate string, xbrl string"


def filing_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Index rows that name a broadcast date and a document, from JSON arrays: one a file, or one a line, as many
    answers are kept in files that can be split."""
    rows = spark.read.schema(INDEX_SCHEMA).json(path, multiLine=not lines)
    return rows.filter("coalesce(broadCastDate, '') <> '' and coalesce(xbrl, '') <> ''")


def index_request(symbol: str, start, end) -> dict[str, str]:
    """The query of the index for a symbol and dates."""
    return {"index": "equities", "period": "Quarterly", "symbol": symbol.upper(), "from_date": start.strftime("%d-%m-%Y"), "to_date": end.strftime("%d-%m-%Y")}


def xbrl_filings(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Filings of index rows and the documents (xbrl: address, xml: text) they link to.

    Where a document names no period, that of the index counts; without any the filing is left out, as it is
    where the text is no well-formed XBRL document. fields_missing: it has none of revenue, profit and earnings per share.
    """
    parsed = documents.filter(F.col("xml").contains("xbrl")).select("xbrl", xbrl(F.col("xml"), [n for names in FACTS.values() for n in names]).alias("document"))
    d = index.join(parsed.filter("document.bad is null"), "xbrl")
    day = lambda name: xbrl_day(F.col("document"), name, QUARTER)
    d = d.withColumns({"period_start": F.coalesce(day("startDate"), F.try_to_date("fromDate", "dd-MMM-yyyy")), "period_end": F.coalesce(day("endDate"), F.try_to_date("toDate", "dd-MMM-yyyy"))})
    d = d.withColumns({k: xbrl_fact(F.col("document"), names, QUARTER) for k, names in FACTS.items()})
    return d.filter("period_start is not null and period_end is not null").select(
        F.upper("symbol").alias("symbol"), "period_start", "period_end", F.to_date("broadCastDate", "dd-MMM-yyyy HH:mm:ss").alias("announcement_date"),
        (F.col("consolidated") == "Consolidated").alias("is_consolidated"), (F.col("audited") == "Audited").alias("is_audited"), "revenue", "pat", "basic_eps", "diluted_eps",
        F.lit(None).cast("double").alias("shares_outstanding"), F.lit("nse_xbrl").alias("source"), F.col("xbrl").alias("source_url"),
        (F.col("revenue").isNull() & F.col("pat").isNull() & F.col("basic_eps").isNull()).alias("fields_missing"), F.lit(False).alias("announcement_date_is_estimated"),
    )


def best_pages(pages: DataFrame) -> DataFrame:
    """One page per symbol of (symbol, url, html, is_consolidated_url), with heads and lines of its table: the
    consolidated one if it has a quarterly table, else the standalone. What a page says of itself decides whether
    it is consolidated."""
    p = with_quarters(pages).filter("has_table")
    p = p.withColumn("is_consolidated", F.col("is_consolidated_url") & F.lower("label").contains("consolidated"))
    best = F.max_by(F.struct("url", "is_consolidated", "heads", "lines"), F.col("is_consolidated_url"))
    return p.groupBy("symbol").agg(best.alias("b")).select("symbol", "b.*")


def table_filings(pages: DataFrame, config: Fundamentals = Fundamentals(), start: str | None = None, end: str | None = None) -> DataFrame:
    """Filings of the quarterly tables of pages, one for each column headed by a month; announcements are
    estimated from the lag allowed by regulation, and only those from start to end (ISO dates) are given."""
    p = best_pages(pages)

    def line(label: str):
        """The last row of a label, null where there is none."""
        return F.try_element_at(F.filter("lines", lambda x: row_label(F.get(x, F.lit(0))) == label), F.lit(-1))

    p = p.filter(F.size("lines") > 0)
    p = p.withColumns({"sales": line("sales"), "profit": line("net profit"), "eps": line("eps in rs")})
    q = p.select("symbol", "url", "is_consolidated", "sales", "profit", "eps", F.posexplode("heads").alias("at", "head")).filter("at > 0")
    q = q.withColumn("period_end", month_end(F.col("head"))).filter("period_end is not null")
    value = lambda c: number(F.get(F.col(c), F.col("at")))
    q = q.withColumns({"revenue": value("sales") * CRORE, "pat": value("profit") * CRORE, "basic_eps": value("eps"), "is_audited": F.month("period_end") == 3})
    lag = F.when(F.col("is_audited"), config.annual_lag_days).otherwise(config.quarter_lag_days)
    out = q.select(
        F.upper("symbol").alias("symbol"), quarter_start(F.col("period_end")).alias("period_start"), "period_end", F.date_add("period_end", lag).alias("announcement_date"), "is_consolidated", "is_audited",
        "revenue", "pat", "basic_eps", F.col("basic_eps").alias("diluted_eps"), F.lit(None).cast("double").alias("shares_outstanding"), F.lit("screener").alias("source"), F.col("url").alias("source_url"),
        (F.col("revenue").isNull() & F.col("pat").isNull() & F.col("basic_eps").isNull()).alias("fields_missing"), F.lit(True).alias("announcement_date_is_estimated"),
    )
    if start is not None:
        out = out.filter(F.col("announcement_date") >= F.lit(start).cast("date"))
    return out if end is None else out.filter(F.col("announcement_date") <= F.lit(end).cast("date"))
