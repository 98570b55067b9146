"""Quarterly filings: preference, validity, lag, growth against the same quarter a year before, as they are now and as
they were known at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.config import Fundamentals
from barlens.operators.bars import delta_start, latest_per_symbol

# Days before a quarter's end between which the quarter to compare with ends, and the best distance.
BAND, NEAREST = (320, 410), 365


def preferred(filings: DataFrame, arrival: str) -> DataFrame:
    """One filing per symbol and period end: a consolidated one if there is any, else the first to arrive."""
    rest = [c for c in filings.columns if c not in ("symbol", "period_end")]
    order = F.struct(F.when(F.coalesce("is_consolidated", F.lit(False)), 0).otherwise(1), F.col(arrival))
    return filings.groupBy("symbol", "period_end").agg(F.min_by(F.struct(*rest), order).alias("_f")).select("symbol", "period_end", *(F.col(f"_f.{c}").alias(c) for c in rest))


def due(filings: DataFrame, existing: DataFrame, initial: str, end_date: str) -> DataFrame:
    """The filings announced after what is stored of their symbol (or from initial on) and up to end_date."""
    window = delta_start(filings.select("symbol").distinct(), existing, initial, "announcement_date")
    announced = F.col("announcement_date")
    return filings.join(window, "symbol").filter((announced >= F.col("from_date")) & (announced <= F.lit(end_date).cast("date"))).drop("from_date")


def rejection_reason() -> Column:
    """Null for a valid filing: a period that begins by its end, and an announcement that does not precede it."""
    return (
        F.when(F.col("period_end").isNull() | F.col("announcement_date").isNull(), "missing date")
        .when(F.col("period_start") > F.col("period_end"), "period starts after it ends")
        .when(F.col("announcement_date") < F.col("period_end"), "announced before the period ended")
    )


def stored(filings: DataFrame, config: Fundamentals = Fundamentals()) -> DataFrame:
    """Valid filings in the columns they are stored in; growth is filled in later, over the full history."""
    lag = F.datediff("announcement_date", "period_end")
    return filings.filter(rejection_reason().isNull()).select(
        "symbol", F.col("period_end").alias("quarter_end"), "period_start", "announcement_date", F.col("basic_eps").alias("eps"), F.col("revenue").alias("sales"), F.lit(None).cast("double").alias("roe"),
        "source", F.coalesce("fields_missing", F.lit(False)).alias("fields_missing"), lag.alias("announcement_lag_days"), (lag > config.backlog_lag_days).alias("is_backlog_filing"),
        F.coalesce("announcement_date_is_estimated", F.lit(False)).alias("announcement_date_is_estimated"),
    )


def with_growth(rows: DataFrame) -> DataFrame:
    """rows with eps_yoy_growth and sales_yoy_growth in percent, computed afresh.

    The earlier quarter is the nearest to a year before, within the band; of two as near, the later. It is
    looked up by a range frame over days, not by a join. Null where a side is missing, flagged or zero before.
    """
    day = F.datediff("quarter_end", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-BAND[1], -BAND[0])
    seen = F.collect_list(F.struct("_day", "eps", "sales", "fields_missing")).over(w)
    nearness = F.transform(
        "_seen", lambda p: F.struct(F.abs(F.col("_day") - NEAREST - p["_day"]).alias("far"), (-p["_day"]).alias("late"), p["eps"].alias("eps"), p["sales"].alias("sales"), p["fields_missing"].alias("missing"))
    )
    out = rows.withColumn("_day", day).withColumn("_seen", seen).withColumn("_p", F.array_min(nearness))

    def growth(column: str) -> Column:
        before = F.col(f"_p.{column}")
        whole = ~F.col("fields_missing") & ~F.col("_p.missing")
        return F.when(whole, (F.col(column) - before) / F.nullif(F.abs(before), F.lit(0.0)) * 100)

    return out.withColumns({"eps_yoy_growth": growth("eps"), "sales_yoy_growth": growth("sales")}).drop("_day", "_seen", "_p")


def latest(rows: DataFrame) -> DataFrame:
    """The last quarter of each symbol."""
    return latest_per_symbol(rows, "quarter_end")


def known(filings: DataFrame, arrival: str) -> DataFrame:
    """What was known of each symbol from one announcement to the next: (symbol, known_from, known_until, quarter_end,
    announcement_date, is_consolidated, eps, sales, eps_yoy_growth, sales_yoy_growth, quarters_known), of its last quarter.

    Filings have two times, the quarter and the announcement. Until a date only those announced by then count: of a
    quarter's filings the preferred one, which takes the place of an earlier one only from its own announcement on, and for
    growth the quarter a year before as it was known then. known_until is the next announcement's date, null for the last; a
    filing without a date was never announced. One window by symbol over announcements; what it holds grows with the
    quarters of one symbol.
    """
    valid = F.coalesce(rejection_reason().isNull(), F.lit(False))
    first = F.when(F.coalesce("is_consolidated", F.lit(False)), 0).otherwise(1)
    day = F.datediff("period_end", F.lit("1970-01-01").cast("date"))
    one = F.struct(
        (-day).alias("late"), first.alias("first"), F.col(arrival).alias("arrival"), valid.alias("valid"), F.col("period_end").alias("quarter_end"), "announcement_date", "is_consolidated",
        F.col("basic_eps").alias("eps"), F.col("revenue").alias("sales"), F.coalesce("fields_missing", F.lit(False)).alias("missing"),
    )
    announced = Window.partitionBy("symbol").orderBy("announcement_date")
    seen = F.array_sort(F.collect_list("_one").over(announced.rangeBetween(Window.unboundedPreceding, 0)))
    rows = filings.filter("announcement_date is not null and period_end is not null").select("symbol", "announcement_date", one.alias("_one"))
    rows = rows.withColumns({"_seen": seen, "known_until": F.lead("announcement_date").over(announced)})
    rows = rows.filter("known_until is null or known_until <> announcement_date").withColumnRenamed("announcement_date", "known_from")
    best = F.filter("_seen", lambda x, i: F.coalesce(F.get("_seen", i - 1)["late"] != x["late"], F.lit(True)))
    rows = rows.withColumn("_known", F.filter(best, lambda x: x["valid"])).filter(F.size("_known") > 0).withColumn("_q", F.col("_known")[0])
    in_band = F.filter("_known", lambda p: (p["late"] - F.col("_q.late")).between(*BAND))
    nearness = F.transform(in_band, lambda p: F.struct(F.abs(p["late"] - F.col("_q.late") - NEAREST).alias("far"), p["late"].alias("late"), p["eps"].alias("eps"), p["sales"].alias("sales"), p["missing"].alias("missing")))
    rows = rows.withColumn("_p", F.array_min(nearness))

    def growth(column: str) -> Column:
        before = F.col(f"_p.{column}")
        return F.when(~F.col("_q.missing") & ~F.col("_p.missing"), (F.col(f"_q.{column}") - before) / F.nullif(F.abs(before), F.lit(0.0)) * 100)

    return rows.select(
        "symbol", "known_from", "known_until", "_q.quarter_end", "_q.announcement_date", "_q.is_consolidated", "_q.eps", "_q.sales", growth("eps").alias("eps_yoy_growth"), growth("sales").alias("sales_yoy_growth"),
        F.size("_known").alias("quarters_known"),
    )


def as_of(dates: DataFrame, known_rows: DataFrame) -> DataFrame:
    """Rows of dates (symbol, date, ...) with what was known at the end of that date, null before the first
    announcement. Both are put in one order by symbol and date, so that there is no range join."""
    facts = [c for c in known_rows.columns if c not in ("symbol", "known_from", "known_until")]
    rest = [c for c in dates.columns if c not in ("symbol", "date")]
    kind = known_rows.select(F.struct(*facts).alias("_k")).schema["_k"].dataType
    asked = dates.select("symbol", "date", F.lit(None).cast(kind).alias("_k"), F.struct(F.lit(1).alias("_asked"), *rest).alias("_d"))
    told = known_rows.select("symbol", F.col("known_from").alias("date"), F.struct(*facts).alias("_k"), F.lit(None).cast(asked.schema["_d"].dataType).alias("_d"))
    order = Window.partitionBy("symbol").orderBy("date", F.col("_d").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.unionByName(told).withColumn("_k", F.last("_k", ignorenulls=True).over(order)).filter("_d is not null")
    return rows.select("symbol", "date", *(F.col(f"_d.{c}").alias(c) for c in rest), *(F.col(f"_k.{c}").alias(c) for c in facts))
