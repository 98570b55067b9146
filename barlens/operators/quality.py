"""Audits of stored bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.operators.bars import weekly

STALE_SESSIONS = 10


def counts(daily: DataFrame, universe: DataFrame) -> DataFrame:
    """One row of counts, in one pass over the bars and one over their symbols."""
    def count(test):
        return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0))

    low_end, high_end = F.least("open", "close"), F.greatest("open", "close")
    per_symbol = daily.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        count((F.col("low") > low_end) | (F.col("high") < high_end)).alias("invalid"),
        count((F.least("open", "high", "low", "close") < 0) | (F.col("volume") < 0)).alias("negative"), count(F.col("volume") == 0).alias("zero"),
    )
    dated = per_symbol.join(universe.select("symbol", "listing_date"), "symbol", "left")
    return dated.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("daily_rows"), count(F.col("listing_date").isNotNull()).alias("symbols_with_listing_date"),
        count(F.col("listing_date").isNull()).alias("symbols_missing_listing_date"), F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_ohlc_rows"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_price_or_volume_rows"), F.coalesce(F.sum("zero"), F.lit(0)).alias("zero_volume_rows"),
    )


def weekly_mismatches(daily: DataFrame, stored: DataFrame) -> DataFrame:
    """(symbol, week_end_date) of weeks that differ from those derived anew, or that one side lacks."""
    measures = ("open", "high", "low", "close", "volume")
    new = weekly(daily).select("symbol", "week_end_date", *(F.col(c).alias(f"new_{c}") for c in measures))
    differs = F.lit(False)
    for c in measures:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return new.join(stored.select("symbol", "week_end_date", *measures), ["symbol", "week_end_date"], "full").filter(differs).select("symbol", "week_end_date")


def missing_dates(daily: DataFrame, universe: DataFrame) -> DataFrame:
    """(symbol, listing_date, first_date, last_date, date) of market sessions without a bar between a symbol's
    first and last, not before it was listed. Sessions are numbered, so that only gaps between bars that
    follow each other are unfolded; nothing is joined by range."""
    sessions = daily.select("date").distinct().withColumn("session", F.row_number().over(Window.orderBy("date")))
    w = Window.partitionBy("symbol").orderBy("session")
    whole = Window.partitionBy("symbol")
    bars = daily.select("symbol", "date").join(sessions, "date").withColumns({"before": F.lag("session").over(w), "first_date": F.min("date").over(whole), "last_date": F.max("date").over(whole)})
    gaps = bars.filter(F.col("session") - F.col("before") > 1).select("symbol", "first_date", "last_date", F.explode(F.sequence(F.col("before") + 1, F.col("session") - 1)).alias("session"))
    dated = gaps.join(sessions, "session").join(universe.select("symbol", "listing_date"), "symbol", "left")
    return dated.filter(F.col("date") >= F.coalesce("listing_date", "first_date")).select("symbol", "listing_date", "first_date", "last_date", "date")


def missing_lists(daily: DataFrame, universe: DataFrame) -> DataFrame:
    """One row for each symbol with missing sessions, and their dates in order."""
    return missing_dates(daily, universe).groupBy("symbol", "listing_date", "first_date", "last_date").agg(
        F.array_sort(F.collect_list("date")).alias("missing_dates"), F.count(F.lit(1)).alias("missing_date_count")
    )


def stale_runs(daily: DataFrame, over: int = STALE_SESSIONS) -> DataFrame:
    """(symbol, first_date, last_date, sessions) of runs of more than so many bars with one close."""
    w = Window.partitionBy("symbol").orderBy("date")
    changed = F.when(F.col("close").eqNullSafe(F.lag("close").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = daily.select("symbol", "date", "close").withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy("symbol", "run").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("sessions"))
        .filter(F.col("sessions") > over).select("symbol", "first_date", "last_date", "sessions")
    )


def report(daily: DataFrame, stored_weekly: DataFrame, universe: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """One row with all counts. The symbols with missing sessions are rows of missing_lists, which may be given
    where they are stored already."""
    lists = (missing_lists(daily, universe) if lists is None else lists).agg(
        F.coalesce(F.sum("missing_date_count"), F.lit(0)).alias("missing_observed_market_dates"), F.count(F.lit(1)).alias("symbols_with_missing_dates")
    )
    return (
        counts(daily, universe)
        .join(stored_weekly.agg(F.count(F.lit(1)).alias("weekly_rows")))
        .join(weekly_mismatches(daily, stored_weekly).agg(F.count(F.lit(1)).alias("weekly_reconciliation_mismatches")))
        .join(lists)
        .join(stale_runs(daily).agg(F.count(F.lit(1)).alias("stale_close_runs_over_10_sessions")))
        .withColumn("generated_at", F.current_timestamp())
    )
