"""Instruments, listing dates, active symbols and memberships, as set operations on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cash_equities(instruments: DataFrame, exchange: str = "NSE") -> DataFrame:
    return instruments.filter((F.col("exchange") == exchange) & (F.col("instrument_type") == "EQ"))


def merged_universe(universe: DataFrame, instruments: DataFrame) -> DataFrame:
    """Symbols of both sides: a known isin is kept where the new one is null; new symbols are not active."""
    new = instruments.groupBy("symbol").agg(F.first("isin", ignorenulls=True).alias("_isin"))
    return universe.join(new, "symbol", "full").select(
        "symbol", F.coalesce("_isin", "isin").alias("isin"), "sector", "industry", "listing_date", F.coalesce("is_active", F.lit(False)).alias("is_active")
    )


def with_listing_dates(universe: DataFrame, staged: DataFrame) -> DataFrame:
    """universe with the staged dates where they differ, and a column changed."""
    new = staged.select("symbol", F.col("listing_date").alias("_new"))
    joined = universe.join(new.withColumn("_matched", F.lit(True)), "symbol", "left")
    differs = F.col("_matched").isNotNull() & ~F.col("listing_date").eqNullSafe(F.col("_new"))
    return joined.select(
        "symbol", "isin", "sector", "industry", F.when(differs, F.col("_new")).otherwise(F.col("listing_date")).alias("listing_date"), "is_active",
        F.col("_matched").isNotNull().alias("matched"), differs.alias("changed"),
    )


def listing_summary(synced: DataFrame) -> DataFrame:
    """Counts of matched, updated and still unmatched symbols, in one pass."""
    def count(test):
        return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0))

    return synced.agg(count(F.col("matched")).alias("matched_symbols"), count(F.col("changed")).alias("updated_symbols"), count(F.col("listing_date").isNull()).alias("unmatched_universe_symbols"))


def active_exactly(universe: DataFrame, symbols: DataFrame) -> DataFrame:
    """universe in which the given symbols are active and no others; unknown ones are added."""
    wanted = symbols.select("symbol").distinct().withColumn("_wanted", F.lit(True))
    return universe.join(wanted, "symbol", "full").select("symbol", "isin", "sector", "industry", "listing_date", F.col("_wanted").isNotNull().alias("is_active"))


def pending_backfill(universe: DataFrame, instruments: DataFrame, daily: DataFrame) -> DataFrame:
    """(symbol) of active, mapped symbols without bars or with a last bar before the last of all, in order."""
    last = daily.groupBy("symbol").agg(F.max("date").alias("_last"))
    top = daily.agg(F.max("date").alias("_top"))
    mapped = universe.filter("is_active").select("symbol").join(instruments.select("symbol"), "symbol", "left_semi")
    return mapped.join(last, "symbol", "left").join(F.broadcast(top)).filter(F.col("_last").isNull() | (F.col("_last") < F.col("_top"))).select("symbol").orderBy("symbol")
