"""Files that name instruments and symbols: instrument lists, index constituents, the equity master, a custom list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.operators.universe import cash_equities
from barlens.schema import INSTRUMENT


def _csv(spark: SparkSession, path: str, needed: set[str]) -> DataFrame:
    frame = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    frame = frame.toDF(*(c.strip() for c in frame.columns))
    if missing := sorted(needed - set(frame.columns)):
        raise ValueError(f"{path} is missing columns: {', '.join(missing)}")
    return frame


def instruments(spark: SparkSession, path: str, exchange: str = "NSE") -> DataFrame:
    """Cash equities of an exchange from JSON lines of provider instruments."""
    return cash_equities(spark.read.schema(INSTRUMENT).json(path), exchange)


def constituents(spark: SparkSession, path: str, least: int = 450, most: int = 550) -> DataFrame:
    """(symbol) of an index constituents CSV; raises if their number is implausible."""
    out = _csv(spark, path, {"Symbol"}).select(F.upper(F.trim("Symbol")).alias("symbol")).filter("symbol <> ''").distinct()
    if not least <= (n := out.count()) <= most:
        raise ValueError(f"expected {least} to {most} constituents, received {n}")
    return out


def equity_master(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, listing_date) of the series EQ and BE; raises on no rows, repeated symbols or bad dates."""
    frame = _csv(spark, path, {"SYMBOL", "SERIES", "DATE OF LISTING"}).filter(F.col("SERIES").isin("EQ", "BE"))
    out = frame.select(F.upper(F.trim("SYMBOL")).alias("symbol"), F.try_to_date(F.initcap(F.trim(F.col("DATE OF LISTING"))), "dd-MMM-yyyy").alias("listing_date"))
    n, symbols, dates = out.agg(F.count(F.lit(1)), F.count_distinct("symbol"), F.count("listing_date")).first()
    if not n or symbols < n or dates < n:
        raise ValueError("the equity master has no rows, repeated symbols or invalid listing dates")
    return out


def custom_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(symbol) of a text file with one on each line; # begins a comment."""
    symbol = F.upper(F.trim(F.regexp_replace("value", "#.*", "")))
    out = spark.read.text(path).select(symbol.alias("symbol")).filter("symbol <> ''").distinct()
    if out.isEmpty():
        raise ValueError(f"{path} names no symbols")
    return out
