"""Daily and weekly bars: adjustment, cleaning, validity, resampling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require(frame: DataFrame, columns: Iterable[str]) -> None:
    """Raises ValueError where columns are missing, before any job runs."""
    if missing := sorted(set(columns) - set(frame.columns)):
        raise ValueError(f"bars must contain: {', '.join(missing)}")


def last_bar(*order: str) -> Window:
    """The window of a symbol's bars in order of date."""
    return Window.partitionBy("symbol").orderBy("date", *order)


def from_end(w: Window) -> Column:
    """1 for the last row of each partition of w, 2 for the one before, ..., without a second sort."""
    return F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.row_number().over(w) + 1


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as they divide without errors: over zero infinite, or not a number where a is zero."""
    over_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.coalesce(F.try_divide(a, b), F.when(b == 0, over_zero))


def above(a: Column, b: Column) -> Column:
    """a > b by more than averages of a few hundred doubles lose to rounding, so that equal averages are equal in whatever
    order they were summed."""
    return (a > b) & (a - b > 1e-13 * F.abs(b))


def adjusted(bars: DataFrame, universe: DataFrame | None = None, on: str = "date") -> DataFrame:
    """(symbol, date, close, high, low, volume) with prices on the scale of adj_close, of active symbols only.

    A null or zero adj_close leaves prices as they are. The universe has one row per symbol, and Spark
    broadcasts it where its statistics allow.
    """
    require(bars, ("symbol", on, "close", "high", "low", "volume"))
    base = F.nullif(F.col("adj_close"), F.lit(0.0)) if "adj_close" in bars.columns else F.lit(None).cast("double")
    scale = F.coalesce(base / F.nullif(F.col("close"), F.lit(0.0)), F.lit(1.0))
    out = bars.select(
        "symbol", F.col(on).alias("date"), F.coalesce(base, "close").alias("close"), (F.col("high") * scale).alias("high"), (F.col("low") * scale).alias("low"), "volume"
    )
    return out if universe is None else active_only(out, universe)


def active_only(frame: DataFrame, universe: DataFrame) -> DataFrame:
    return frame.join(universe.filter("is_active").select("symbol"), "symbol", "left_semi")


def normalised(bars: DataFrame, *, volume: bool = True, arrival: str | None = None, positive: bool = True) -> DataFrame:
    """Numbers cast (what can't be is null), the last row of each symbol and date kept, rows without a
    positive price (unless positive is false: a price of zero or more) and a volume of zero or more dropped. The last row is that with the greatest arrival, and
    among equals that with the greatest numbers, so that it does not depend on how rows are dealt;
    deciding it shares the partitioning and sort of the windows that follow."""
    numbers = ["close", "high", "low", *(["volume"] if volume else [])]
    require(bars, ("symbol", "date", *numbers))
    w = last_bar(*([arrival] if arrival else []), *numbers)
    out = bars.withColumns({c: F.expr(f"try_cast({c} as double)") for c in numbers})
    out = out.withColumn("_next", F.lead("date").over(w)).filter("_next is null or _next <> date").drop("_next")
    for c in numbers:
        out = out.filter(~F.isnan(c) & (F.col(c) > 0 if positive and c != "volume" else F.col(c) >= 0))
    return out


def bar_is_valid() -> Column:
    """No negative price, the low under and the high over both ends of the bar, no negative volume."""
    return (
        (F.least("open", "high", "low", "close") >= 0)
        & (F.col("low") <= F.least("open", "close"))
        & (F.col("high") >= F.greatest("open", "close"))
        & (F.col("volume") >= 0)
    )


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected symbols with notes): one bad bar rejects all bars of its symbol in this run."""
    bad = bars.filter(~F.coalesce(bar_is_valid(), F.lit(False))).groupBy("symbol").agg(F.min("date").alias("date"))
    notes = bad.select("symbol", F.substring(F.concat(F.lit("invalid bar on "), F.col("date").cast("string")), 1, 160).alias("note"))
    return bars.join(bad.select("symbol"), "symbol", "left_anti"), notes


def with_adjusted_close(bars: DataFrame) -> DataFrame:
    """adj_close, or close where that is null or zero."""
    return bars.withColumn("adj_close", F.coalesce(F.nullif(F.col("adj_close"), F.lit(0.0)), F.col("close")))


def weekly(bars: DataFrame) -> DataFrame:
    """Bars of calendar weeks, named by the week's Friday; a partial aggregation runs before the shuffle."""
    week = F.date_trunc("week", "date").cast("date")
    return (
        bars.groupBy("symbol", week.alias("week"))
        .agg(
            F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"),
            F.sum("volume").cast("bigint").alias("volume"), F.max_by("adj_close", "date").alias("adj_close"),
        )
        .select("symbol", F.date_add("week", 4).alias("week_end_date"), "open", "high", "low", "close", "volume", "adj_close")
    )


def latest_per_symbol(frame: DataFrame, on: str = "date") -> DataFrame:
    """The row of the greatest date of each symbol."""
    others = [c for c in frame.columns if c != "symbol"]
    return frame.groupBy("symbol").agg(F.max_by(F.struct(*others), on).alias("_r")).select("symbol", *(F.col(f"_r.{c}").alias(c) for c in others))


def latest_date(frame: DataFrame, on: str = "date") -> DataFrame:
    """The rows of the greatest date of the whole frame. It reads the frame twice, once for the date alone, and is
    for stored tables and held frames."""
    top = frame.agg(F.max(on).alias("_top"))
    return frame.join(F.broadcast(top), F.col(on) == F.col("_top")).drop("_top")


def delta_start(symbols: DataFrame, stored: DataFrame, initial: str, on: str = "date") -> DataFrame:
    """(symbol, from_date): the day after what is stored, in one grouped aggregation for all symbols."""
    last = stored.groupBy("symbol").agg(F.max(on).alias("_last"))
    return symbols.select("symbol").join(last, "symbol", "left").select("symbol", F.coalesce(F.date_add("_last", 1), F.to_date(F.lit(initial))).alias("from_date"))
