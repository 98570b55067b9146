"""Volume signals: up and down volume, the accumulation/distribution line, spikes near a pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.config import Volume
from barlens.operators.bars import from_end, normalised, quotient


def _with_line(bars: DataFrame, config: Volume, carried: DataFrame | None = None) -> DataFrame:
    """Bars with their place, the close before, the line, and the average volume of the bars before. carried has the last bars
    of each symbol before these (symbol, recent), which come along, with their lines and places as they were."""
    w = Window.partitionBy("symbol").orderBy("date")
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    flow = F.coalesce(((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / span, F.lit(0.0)) * F.col("volume")
    rows = normalised(bars, positive=config.positive).select("symbol", "date", "close", "high", "low", "volume", flow.alias("_flow"), F.lit(1).alias("_new"))
    if carried is not None:
        rows = rows.withColumns({"_line": F.lit(None).cast("double"), "_place": F.lit(None).cast("long")})
        before = carried.select("symbol", F.inline("recent")).withColumnsRenamed({"line": "_line", "place": "_place"})
        rows = rows.unionByName(before.withColumns({"_flow": F.lit(0.0), "_new": F.lit(0)}))
        line = F.coalesce("_line", F.coalesce(F.last("_line", ignorenulls=True).over(until), F.lit(0.0)) + F.sum("_flow").over(until))
        place = F.coalesce("_place", F.coalesce(F.last("_place", ignorenulls=True).over(until), F.lit(-1)) + F.sum("_new").over(until))
    else:
        line, place = F.sum("_flow").over(until), (F.row_number().over(w) - 1).cast("long")
    average = F.avg("volume").over(w.rowsBetween(-config.spike_average_sessions, -1))
    out = rows.withColumns({"place": place, "back": from_end(w), "before_close": F.lag("close").over(w), "line": line, "average_before": average})
    return out.withColumn("average_before", F.when(F.col("place") >= config.spike_average_sessions, F.col("average_before"))).drop("_flow", "_new", "_line", "_place")


def carry(bars: DataFrame, config: Volume = Volume(), before: DataFrame | None = None) -> DataFrame:
    """(symbol, recent): the last bars of each symbol with their line and place, as many as any signal looks back on."""
    kept = 1 + max(config.up_down_sessions, config.distribution_sessions, config.spike_sessions + config.spike_average_sessions)
    last = _with_line(bars, config, before).filter(F.col("back") <= kept)
    return last.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "close", "high", "low", "volume", "line", "place"))).alias("recent"))


def line(bars: DataFrame, config: Volume = Volume()) -> DataFrame:
    """(symbol, date, line): the accumulation/distribution line from the first stored bar on."""
    return _with_line(bars, config).select("symbol", "date", "line")


def signals(bars: DataFrame, pivots: DataFrame | None = None, config: Volume = Volume(), carried: DataFrame | None = None) -> DataFrame:
    """One row per symbol at its last bar, as stored. pivots: (symbol, pivot_price), at most one each. With what carry()
    gave for the bars before, bars are the new ones alone."""
    b = _with_line(bars, config, carried)
    price = F.lit(None).cast("double")
    if pivots is not None:
        b = b.join(pivots.filter("pivot_price is not null").select("symbol", F.col("pivot_price").alias("pivot")), "symbol", "left")
        price = F.col("pivot")
    b = b.withColumn("pivot_price_used", price)
    change = F.when(F.col("back") <= config.up_down_sessions, F.col("close") - F.col("before_close"))
    spikes = (
        (F.col("back") <= config.spike_sessions) & (F.col("place") >= config.spike_average_sessions) & (F.col("close") > F.col("before_close"))
        & (quotient(F.abs(F.col("close") - F.col("pivot_price_used")), F.col("pivot_price_used")) <= config.spike_proximity)
        & (F.col("average_before") > 0) & (F.col("volume") >= F.col("average_before") * config.spike_multiple)
    )
    best = F.max(F.when(spikes, F.struct(F.col("volume").alias("volume"), F.col("back").alias("back"), F.col("date").alias("date"), F.col("average_before").alias("average"))))
    enough = F.count(F.lit(1)) > config.up_down_sessions
    r = b.groupBy("symbol").agg(
        F.max("date").alias("date"),
        F.when(enough, F.coalesce(F.sum(F.when(change > 0, F.col("volume"))), F.lit(0.0))).alias("up_volume"),
        F.when(enough, F.coalesce(F.sum(F.when(change < 0, F.col("volume"))), F.lit(0.0))).alias("down_volume"),
        F.max(F.when(F.col("back") == 1, F.col("line"))).alias("accumulation_distribution_value"),
        F.max(F.when(F.col("back") == config.distribution_sessions + 1, F.col("line"))).alias("_earlier"),
        F.max("pivot_price_used").alias("pivot_price_used"), best.alias("_best"),
    )
    return r.select(
        "symbol", "date", (F.col("up_volume") / F.nullif(F.col("down_volume"), F.lit(0.0))).alias("up_down_volume_ratio"), "up_volume", "down_volume", "accumulation_distribution_value",
        (F.col("accumulation_distribution_value") > F.col("_earlier")).alias("accumulation_distribution_rising"), "pivot_price_used",
        F.col("_best").isNotNull().alias("volume_spike_near_pivot"), F.col("_best.date").alias("spike_date"), F.col("_best.volume").alias("spike_volume"),
    )
