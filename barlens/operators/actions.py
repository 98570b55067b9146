"""Corporate actions: what they do to the prices before them, and moves that none of them explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.config import Moves

# Kinds of actions. A split is new:old shares, a bonus is free:held shares, a dividend an amount a share.
SPLIT, BONUS, DIVIDEND = "split", "bonus", "dividend"


def _timeline(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars and actions of (symbol, ex_date, action_type, ratio) as rows of one order, with each action's factor: what
    earlier prices are multiplied by. An action whose ratio can't be read, or is not positive, has none; neither has a dividend
    before the first bar, or of at least the close before it."""
    parts = F.transform(F.split("ratio", ":"), lambda x: F.trim(x).try_cast("double"))
    rows = bars.select("symbol", "date", "close", F.lit(0).alias("_event"), F.lit(None).cast("string").alias("_kind"), F.lit(None).cast("array<double>").alias("_parts"))
    events = actions.select("symbol", F.col("ex_date").alias("date"), F.lit(None).cast("double").alias("close"), F.lit(1).alias("_event"), F.lower(F.trim("action_type")).alias("_kind"), parts.alias("_parts"))
    # an action stands before the bar of its own date, which has the new scale
    up = Window.partitionBy("symbol").orderBy("date", F.desc("_event")).rowsBetween(Window.unboundedPreceding, -1)
    a, b = F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1))
    before = F.last("close", ignorenulls=True).over(up)
    factor = F.when(F.col("_kind") == SPLIT, b / F.nullif(a, F.lit(0.0))).when(F.col("_kind") == BONUS, b / F.nullif(a + b, F.lit(0.0))).when(F.col("_kind") == DIVIDEND, 1 - a / F.nullif(before, F.lit(0.0)))
    return rows.unionByName(events).withColumn("factor", factor).withColumn("factor", F.when(F.col("factor") > 0, F.col("factor"))).drop("_kind", "_parts")


def factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """(symbol, ex_date, factor) of each action that has a factor."""
    return _timeline(bars, actions).filter("_event = 1 and factor is not null").select("symbol", F.col("date").alias("ex_date"), "factor")


def retro_adjusted(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """bars with adj_close: the close times the factors of all later actions of its symbol, a running product from the
    end. Actions and bars are put in one order by symbol, so that there is no range join and no join by date."""
    down = Window.partitionBy("symbol").orderBy(F.desc("date"), "_event").rowsBetween(Window.unboundedPreceding, 0)
    scaled = _timeline(bars, actions).withColumn("_scale", F.product(F.coalesce("factor", F.lit(1.0))).over(down)).filter("_event = 0")
    scale = scaled.select("symbol", "date", "_scale").dropDuplicates(["symbol", "date"])
    return bars.drop("adj_close").join(scale, ["symbol", "date"]).withColumn("adj_close", F.col("close") * F.col("_scale")).drop("_scale")


def _median(values: Column) -> Column:
    """Of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def large_moves(bars: DataFrame, actions: DataFrame, config: Moves = Moves()) -> DataFrame:
    """(symbol, date, move, residual, score, explained) of logarithmic moves from bar to bar that are far out: more than
    config.deviations median absolute deviations from the median, and more than config.least, of the moves of the block
    of sessions before. residual is the move without what the actions between both bars explain; a move is explained if that is
    not far out. Raw closes are looked at.

    Median and deviation are of blocks of config.block bars of a symbol, computed once a block: a bar is held to the
    whole block before its own, so that nothing is sorted for each bar. The first block of a symbol, and one after a
    block of no deviation at all, is not judged."""
    rows = _timeline(bars.filter("close > 0"), actions)
    w = Window.partitionBy("symbol").orderBy("date", F.desc("_event"))
    explained = F.sum(F.when(F.col("_event") == 1, F.coalesce(F.log("factor"), F.lit(0.0)))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_explained", F.coalesce(explained, F.lit(0.0))).filter("_event = 0")
    by = Window.partitionBy("symbol").orderBy("date")
    rows = rows.select(
        "symbol", "date", F.log(F.col("close") / F.lag("close").over(by)).alias("move"), (F.col("_explained") - F.lag("_explained").over(by)).alias("_expected"), (F.row_number().over(by) - 1).alias("_place")
    )
    rows = rows.withColumns({"residual": F.col("move") - F.col("_expected"), "block": F.floor(F.col("_place") / config.block)})
    sorted_moves = F.array_sort(F.collect_list("residual"))
    blocks = rows.groupBy("symbol", "block").agg(sorted_moves.alias("_moves")).filter(F.size("_moves") >= config.block - 1)
    blocks = blocks.withColumn("median", _median(F.col("_moves")))
    blocks = blocks.withColumn("_off", F.array_sort(F.transform("_moves", lambda x: F.abs(x - F.col("median"))))).withColumn("deviation", _median(F.col("_off"))).filter("deviation > 0")
    held = rows.join(blocks.select("symbol", (F.col("block") + 1).alias("block"), "median", "deviation"), ["symbol", "block"])

    def far(column: str) -> Column:
        off = F.abs(F.col(column) - F.col("median"))
        return (off > config.deviations * F.col("deviation")) & (F.abs(F.col(column)) > config.least)

    return held.filter(far("move")).select("symbol", "date", "move", "residual", (F.abs(F.col("residual") - F.col("median")) / F.col("deviation")).alias("score"), (~far("residual")).alias("explained"))
