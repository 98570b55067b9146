"""Relative strength: weighted returns over market sessions, a line against the equal-weight benchmark,
and a rating from 1 to 99 across the universe.

Sessions are numbered, and lookbacks are range frames over that number: a lookback is null where the symbol
has no bar on exactly that session. So there is no dense grid of dates and symbols.

All functions take new bars alone where what was carried from the bars before is given: the number, benchmark and count of
symbols of the last session, and for each symbol its greatest line and close and its bars of the last sessions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.config import Strength
from barlens.operators.bars import quotient, require


@dataclass(frozen=True)
class Carried:
    """What new bars need to know of the bars before them: symbols (symbol, top_line, top_close, recent), and one
    row of the last session (date, session, benchmark, known)."""

    symbols: DataFrame
    last: DataFrame

    def bars(self) -> DataFrame:
        return self.symbols.select("symbol", F.inline("recent"))


def _numbered(bars: DataFrame, config: Strength, carried: Carried | None = None) -> DataFrame:
    """(symbol, date, session, close) of positive closes, or of all. There is one row per session in the numbering,
    which the calendar bounds."""
    require(bars, ("symbol", "date", "close"))
    prices = bars.select("symbol", "date", F.expr("try_cast(close as double)").alias("close")).filter("close > 0 and not isnan(close)" if config.positive else "close is not null")
    sessions = prices.select("date").distinct().withColumn("session", F.row_number().over(Window.orderBy("date")))
    if carried:
        sessions = sessions.crossJoin(F.broadcast(carried.last.select(F.col("session").alias("_before")))).select("date", (F.col("session") + F.col("_before")).alias("session"))
    return prices.join(sessions, "date")


def _symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("session")


def returns(bars: DataFrame, config: Strength = Strength(), carried: Carried | None = None) -> DataFrame:
    """(symbol, date, session, close, return_63 and the like, composite_return); any missing part leaves it null."""
    w = _symbol()
    numbered = _numbered(bars, config, carried)
    if carried:
        numbered = numbered.withColumn("_new", F.lit(True)).unionByName(carried.bars().withColumn("_new", F.lit(False)))
    parts = {f"return_{k}": quotient(F.col("close"), F.first("close").over(w.rangeBetween(-k, -k))) - 1 for k, _ in config.lookbacks}
    total = None
    for k, weight in config.lookbacks:
        part = F.col(f"return_{k}") * weight
        total = part if total is None else total + part
    out = numbered.withColumns({**parts, "before_session": F.lag("session").over(w), "before_close": F.lag("close").over(w)}).withColumn("composite_return", total)
    return out.filter("_new").drop("_new") if carried else out


def benchmark(returned: DataFrame, config: Strength = Strength(), carried: Carried | None = None) -> DataFrame:
    """(date, session, benchmark, known): the product over sessions of one and the mean return of all symbols, and the
    number of symbols that have begun.

    With pad_gaps a symbol without a bar counts with a return of zero from its second session on; the
    number of those is a running sum of first sessions, so that no grid is needed. Else only symbols with
    bars on a session and the one before count. A padded close of zero has no return: zeros are closes of zero, kept those
    that have a bar on the next session, and where some have none the benchmark is not a number from there on.
    """
    moved = quotient(F.col("close"), F.col("before_close")) - 1
    follows = F.col("before_session") == F.col("session") - 1
    counted = moved if config.pad_gaps else F.when(follows, moved)
    per_session = returned.groupBy("date", "session").agg(
        F.sum(counted).alias("total"), F.count(counted).alias("observed"), F.sum(F.when(F.col("before_session").isNull(), 1).otherwise(0)).alias("started"),
        F.count_if(F.col("close") == 0).alias("zeros"), F.count_if(follows & (F.col("before_close") == 0)).alias("kept"),
    )
    per_session = per_session.withColumn("factor", F.lit(None).cast("double"))
    if carried:
        zeros = carried.bars().filter("close = 0").groupBy("session").agg(F.count(F.lit(1)).alias("zeros"))
        last = carried.last.select("date", "session", F.lit(None).cast("double").alias("total"), F.lit(0).cast("long").alias("observed"), F.col("known").alias("started"), F.col("benchmark").alias("factor"))
        per_session = per_session.unionByName(last.join(zeros, "session", "left").withColumns({"zeros": F.coalesce("zeros", F.lit(0)), "kept": F.lit(0).cast("long")}))
    w = Window.orderBy("session")
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    known = F.sum("started").over(w.rowsBetween(Window.unboundedPreceding, -1)) if config.pad_gaps else F.col("observed")
    mean = F.coalesce(F.col("total"), F.lit(0.0)) / F.nullif(known, F.lit(0))
    if config.pad_gaps and not config.positive:
        mean = F.when(F.lag("zeros").over(w) > F.col("kept"), float("nan")).otherwise(mean)
    factor = F.coalesce("factor", 1 + F.coalesce("mean", F.lit(0.0)))
    marks = per_session.withColumn("mean", mean).select("date", "session", F.product(factor).over(until).alias("benchmark"), F.sum("started").over(until).alias("known"), F.col("factor").isNull().alias("_new"))
    return marks.filter("_new").drop("_new")


def lines(bars: DataFrame, config: Strength = Strength(), carried: Carried | None = None) -> DataFrame:
    """returns() with benchmark, known, rs_line (price over benchmark) and rs_line_new_high: the line at or over all its
    earlier values while the price is under its own. After a session without a bar it is false."""
    returned = returns(bars, config, carried)
    marks = benchmark(returned, config, carried).select("date", "benchmark", "known")
    lined = returned.join(marks, "date").withColumn("rs_line", quotient(F.col("close"), F.col("benchmark")))
    earlier = _symbol().rowsBetween(Window.unboundedPreceding, -1)
    top_line, top_close = F.max("rs_line").over(earlier), F.max("close").over(earlier)
    if carried:
        lined = lined.join(carried.symbols.select("symbol", "top_line", "top_close"), "symbol", "left")
        top_line, top_close = F.greatest(top_line, "top_line"), F.greatest(top_close, "top_close")
    new_high = (F.col("before_session") == F.col("session") - 1) & (F.col("rs_line") >= top_line) & (F.col("close") < top_close)
    return lined.withColumn("rs_line_new_high", F.coalesce(new_high, F.lit(False))).drop("top_line", "top_close")


def carry(lined: DataFrame, config: Strength = Strength(), before: Carried | None = None) -> Carried:
    """What bars after those of lined need: one row per symbol with as many sessions as the longest lookback reaches, and
    its last bar however long ago. lined is used twice and should be at hand."""
    last = lined.groupBy("date", "session").agg(F.first("benchmark").alias("benchmark"), F.first("known").alias("known")).orderBy(F.desc("session")).limit(1)
    rows = lined.select("symbol", "session", "date", "close", F.col("rs_line").alias("line"), F.col("close").alias("top"))
    if before:
        last = last.unionByName(before.last).orderBy(F.desc("session")).limit(1)
        rows = rows.unionByName(before.bars().withColumns({"line": F.lit(None).cast("double"), "top": F.lit(None).cast("double")}))
        tops = before.symbols.select("symbol", *(F.lit(None).cast(t).alias(c) for c, t in (("session", "int"), ("date", "date"), ("close", "double"))), F.col("top_line").alias("line"), F.col("top_close").alias("top"))
        rows = rows.unionByName(tops)
    reach = max(k for k, _ in config.lookbacks)
    rows = rows.crossJoin(F.broadcast(last.select(F.col("session").alias("_last"))))
    bar = F.struct("session", "date", "close")
    kept = F.collect_list(F.when(F.col("session") > F.col("_last") - reach, bar))
    symbols = rows.groupBy("symbol").agg(F.max("line").alias("top_line"), F.max("top").alias("top_close"), F.array_sort(F.array_union(kept, F.array(F.max(F.when(F.col("session").isNotNull(), bar))))).alias("recent"))
    return Carried(symbols, last)


def ratings(bars: DataFrame, config: Strength = Strength(), carried: Carried | None = None) -> DataFrame:
    """(symbol, date, composite_return, rating, rs_line, rs_line_new_high, universe_size) for all rows with a
    composite return."""
    return rated(lines(bars, config, carried))


def rated(lined: DataFrame) -> DataFrame:
    """The rating is 98 times the average-rank percentile plus 1, rounded half to even."""
    rows = lined.filter("composite_return is not null and rs_line is not null")
    day = Window.partitionBy("date")
    ties = Window.partitionBy("date", "composite_return")
    size = F.count(F.lit(1)).over(day)
    place = F.rank().over(day.orderBy("composite_return")) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    return rows.withColumns({"universe_size": size.cast("int"), "_place": place}).select(
        "symbol", "date", "composite_return", F.bround(98 * (F.col("_place") / F.col("universe_size")) + 1).cast("int").alias("rating"), "rs_line", "rs_line_new_high", "universe_size"
    )
