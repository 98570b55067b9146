"""Volatility-contraction patterns on weekly bars, confirmed by daily bars.

Every step is a window or a grouping within a symbol, so that the whole detector runs on one partitioning:
alternating swings are the extremes of runs of one kind, and the chosen sequence of contractions is the last
run (island) of contractions each of which is at most the tolerance times as deep as the one before it,
among those long enough, or else the last run of all. The same steps find the pattern of every past week: raw swings
don't depend on where the weeks looked at begin and end, and each is put to the weeks that look back on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.config import Contraction
from barlens.operators.bars import from_end, normalised, quotient


def lookback(weekly: DataFrame, config: Contraction = Contraction()) -> DataFrame:
    """The last weeks of each symbol: i from 0, n weeks in all, and cv, the volume up to and with each week.
    Symbols with too short a history for any swing are left out."""
    up = Window.partitionBy("symbol").orderBy("date")
    last = normalised(weekly, positive=config.positive).withColumn("_k", from_end(up)).filter(F.col("_k") <= config.lookback_weeks)
    place = F.row_number().over(up)
    out = last.select(
        "symbol", "date", "close", "high", "low", "volume", (place - 1).alias("i"), (F.col("_k") + place - 1).cast("int").alias("n"),
        F.sum("volume").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("cv"),
    )
    return out.filter(F.col("n") >= 2 * config.swing_window + 3)


def raw_swings(weeks: DataFrame, config: Contraction = Contraction()) -> DataFrame:
    """(symbol, i, n, date, kind, price, cv, volume): fractal highs and lows. One is the extreme of its window
    and beyond both of the window's ends; a week can be both, and then the high comes first."""
    k = config.swing_window
    w = Window.partitionBy("symbol").orderBy("i")
    around = w.rowsBetween(-k, k)
    inner = (F.col("i") >= k) & (F.col("i") < F.col("n") - k)
    high, low = F.col("high"), F.col("low")
    is_high = inner & (high == F.max("high").over(around)) & (high > F.lag("high", k).over(w)) & (high > F.lead("high", k).over(w))
    is_low = inner & (low == F.min("low").over(around)) & (low < F.lag("low", k).over(w)) & (low < F.lead("low", k).over(w))
    kinds = F.array(
        F.struct(F.lit(0).alias("second"), F.lit("high").alias("kind"), high.alias("price"), is_high.alias("found")),
        F.struct(F.lit(1).alias("second"), F.lit("low").alias("kind"), low.alias("price"), is_low.alias("found")),
    )
    return weeks.select("symbol", "i", "n", "date", "cv", "volume", kinds.alias("_kinds")).select("symbol", "i", "n", "date", "cv", "volume", F.inline("_kinds")).filter("found").drop("found")


Keys = tuple[str, ...]
SYMBOL: Keys = ("symbol",)


def swings(raw: DataFrame, by: Keys = SYMBOL) -> DataFrame:
    """Alternating swings: of neighbours of one kind the most extreme stays, the earliest among equals. by names what
    is looked at on its own: a symbol, or one of its weeks with those before it."""
    order = Window.partitionBy(*by).orderBy("i", "second")
    changed = F.when(F.col("kind") == F.lag("kind").over(order), 0).otherwise(1)
    runs = raw.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    extreme = F.struct(F.when(F.col("kind") == "high", -F.col("price")).otherwise(F.col("price")).alias("key"), "i", "date", "kind", "price", "cv", "volume")
    return runs.groupBy(*by, "run").agg(F.min(extreme).alias("s")).select(*by, "run", "s.i", "s.date", "s.kind", "s.price", "s.cv", "s.volume")


def contractions(alternating: DataFrame, by: Keys = SYMBOL) -> DataFrame:
    """(symbol, c, start and low, depth, average volume, and both as ratios to the contraction before)."""
    w = Window.partitionBy(*by).orderBy("run")
    following = {f"low_{c}": F.lead(c).over(w) for c in ("i", "date", "kind", "price", "cv")}
    pairs = alternating.withColumns(following).filter("kind = 'high' and low_kind = 'low'")
    order = Window.partitionBy(*by).orderBy("start_i")
    out = pairs.select(
        *by, F.col("i").alias("start_i"), F.col("date").alias("start_date"), F.col("price").alias("start_high"), F.col("low_date"), F.col("low_price").alias("low"),
        quotient(F.col("price") - F.col("low_price"), F.col("price")).alias("depth_fraction"),
        ((F.col("low_cv") - F.col("cv") + F.col("volume")) / (F.col("low_i") - F.col("i") + 1)).alias("average_volume"),
    )

    def ratio(column: str) -> Column:
        return F.col(column) / F.nullif(F.lag(column).over(order), F.lit(0.0))

    return out.withColumns({"c": F.row_number().over(order), "depth_ratio_to_prior": ratio("depth_fraction"), "volume_ratio_to_prior": ratio("average_volume")})


def sequence(every: DataFrame, config: Contraction = Contraction(), by: Keys = SYMBOL) -> DataFrame:
    """The contractions of the chosen sequence of each symbol, numbered from 1 as place of length."""
    order = Window.partitionBy(*by).orderBy("c")
    starts = F.when(F.col("depth_ratio_to_prior") <= config.tolerance, 0).otherwise(1)
    islands = every.withColumn("_starts", starts).withColumn("island", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    of_island = Window.partitionBy(*by, "island")
    sized = islands.withColumns({"length": F.count(F.lit(1)).over(of_island).cast("int"), "place": F.row_number().over(of_island.orderBy("c"))})
    rank = F.when(F.col("length") >= config.min_contractions, 1).otherwise(0)
    chosen = F.max(F.struct(rank.alias("ok"), F.col("island").alias("island"))).over(Window.partitionBy(*by))
    return sized.withColumn("_chosen", chosen).filter("island = _chosen.island").drop("_chosen", "_starts", "island")


def checks(chosen: DataFrame, config: Contraction = Contraction(), by: Keys = SYMBOL) -> DataFrame:
    """One row per symbol: the pivot, the count, the base length and whether each part of the pattern holds.
    The ratio of the sequence's first contraction, to one outside it, does not count."""
    def all_later(test: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(F.col("place") > 1, F.coalesce(test, F.lit(False)))), F.lit(True))

    out = chosen.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("contraction_count"), F.max_by("start_high", "c").alias("pivot_price"), F.max_by("start_date", "c").alias("pivot_date"),
        F.min_by("start_date", "c").alias("_start"), F.max_by("low_date", "c").alias("_end"),
        all_later(F.col("depth_ratio_to_prior") <= config.tolerance).alias("depth_decay_passed"),
        all_later(F.col("volume_ratio_to_prior").between(config.volume_min, config.volume_max)).alias("volume_decay_passed"),
        F.array_sort(F.collect_list(F.struct("start_date", "start_high", "low_date", "low", "depth_fraction", "average_volume", "depth_ratio_to_prior", "volume_ratio_to_prior"))).alias("contractions"),
    )
    weeks = F.when(F.col("contraction_count") >= 2, F.floor(F.datediff("_end", "_start") / 7).cast("int") + 1)
    out = out.withColumn("base_length_weeks", weeks)
    return out.withColumns(
        {
            "count_passed": F.col("contraction_count").between(config.min_contractions, config.max_contractions),
            "base_length_passed": F.coalesce(F.col("base_length_weeks").between(config.base_min_weeks, config.base_max_weeks), F.lit(False)),
        }
    ).drop("_start", "_end")


def daily_confirmation(daily: DataFrame, pivots: DataFrame, config: Contraction = Contraction()) -> DataFrame:
    """(symbol, and the confirmation of a pivot by the last daily bars) for symbols with both."""
    up = Window.partitionBy("symbol").orderBy("date")
    window = max(config.daily_lookback, config.breakout_lookback + 1)
    last = normalised(daily, positive=config.positive).withColumn("k", from_end(up)).filter(F.col("k") <= window)
    recent = F.col("k") <= config.daily_lookback
    top = last.withColumn("anchor", F.last("close").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tight = recent & (quotient(F.abs(F.col("close") - F.col("anchor")), F.col("anchor")) <= config.tight_tolerance)
    low = F.min(F.when(recent, F.col("close")))
    m = top.groupBy("symbol").agg(
        F.max("date").alias("as_of_date"), F.max("anchor").alias("price"), F.max(F.when(F.col("k") == 1, F.col("volume"))).alias("latest_volume"),
        F.sum(F.when(tight, 1).otherwise(0)).cast("int").alias("tight_close_count"), quotient(F.max(F.when(recent, F.col("close"))) - low, low).alias("close_range"),
        F.avg(F.when((F.col("k") > 1) & (F.col("k") <= config.breakout_lookback + 1), F.col("volume"))).alias("average_volume"),
    )
    m = m.join(pivots.filter("pivot_price is not null").select("symbol", "pivot_price"), "symbol")
    return m.select("symbol", "as_of_date", "price", "pivot_price", *_confirmed(config))


def _confirmed(config: Contraction) -> list[Column]:
    """What the measures of the last daily bars say about a pivot."""
    distance = quotient(F.col("price") - F.col("pivot_price"), F.col("pivot_price"))
    return [
        distance.alias("distance_to_pivot_fraction"), (F.abs(distance) <= config.pivot_proximity).alias("near_pivot"), F.col("tight_close_count"), F.col("close_range").alias("tight_close_range_fraction"),
        ((F.col("tight_close_count") >= config.least_tight_closes) & (F.col("close_range") <= config.tight_tolerance)).alias("tight_closes_confirmed"),
        ((F.col("price") > F.col("pivot_price")) & F.coalesce(F.col("latest_volume") >= F.col("average_volume") * config.breakout_multiple, F.lit(False))).alias("breakout_confirmed"),
    ]


RESULT = (
    "symbol", "date", "is_vcp", "quality_grade", "reason", "pivot_price", "pivot_date", "contraction_count", "base_length_weeks", "depth_decay_passed", "volume_decay_passed", "base_length_passed",
    "daily_confirmation_available", "near_pivot", "distance_to_pivot_fraction", "tight_close_count", "tight_closes_confirmed", "breakout_confirmed",
)


def _judged(r: DataFrame) -> DataFrame:
    """Checks and confirmation, either of which may be missing, with is_vcp, the grade and the reason."""
    none = F.lit(False)
    r = r.withColumns({c: F.coalesce(c, none) for c in ("depth_decay_passed", "volume_decay_passed", "base_length_passed", "count_passed", "tight_closes_confirmed", "breakout_confirmed")})
    r = r.withColumns({"daily_confirmation_available": F.col("near_pivot").isNotNull(), "contraction_count": F.coalesce("contraction_count", F.lit(0)), "tight_close_count": F.coalesce("tight_close_count", F.lit(0))})
    structure = F.col("count_passed") & F.col("depth_decay_passed") & F.col("base_length_passed")
    r = r.withColumn("is_vcp", structure & F.col("volume_decay_passed"))
    near = F.coalesce("near_pivot", none)
    grade = (
        F.when(F.col("is_vcp") & F.col("tight_closes_confirmed") & near, "A+").when(F.col("is_vcp") & (near | F.col("breakout_confirmed")), "A").when(structure, "B").otherwise("C")
    )
    failed = F.concat_ws(
        ", ", *(F.when(~F.col(c), name) for c, name in (("count_passed", "contraction count"), ("depth_decay_passed", "depth decay"), ("volume_decay_passed", "volume dry-up"), ("base_length_passed", "base length")))
    )
    reason = F.when(F.col("is_vcp"), "Weekly structure qualifies.").otherwise(F.concat(F.lit("Weekly structure needs: "), failed, F.lit(".")))
    return r.withColumns({"quality_grade": grade, "reason": reason})


def _looked_back_on(weekly: DataFrame, config: Contraction) -> tuple[DataFrame, DataFrame]:
    """(weeks, raw): the weeks with enough history, and raw swings once for each week whose look back has them: a
    swing needs swing_window weeks on either side, and is in no more weeks than the look back is long."""
    k, w = config.swing_window, Window.partitionBy("symbol").orderBy("date")
    numbered = normalised(weekly, positive=config.positive).select(
        "symbol", "date", "close", "high", "low", "volume", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).cast("int").alias("n"),
        F.sum("volume").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cv"),
    )
    # one that ends the symbol's weeks is not inside them, but is for no week either
    raw = raw_swings(numbered, config)
    first, last = F.greatest(F.col("i") + k, F.lit(2 * k + 2)), F.least(F.col("n") - 1, F.col("i") + config.lookback_weeks - 1 - k)
    raw = raw.filter(first <= last).withColumn("week", F.explode(F.sequence(first, last)))
    return numbered.filter((F.col("i") >= 2 * k + 2) & F.lit(config.lookback_weeks >= 2 * k + 3)).select("symbol", F.col("i").alias("week"), "date"), raw


def _confirmation_by_bar(daily: DataFrame, config: Contraction) -> DataFrame:
    """The measures of the last daily bars as of every bar, with the Friday of its week."""
    w = Window.partitionBy("symbol").orderBy("date")
    recent = w.rowsBetween(-(config.daily_lookback - 1), 0)
    close = F.col("close")
    tight = sum((F.when(quotient(F.abs(F.lag("close", k).over(w) - close), close) <= config.tight_tolerance, 1).otherwise(0) for k in range(1, config.daily_lookback)), F.lit(1))
    low = F.min("close").over(recent)
    return normalised(daily, positive=config.positive).select(
        "symbol", "date", F.date_add(F.date_trunc("week", "date").cast("date"), 4).alias("friday"), close.alias("price"), F.col("volume").alias("latest_volume"), tight.cast("int").alias("tight_close_count"),
        quotient(F.max("close").over(recent) - low, low).alias("close_range"), F.avg("volume").over(w.rowsBetween(-config.breakout_lookback, -1)).alias("average_volume"),
    )


def history(weekly: DataFrame, daily: DataFrame, config: Contraction = Contraction()) -> DataFrame:
    """The columns of RESULT for every symbol and week with enough weeks before it, as detect() would have given them
    at the end of that week. Bars are adjusted, and daily bars are of the weeks that weekly has.

    Each step is partitioned by symbol. Swings are found once; a week's own are chosen by windows within (symbol,
    week), so that there is no join of weeks with weeks. The daily measures are those of the last bar until the week's end."""
    by = ("symbol", "week")
    weeks, raw = _looked_back_on(weekly, config)
    checked = checks(sequence(contractions(swings(raw, by), by), config, by), config, by)
    measures = ("price", "latest_volume", "tight_close_count", "close_range", "average_volume")
    bars = _confirmation_by_bar(daily, config).select("symbol", "friday", "date", F.struct(*measures).alias("m"), F.lit(None).cast("int").alias("week"))
    ends = weeks.select("symbol", F.col("date").alias("friday"), "date", F.lit(None).cast(bars.schema["m"].dataType).alias("m"), "week")
    # at the end of a week after its bars; the week's own row is the last of its Friday
    order = Window.partitionBy("symbol").orderBy("friday", F.col("week").isNotNull(), "date").rowsBetween(Window.unboundedPreceding, 0)
    known = bars.unionByName(ends).withColumn("m", F.last("m", ignorenulls=True).over(order)).filter("week is not null")
    r = known.select("symbol", "week", "date", "m.*").join(checked, list(by), "left")
    confirmed = ("distance_to_pivot_fraction", "near_pivot", "tight_close_count", "tight_closes_confirmed", "breakout_confirmed")
    r = r.select("symbol", "week", "date", *checked.columns[2:], *_confirmed(config))
    return _judged(r.withColumns({c: F.when(F.col("near_pivot").isNotNull(), F.col(c)) for c in confirmed})).select(*RESULT)


def detect(weekly: DataFrame, daily: DataFrame, config: Contraction = Contraction(), *, lists: bool = True) -> DataFrame:
    """One row per symbol with enough weeks, as stored. weekly and daily are adjusted bars; lists adds the
    contractions and swings as JSON."""
    weeks = lookback(weekly, config)
    alternating = swings(raw_swings(weeks, config))
    checked = checks(sequence(contractions(alternating), config), config)
    as_of = weeks.groupBy("symbol").agg(F.max("date").alias("date"))
    confirmed = daily_confirmation(daily, checked, config)
    r = _judged(as_of.join(checked, "symbol", "left").join(confirmed.drop("pivot_price", "as_of_date", "price"), "symbol", "left"))
    if not lists:
        return r.select(*RESULT)
    points = alternating.groupBy("symbol").agg(F.to_json(F.array_sort(F.collect_list(F.struct("i", "date", F.col("kind").alias("type"), "price")))).alias("swings_json"))
    r = r.join(points, "symbol", "left")
    return r.select(*RESULT, F.coalesce(F.to_json("contractions"), F.lit("[]")).alias("contractions_json"), F.coalesce("swings_json", F.lit("[]")).alias("swings_json"))
