"""The trend template: eight moving-average criteria, each passed, failed or not evaluated (null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.config import Trend, TrendPeriods
from barlens.operators.bars import above, from_end, last_bar, normalised, quotient

CRITERIA = (
    "price_above_150_and_200_ma", "ma_150_above_200", "ma_200_trending_up", "ma_50_above_150_and_200", "price_above_50_ma",
    "price_at_least_25pct_above_52_week_low", "price_within_25pct_of_52_week_high", "relative_strength_at_least_70",
)
MEASURES = ("bar_count", "close", "ma_short", "ma_medium", "ma_long", "ma_long_prior", "low_year", "high_year")


def history(bars: DataFrame, periods: TrendPeriods, positive: bool = True) -> DataFrame:
    """The measures at every bar, from row frames over one window."""
    w = last_bar()
    n = F.row_number().over(w)

    def rolling(fn, column: str, length: int) -> Column:
        return F.when(n >= length, fn(column).over(w.rowsBetween(1 - length, 0)))

    out = normalised(bars, volume=False, positive=positive).select(
        "symbol", "date", "close", n.alias("bar_count"),
        rolling(F.avg, "close", periods.short).alias("ma_short"), rolling(F.avg, "close", periods.medium).alias("ma_medium"), rolling(F.avg, "close", periods.long).alias("ma_long"),
        rolling(F.min, "low", periods.year).alias("low_year"), rolling(F.max, "high", periods.year).alias("high_year"),
    )
    return out.withColumn("ma_long_prior", F.lag("ma_long", periods.month).over(w))


def latest(bars: DataFrame, periods: TrendPeriods, positive: bool = True) -> DataFrame:
    """The measures at each symbol's last bar: bars are numbered from the end and aggregated once, so that
    no frame slides over the history."""
    b = normalised(bars, volume=False, positive=positive).withColumn("_k", from_end(last_bar()))

    def over(fn, column: str, length: int, skip: int = 0) -> Column:
        inside = (F.col("_k") > skip) & (F.col("_k") <= skip + length)
        return F.when(F.count(F.lit(1)) >= length + skip, fn(F.when(inside, F.col(column))))

    return b.groupBy("symbol").agg(
        F.max("date").alias("date"), F.count(F.lit(1)).cast("int").alias("bar_count"), F.max(F.when(F.col("_k") == 1, F.col("close"))).alias("close"),
        over(F.avg, "close", periods.short).alias("ma_short"), over(F.avg, "close", periods.medium).alias("ma_medium"), over(F.avg, "close", periods.long).alias("ma_long"),
        over(F.avg, "close", periods.long, periods.month).alias("ma_long_prior"),
        over(F.min, "low", periods.year).alias("low_year"), over(F.max, "high", periods.year).alias("high_year"),
    )


def template(measures: DataFrame, config: Trend = Trend(), ratings: DataFrame | None = None) -> DataFrame:
    """The criteria, roll-ups and measured shares for rows of measures. ratings: (symbol, date, rating),
    looked up at the row's own date; a criterion is null where its history or rating is missing."""
    m = measures
    if ratings is not None:
        m = m.join(ratings.select("symbol", "date", F.col("rating").alias("rating")), ["symbol", "date"], "left")
    elif "rating" not in m.columns:
        m = m.withColumn("rating", F.lit(None).cast("int"))
    price, s, mid, lng = (F.col(c) for c in ("close", "ma_short", "ma_medium", "ma_long"))
    enough = lng.isNotNull()
    rules = (
        F.when(enough, above(price, mid) & above(price, lng)),
        F.when(enough, above(mid, lng)),
        F.when(F.col("ma_long_prior").isNotNull(), above(lng, F.col("ma_long_prior"))),
        F.when(enough, above(s, mid) & above(s, lng)),
        F.when(enough, above(price, s)),
        F.when(F.col("low_year").isNotNull(), price >= F.col("low_year") * (1 + config.least_gain_from_low)),
        F.when(F.col("high_year").isNotNull(), price >= F.col("high_year") * (1 - config.most_decline_from_high)),
        F.when(F.col("rating").isNotNull(), F.col("rating") >= config.least_rating),
    )
    m = m.withColumns(dict(zip(CRITERIA, rules, strict=True)))

    def tally(test, names) -> Column:
        return sum((F.when(test(F.col(c)), 1).otherwise(0) for c in names), F.lit(0))

    passed = tally(lambda c: F.coalesce(c, F.lit(False)), CRITERIA)
    evaluated = tally(lambda c: c.isNotNull(), CRITERIA)
    m = m.withColumns({"passed_count": passed, "evaluated_count": evaluated, "technical_evaluated": tally(lambda c: c.isNotNull(), CRITERIA[:7]), "technical_passes": tally(lambda c: F.coalesce(c, F.lit(False)), CRITERIA[:7])})
    return m.withColumns(
        {
            "pass_rate": F.col("passed_count") / F.nullif(F.col("evaluated_count"), F.lit(0)),
            "meets_gate": (F.col("passed_count") >= config.gate_passes) & (F.col("evaluated_count") == len(CRITERIA)),
            "minimum_history_available": F.col("technical_evaluated") == 7,
            "all_criteria_evaluated": F.col("evaluated_count") == len(CRITERIA),
            "percent_above_low": quotient(price, F.col("low_year")) - 1,
            "percent_below_high": 1 - quotient(price, F.col("high_year")),
        }
    ).drop("technical_evaluated")


def explained(rows: DataFrame, config: Trend = Trend()) -> DataFrame:
    """(symbol, date, criteria): each criterion as a struct of key, passed, the values measured and the threshold."""
    def entry(key: str, values: dict[str, str], threshold: float | None) -> Column:
        measured = F.create_map(*(x for k, c in values.items() for x in (F.lit(k), F.col(c).cast("double"))))
        return F.struct(F.lit(key).alias("key"), F.col(key).alias("passed"), measured.alias("actual"), F.lit(threshold).cast("double").alias("threshold"))

    averages = {"ma_short": "ma_short", "ma_medium": "ma_medium", "ma_long": "ma_long"}
    price = {"close": "close"}
    return rows.select(
        "symbol", "date",
        F.array(
            entry(CRITERIA[0], price | averages, None), entry(CRITERIA[1], averages, None), entry(CRITERIA[2], {"ma_long": "ma_long", "ma_long_prior": "ma_long_prior"}, None),
            entry(CRITERIA[3], averages, None), entry(CRITERIA[4], price | {"ma_short": "ma_short"}, None),
            entry(CRITERIA[5], price | {"low": "low_year", "share": "percent_above_low"}, config.least_gain_from_low),
            entry(CRITERIA[6], price | {"high": "high_year", "share": "percent_below_high"}, config.most_decline_from_high),
            entry(CRITERIA[7], {"rating": "rating"}, config.least_rating),
        ).alias("criteria"),
    )
