import pytest
from market import bars
from pyspark.sql import functions as F

from barlens.config import PERIODS, Strength, Trend
from barlens.operators import stage, trend


def template(spark, closes, rating=None, timeframe="daily"):
    m = trend.latest(bars(spark, closes), PERIODS[timeframe])
    return trend.template(m.withColumn("rating", F.lit(rating).cast("int"))).first()


def test_short_history_evaluates_only_the_rating(spark):
    r = template(spark, [100 + i for i in range(30)], 80)
    assert r.price_above_150_and_200_ma is None and r.price_above_50_ma is None
    assert (r.evaluated_count, r.passed_count, r.meets_gate) == (1, 1, False)


def test_rising_series_passes_all(spark):
    r = template(spark, [100 * 1.003**i for i in range(400)], 85)
    assert (r.passed_count, r.evaluated_count, r.meets_gate, r.bar_count) == (8, 8, True, 400)


def test_low_rating_fails_one_and_passes_the_gate(spark):
    r = template(spark, [100 * 1.003**i for i in range(400)], 40)
    assert r.passed_count == 7 and r.relative_strength_at_least_70 is False and r.meets_gate


@pytest.mark.parametrize("n, evaluated", [(199, 0), (200, 4), (220, 4), (221, 5), (251, 5), (252, 7)])
def test_history_that_each_criterion_needs(spark, n, evaluated):
    assert template(spark, [100 * 1.003**i for i in range(n)]).evaluated_count == evaluated


def test_latest_is_the_last_row_of_history(spark):
    import math

    b = bars(spark, [100 + 20 * math.sin(i / 17) + i / 9 for i in range(300)]).unionByName(bars(spark, [50 + i % 13 for i in range(230)], "B"))
    last = {r.symbol: r for r in trend.latest(b, PERIODS["daily"]).collect()}
    for h in trend.history(b, PERIODS["daily"]).collect():
        if h.bar_count == last[h.symbol].bar_count:
            for c in trend.MEASURES:
                assert h[c] == pytest.approx(last[h.symbol][c], rel=1e-12) if h[c] is not None else last[h.symbol][c] is None


def test_explained_criteria(spark):
    r = trend.explained(trend.template(trend.latest(bars(spark, [100 * 1.003**i for i in range(400)]), PERIODS["daily"]))).first()
    assert len(r.criteria) == 8 and r.criteria[5].threshold == 0.25 and r.criteria[7].passed is None


@pytest.mark.parametrize("make", [lambda: Trend(least_gain_from_low=-1), lambda: Trend(most_decline_from_high=1.0), lambda: Trend().of("hourly"), lambda: Strength(lookbacks=((63, 0.5),))])
def test_bad_parameters_raise(make):
    with pytest.raises(ValueError):
        make()


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="must contain"):
        trend.latest(bars(spark, [1, 2]).drop("low"), PERIODS["daily"])


def row(spark, price, s, m, lng, prior, passes=7):
    return spark.createDataFrame([("A", None, price, s, m, lng, prior, passes)], "symbol string, date date, close double, ma_short double, ma_medium double, ma_long double, ma_long_prior double, technical_passes int")


@pytest.mark.parametrize(
    "values, expected",
    [((130.0, 120.0, 110.0, 100.0, 95.0), 2), ((70.0, 80.0, 90.0, 100.0, 105.0), 4), ((90.0, 100.0, 110.0, 100.0, 99.9), 3), ((130.0, 100.0, 99.0, 98.0, 98.0), 3), ((101.0, 100.0, 101.0, 100.0, 99.0), 1)],
)
def test_stages(spark, values, expected):
    assert stage.classify(row(spark, *values)).first().stage == expected


def test_stage_without_inputs_is_left_out(spark):
    assert stage.classify(row(spark, 100.0, 90.0, 80.0, None, None)).isEmpty()


def test_a_price_at_its_averages_is_not_above_them(spark):
    b = bars(spark, [0.1] * 260)
    for m in (trend.latest(b, PERIODS["daily"]), trend.history(b, PERIODS["daily"])):
        rows = trend.template(m).filter("bar_count > 221")
        assert rows.select(*trend.CRITERIA[:5]).distinct().collect() == [(False,) * 5]
        assert [tuple(r) for r in stage.classify(rows).select("stage", "price").distinct().collect()] == [(1, 0.1)]
