import datetime as dt
import json
import random

import pytest
from market import bars, textbook
from pyspark.sql import functions as F

from barlens.config import Contraction
from barlens.operators import bars as B
from barlens.operators import contraction as C


def detect(spark, weekly, daily=None):
    none = weekly.filter("false")
    return C.detect(B.adjusted(weekly), B.adjusted(daily if daily is not None else none)).collect()


def test_textbook_pattern(spark):
    (r,) = detect(spark, textbook(spark))
    assert (r.is_vcp, r.contraction_count, r.pivot_price, r.quality_grade, r.base_length_weeks) == (True, 3, 120.0, "B", 16)
    assert r.depth_decay_passed and r.volume_decay_passed and r.base_length_passed and r.reason == "Weekly structure qualifies."
    assert (r.daily_confirmation_available, r.near_pivot, r.tight_close_count, r.breakout_confirmed) == (False, None, 0, False)
    found = json.loads(r.contractions_json)
    assert [round(c["depth_fraction"], 6) for c in found] == [0.2, 0.1 * 124 / 124, 0.05] and [round(c["average_volume"]) for c in found] == [2_000_000, 1_000_000, 500_000]
    assert [(s["type"], s["i"]) for s in json.loads(r.swings_json)] == [("high", 6), ("low", 9), ("high", 12), ("low", 15), ("high", 18), ("low", 21)]


def test_daily_bars_confirm(spark):
    daily = bars(spark, [119.9] * 24 + [120.5], volume=[1000] * 24 + [2000])
    (r,) = detect(spark, textbook(spark), daily)
    assert (r.quality_grade, r.near_pivot, r.tight_closes_confirmed, r.breakout_confirmed, r.tight_close_count) == ("A+", True, True, True, 10)
    loose = bars(spark, [100 + i % 5 * 4 for i in range(24)] + [119])
    (r,) = detect(spark, textbook(spark), loose)
    assert (r.quality_grade, r.tight_closes_confirmed) == ("A", False)


def test_too_short_is_not_given(spark):
    assert detect(spark, bars(spark, [100, 101, 102, 103], step=7)) == []


def test_flat_weeks_have_no_pattern(spark):
    (r,) = detect(spark, bars(spark, [100] * 10, step=7))
    assert (r.is_vcp, r.contraction_count, r.pivot_price, r.quality_grade) == (False, 0, None, "C")
    assert r.reason == "Weekly structure needs: contraction count, depth decay, volume dry-up, base length."


def test_expanding_depths_are_rejected(spark):
    closes = [100, 104, 108, 112, 116, 120, 114, 116, 118, 122, 117, 112, 110, 114, 119, 124, 116, 108, 99, 104, 108, 110, 111, 112]
    (r,) = detect(spark, bars(spark, closes, step=7, high=1.0, low=1.0))
    assert not r.is_vcp and r.contraction_count < 2


def fold(points):
    """Alternating swings by a running comparison."""
    out = []
    for kind, price in points:
        if out and out[-1][0] == kind:
            if (price > out[-1][1]) if kind == "high" else (price < out[-1][1]):
                out[-1] = (kind, price)
        else:
            out.append((kind, price))
    return out


def greedy(depths, tolerance, least):
    """The latest sequence by trying every start."""
    every = []
    for start in range(len(depths)):
        run = [start]
        for i in range(start + 1, len(depths)):
            before = depths[run[-1]]
            if not before or depths[i] / before > tolerance:
                break
            run.append(i)
        every.append(run)
    good = [s for s in every if len(s) >= least]
    return max(good or every, key=lambda s: s[-1], default=[])


def test_islands_equal_running_comparisons(spark):
    rnd = random.Random(3)
    points, depths = {}, {}
    for s in range(300):
        points[f"s{s}"] = [(rnd.choice(["high", "low"]), float(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 14))]
        depths[f"s{s}"] = [rnd.choice([0.4, 0.3, 0.2, 0.1, 0.05, 0.0, -0.1]) for _ in range(rnd.randint(1, 9))]
    raw = spark.createDataFrame([(s, i, 0, k, p) for s, ps in points.items() for i, (k, p) in enumerate(ps)], "symbol string, i int, second int, kind string, price double")
    raw = raw.withColumns({"date": F.current_date(), "cv": F.lit(1.0), "volume": F.lit(1.0)})
    got = {}
    for r in C.swings(raw).orderBy("symbol", "run").collect():
        got.setdefault(r.symbol, []).append((r.kind, r.price))
    assert got == {s: fold(ps) for s, ps in points.items()}
    rows = []
    for s, ds in depths.items():
        for i, d in enumerate(ds):
            rows.append((s, i + 1, d, d / ds[i - 1] if i and ds[i - 1] else None))
    every = spark.createDataFrame(rows, "symbol string, c int, depth_fraction double, depth_ratio_to_prior double")
    for least in (1, 2, 3):
        got = {}
        for r in C.sequence(every, Contraction(min_contractions=least)).orderBy("symbol", "c").collect():
            got.setdefault(r.symbol, []).append(r.c - 1)
        assert got == {s: greedy(ds, 0.8, least) for s, ds in depths.items()}


@pytest.mark.parametrize("ratio, passed", [(0.39, False), (0.4, True), (0.6, True), (0.61, False), (None, False)])
def test_volume_band(spark, ratio, passed):
    rows = spark.createDataFrame(
        [("A", 1, 1, None, 9.0, None), ("A", 2, 2, 0.5, None, ratio)], "symbol string, c int, place int, depth_ratio_to_prior double, start_high double, volume_ratio_to_prior double"
    ).withColumns({"start_date": F.current_date(), "low_date": F.current_date(), "low": F.lit(1.0), "depth_fraction": F.lit(1.0), "average_volume": F.lit(1.0)})
    assert C.checks(rows).first().volume_decay_passed is passed


def test_history_is_what_each_week_would_have_given(spark):
    """Every week's row equals the detector's over the bars up to the end of that week."""
    chance, rows = random.Random(8), []
    for symbol, n in (("A", 420), ("B", 300), ("C", 30)):
        close = 100.0
        for k in range(n):
            close *= 1 + chance.uniform(-0.04, 0.041)
            if chance.random() < 0.9:
                rows.append((symbol, dt.date(2022, 1, 3) + dt.timedelta(days=k), close, close * 1.01, close * 0.99, close, chance.randint(1, 900)))
    daily = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume bigint").withColumn("adj_close", F.col("close")).persist()
    config = Contraction(lookback_weeks=20)
    found = C.history(B.adjusted(B.weekly(daily), on="week_end_date"), B.adjusted(daily), config).persist()
    weeks = [r[0] for r in found.select("date").distinct().orderBy("date").collect()]
    for friday in (weeks[0], weeks[7], weeks[25], weeks[-1]):
        then = daily.filter(F.date_add(F.date_trunc("week", "date").cast("date"), 4) <= friday)
        at_the_time = C.detect(B.adjusted(B.weekly(then), on="week_end_date"), B.adjusted(then), config, lists=False)
        expected = {r.symbol: r for r in at_the_time.collect() if r.date == friday}
        got = {r.symbol: r for r in found.filter(F.col("date") == friday).collect()}
        assert got.keys() == expected.keys()
        for symbol, r in got.items():
            for a, b in zip(r, expected[symbol], strict=True):
                assert a == b or abs(a - b) < 1e-9
    assert found.groupBy("symbol", "date").count().filter("count > 1").isEmpty()
    assert C.history(B.adjusted(B.weekly(daily), on="week_end_date"), B.adjusted(daily), Contraction(lookback_weeks=6)).isEmpty()
