import pytest
from market import bars
from pyspark.sql import functions as F

from barlens.config import Score, Volume
from barlens.operators import score, volume


def signals(spark, closes, vols, pivot=None, high=1.0, low=1.0, **config):
    b = bars(spark, closes, volume=vols, high=high, low=low)
    pivots = spark.createDataFrame([("A", pivot)], "symbol string, pivot_price double") if pivot else None
    return volume.signals(b, pivots, Volume(**config)).first()


def test_up_down_ratio(spark):
    r = signals(spark, [100, 101, 99, 102, 98, 103], [1000, 200, 150, 300, 250, 400], up_down_sessions=5)
    assert (r.up_volume, r.down_volume, r.up_down_volume_ratio) == (900, 400, 2.25)
    r = signals(spark, [100, 101, 99, 102, 98], [1000, 200, 150, 300, 250], up_down_sessions=5)
    assert r.up_down_volume_ratio is None and r.up_volume is None
    assert signals(spark, [100, 101, 102], [1, 1, 1], up_down_sessions=2).up_down_volume_ratio is None


def test_distribution_line(spark):
    b = bars(spark, [100, 99, 101, 98, 105], volume=[1000] * 5).withColumns({"high": F.col("close") + 0.2, "low": F.col("close") - 0.8})
    r = volume.signals(b, None, Volume(distribution_sessions=3)).first()
    assert r.accumulation_distribution_value == pytest.approx(3000) and r.accumulation_distribution_rising is True
    flat = signals(spark, [100, 100], [10, 10])
    assert flat.accumulation_distribution_value == 0.0 and flat.accumulation_distribution_rising is None


SPIKE = dict(spike_sessions=5, spike_proximity=0.02, spike_average_sessions=3, spike_multiple=1.5)


def test_spike_near_pivot(spark):
    closes = [100, 101, 102, 100.5, 103, 104]
    r = signals(spark, closes, [400, 450, 500, 500, 300, 1000], 104.0, **SPIKE)
    assert r.volume_spike_near_pivot and r.spike_volume == 1000
    assert not signals(spark, closes, [400, 450, 500, 500, 300, 600], 104.0, **SPIKE).volume_spike_near_pivot
    assert not signals(spark, closes, [400, 450, 500, 500, 300, 1000], None, **SPIKE).volume_spike_near_pivot


ROW = dict(
    symbol="A", daily_date="2024-01-05", daily_rate=1.0, daily_passed=8, daily_evaluated=8, weekly_date="2024-01-05", weekly_rate=7 / 8, stage=2, rating=85, rs_line_new_high=True, has_pattern=True, contraction_count=3,
    depth_decay_passed=True, volume_decay_passed=True, base_length_passed=True, daily_confirmation_available=True, near_pivot=True, tight_closes_confirmed=True, breakout_confirmed=False, quality_grade="A+",
    has_volume=True, up_down_volume_ratio=1.8, accumulation_distribution_rising=True, volume_spike_near_pivot=True,
)
TYPES = (
    "symbol string, daily_date string, daily_rate double, daily_passed int, daily_evaluated int, weekly_date string, weekly_rate double, stage int, rating int, rs_line_new_high boolean, has_pattern boolean, "
    "contraction_count int, depth_decay_passed boolean, volume_decay_passed boolean, base_length_passed boolean, daily_confirmation_available boolean, near_pivot boolean, tight_closes_confirmed boolean, "
    "breakout_confirmed boolean, quality_grade string, has_volume boolean, up_down_volume_ratio double, accumulation_distribution_rising boolean, volume_spike_near_pivot boolean"
)


def scored(spark, config=Score(), **changes):
    row = ROW | changes
    frame = spark.createDataFrame([tuple(row.values())], TYPES).withColumns({c: F.col(c).cast("date") for c in ("daily_date", "weekly_date")})
    return score.combine(score.components(frame, config), config).first()


def test_full_score(spark):
    r = scored(spark)
    assert (r.composite_score, r.gate_passed) == (92.71, True)
    assert (r.trend_template_score, r.stage_score, r.relative_strength_score, r.vcp_score, r.volume_score) == (93.75, 100, 90, pytest.approx(90), 100)
    assert r.fundamentals_evaluated is False and r.fundamentals_score is None


@pytest.mark.parametrize("changes", [{"daily_passed": 5, "daily_rate": 5 / 8}, {"rating": 65}, {"daily_evaluated": 7}])
def test_gates_fail_and_the_score_stays(spark, changes):
    r = scored(spark, **changes)
    assert r.gate_passed is False and r.composite_score > 0


def test_missing_parts_are_renormalised(spark):
    r = scored(spark, stage=None, has_volume=None)
    assert r.composite_score == 91.25 and not r.stage_evaluated and not r.volume_evaluated


def test_neutral_values_and_caps(spark):
    assert scored(spark, up_down_volume_ratio=None, accumulation_distribution_rising=None, volume_spike_near_pivot=None).volume_score == 50
    assert scored(spark, rating=98).relative_strength_score == 100
    none, failed = scored(spark, daily_confirmation_available=False), scored(spark, near_pivot=False, tight_closes_confirmed=False)
    assert none.vcp_score >= failed.vcp_score and none.vcp_score == pytest.approx(85)
    assert scored(spark, stage=9).stage_score == 0


def test_nothing_evaluated_scores_zero(spark):
    r = scored(spark, daily_rate=None, weekly_rate=None, stage=None, rating=None, has_pattern=None, has_volume=None)
    assert r.composite_score == 0.0 and not r.gate_passed


def test_prices_of_zero_count_in_patterns_and_volume_as_in_the_sql(spark):
    import datetime as dt
    import math

    import duckdb
    import numpy as np

    from barlens.config import Contraction, Volume
    from barlens.operators import contraction, volume
    from barlens.plans.oracles import PATTERN, volumes

    rng = np.random.default_rng(8)
    tables = {"adj": 1, "adj_weeks": 7}
    con, frames = duckdb.connect(), {}
    schema = "symbol string, date date, close double, high double, low double, volume bigint"
    for name, step in tables.items():
        rows = []
        for k, s in enumerate("ABCDEF"):
            prices = np.round(np.exp(np.cumsum(rng.normal(0, 1.5, 75))), 1) if k else np.zeros(75)
            if k == 5:
                prices[-12:] = 0.0
            rows += [(s, dt.date(2024, 12, 27) - dt.timedelta(days=step * (74 - i)), float(p), float(p) * 1.01, float(p) * 0.99, int(rng.integers(1, 900))) for i, p in enumerate(prices)]
        con.sql(f"CREATE TABLE {name} (symbol VARCHAR, date DATE, close DOUBLE, high DOUBLE, low DOUBLE, volume BIGINT)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?, ?, ?)", rows)
        frames[name] = spark.createDataFrame(rows, schema).persist()

    def plain(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else v

    def same(frame, sql):
        rel = con.sql(sql)
        got = sorted(repr([plain(r[c]) for c in rel.columns]) for r in frame.collect())
        assert got == sorted(repr([plain(v) for v in r]) for r in rel.fetchall()) and len(got) == 6

    found = contraction.detect(frames["adj_weeks"], frames["adj"], Contraction(positive=False), lists=False)
    same(found, f"WITH {PATTERN} SELECT * FROM patterns")
    pivots = frames["adj"].filter("date = date'2024-12-27'").select("symbol", "close").withColumnRenamed("close", "pivot_price")
    signals = volume.signals(frames["adj"], pivots, Volume(positive=False)).drop("spike_date", "spike_volume")
    lasts = "lasts AS (SELECT symbol, arg_max(close, date) AS pivot_price FROM adj GROUP BY symbol)"
    same(signals, f"WITH {lasts}, {volumes('lasts')} SELECT * EXCLUDE (spike_date, spike_volume) FROM volumes")
