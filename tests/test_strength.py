import datetime as dt

import numpy as np
import pandas as pd
import pytest
from market import bars

from barlens.config import Strength
from barlens.operators import strength

SHORT = Strength(lookbacks=((2, 0.4), (3, 0.2), (4, 0.2), (5, 0.2)))


def brute(rows, config):
    """The same rules on a dense matrix in pandas."""
    f = pd.DataFrame(rows, columns=["symbol", "date", "close"]).pivot(index="date", columns="symbol", values="close")
    composite = sum(w * (f / f.shift(k) - 1) for k, w in config.lookbacks)
    change = f.ffill().pct_change(fill_method=None)
    mark = (1 + change.mean(axis=1).fillna(0)).cumprod()
    line = f.div(mark, axis=0)
    high = (line >= line.shift().cummax().where(line.shift().notna())) & (f < f.shift().cummax().where(f.shift().notna()))
    rating = np.round(98 * composite.rank(axis=1, pct=True) + 1)
    return {(s, d): (composite.at[d, s], rating.at[d, s], line.at[d, s], bool(high.at[d, s])) for d in f.index for s in f.columns if pd.notna(composite.at[d, s]) and pd.notna(line.at[d, s])}


def test_against_a_dense_matrix_with_gaps_and_ties(spark):
    rng = np.random.default_rng(4)
    start, rows = dt.date(2023, 1, 2), []
    for s in range(7):
        price = 100.0
        for d in range(40):
            price = float(np.round(price * np.exp(rng.normal(0, 0.02)), 2))
            if rng.random() > 0.12 and not (s == 3 and d > 30) and not (s == 5 and d < 6):
                rows.append((f"s{s % 7}", start + dt.timedelta(days=d), price))
    rows += [("t1", d, p) for s, d, p in rows if s == "s0"]
    frame = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = {(r.symbol, r.date): (r.composite_return, r.rating, r.rs_line, r.rs_line_new_high) for r in strength.ratings(frame, SHORT).collect()}
    expected = brute(rows, SHORT)
    assert got.keys() == expected.keys() and len(got) > 100
    for k, e in expected.items():
        assert got[k][0] == pytest.approx(e[0]) and got[k][1] == e[1] and got[k][2] == pytest.approx(e[2]) and got[k][3] == e[3]


def test_lookback_on_a_session_without_a_bar_gives_no_rating(spark):
    both = bars(spark, range(100, 110), "A").unionByName(bars(spark, range(50, 60), "B"))
    gap = both.filter("not (symbol = 'B' and date = date'2022-01-10')")
    dates = {r.date for r in strength.ratings(gap, SHORT).filter("symbol = 'B'").collect()}
    assert dates == {dt.date(2022, 1, 8), dt.date(2022, 1, 9), dt.date(2022, 1, 11)} & dates and dt.date(2022, 1, 12) not in dates


def test_universe_size_and_empty(spark):
    r = strength.ratings(bars(spark, range(100, 110), "A"), SHORT)
    assert {x.universe_size for x in r.collect()} == {1} and {x.rating for x in r.collect()} == {99}
    assert strength.ratings(bars(spark, [1.0], "A").filter("false"), SHORT).isEmpty()


def test_closes_of_zero_count_as_in_the_sql(spark):
    """Zeros with and without a bar on the next session, over the SQL's dense grid, at once and from night to night."""
    import duckdb

    from barlens.plans.oracles import STRENGTH

    every = Strength(lookbacks=Strength().lookbacks, positive=False)
    start, rows = dt.date(2020, 1, 1), []
    rng = np.random.default_rng(5)
    for s in "ABCD":
        for d, close in enumerate(np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.05, 330))), 2)):
            zero = (s == "B" and 280 <= d < 283) or (s == "C" and 299 <= d < 302)
            if not (s == "C" and d in (302, 303)) and not (s == "D" and d % 40 == 7):
                rows.append((s, start + dt.timedelta(days=d), 0.0 if zero else float(close)))
    frame = spark.createDataFrame(rows, "symbol string, date date, close double").persist()
    con = duckdb.connect()
    con.sql("CREATE TABLE adj (symbol VARCHAR, date DATE, close DOUBLE)")
    con.executemany("INSERT INTO adj VALUES (?, ?, ?)", rows)
    sql = f"WITH {STRENGTH} SELECT symbol, date, composite_return, rating, rs_line, rs_line_new_high, universe_size FROM ratings"
    expected = {(r[0], r[1]): r[2:] for r in con.sql(sql).fetchall()}

    def check(ratings, since):
        got = {(r.symbol, r.date): (r.composite_return, r.rating, r.rs_line, r.rs_line_new_high, r.universe_size) for r in ratings.collect()}
        want = {k: v for k, v in expected.items() if k[1] > since}
        assert got.keys() == want.keys() and got
        for k, e in want.items():
            assert got[k][0] == pytest.approx(e[0], nan_ok=True) and got[k][2] == pytest.approx(e[2], nan_ok=True) and (got[k][1], *got[k][3:]) == (e[1], *e[3:]), k

    check(strength.ratings(frame, every), start)
    for night in (280, 301, 302):
        until = start + dt.timedelta(days=night)
        carried = strength.carry(strength.lines(frame.filter(frame.date <= until), every), every)
        check(strength.ratings(frame.filter(frame.date > until), every, carried), until)


def test_rounded_as_the_sql_rounds(spark):
    from pyspark.sql import functions as F

    from barlens.plans.testdata import rounded

    values = [19.60965, -19.60965, 1.00005, 70335036569002.44, 1e306, float("inf"), None]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), 4).alias("x")).collect()]
    import duckdb

    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchall()[0][0] for v in values] and got[0] == 19.6096
