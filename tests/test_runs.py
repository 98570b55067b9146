"""Stored runs: goldens, idempotence, rejection, backfill, the daily pipeline."""

import datetime as dt

import pytest
from market import BAR, bars, textbook
from pyspark.sql import functions as F

from barlens.catalog import Catalog
from barlens.config import load_settings
from barlens.plans import runs, state
from barlens.plans.http import respond
from barlens.schema import INSTRUMENT


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/store")


def universe(spark, *symbols, active=True):
    return spark.createDataFrame([(s, None, None, None, None, active) for s in symbols], "symbol string, isin string, sector string, industry string, listing_date date, is_active boolean")


class Files:
    """A provider over given bars."""

    name = "files"

    def __init__(self, spark, frame, instruments=("A", "B")):
        self.spark, self.frame, self.asked = spark, frame, None
        self.instruments = instruments

    def list_instruments(self, exchange):
        rows = [(s, s, exchange, "EQ", "EQ", f"I{s}", s) for s in self.instruments] + [("FUT", "9", exchange, "FO", "FUT", None, None)]
        return self.spark.createDataFrame(rows, INSTRUMENT)

    def fetch_daily(self, requests):
        self.asked = requests.collect()
        return self.frame.join(requests.select("symbol", "from_date", "to_date"), "symbol").filter("date between from_date and to_date").select(*self.frame.columns)


def test_empty_catalog_reads(catalog):
    assert catalog.read("scores_daily").isEmpty() and runs.latest_scores(catalog).isEmpty()
    with pytest.raises(ValueError):
        catalog.read("no_table")


def test_upsert_twice_changes_nothing(spark, catalog):
    rows = bars(spark, range(100, 110))
    for _ in range(2):
        catalog.upsert("ohlcv_daily", rows)
    assert catalog.read("ohlcv_daily").count() == 10
    catalog.upsert("ohlcv_daily", rows.limit(1).withColumn("close", F.lit(1.0)))
    assert catalog.read("ohlcv_daily").count() == 10 and catalog.read("ohlcv_daily").filter("close = 1").count() == 1


def versions(catalog, name):
    return {part: len(held) for part, held in catalog._current(name).items()}


def test_new_keys_are_added_as_files(spark, catalog):
    catalog.upsert("ohlcv_daily", bars(spark, range(100, 110)), mostly_new=True)
    later = bars(spark, range(100, 115)).orderBy(F.desc("date")).limit(5)
    catalog.upsert("ohlcv_daily", later, mostly_new=True)
    assert catalog.read("ohlcv_daily").count() == 15 and set(versions(catalog, "ohlcv_daily").values()) == {2}
    catalog.upsert("ohlcv_daily", later.limit(1).withColumn("close", F.lit(1.0)), mostly_new=True)
    assert catalog.read("ohlcv_daily").count() == 15 and catalog.read("ohlcv_daily").filter("close = 1").count() == 1
    assert set(versions(catalog, "ohlcv_daily").values()) == {1}


def test_appends_add_files_and_are_joined_in_time(spark, catalog, monkeypatch):
    monkeypatch.setattr("barlens.catalog.VERSIONS_A_PART", 3)
    for k in range(5):
        runs._log(catalog, f"run {k}", k, 0, k, "")
        assert versions(catalog, "ingestion_log") == {"all": (1, 2, 3, 1, 2)[k]}
        assert sorted(r.run_id for r in catalog.read("ingestion_log").collect()) == [f"run {j}" for j in range(k + 1)]


def test_replacement_writes_only_years_that_differ(spark, catalog):
    def weeks(symbol, *rows):
        return spark.createDataFrame([(symbol, dt.date.fromisoformat(d), c, None) for d, c in rows], "symbol string, week_end_date date, close double, open double")

    a, b = weeks("A", ("2020-01-03", 1.0), ("2021-01-08", 2.0), ("2022-01-07", 3.0)), weeks("B", ("2020-01-03", 9.0), ("2022-01-07", 9.0))
    catalog.replace("ohlcv_weekly", a.union(b))
    first = catalog._current("ohlcv_weekly")
    catalog.replace("ohlcv_weekly", a)
    assert catalog._current("ohlcv_weekly") == first
    catalog.replace("ohlcv_weekly", weeks("A", ("2020-01-03", 1.0), ("2022-01-07", 4.0), ("2022-01-14", 5.0)))
    after = catalog._current("ohlcv_weekly")
    assert set(after) == {"2020", "2022"} and after["2020"] == first["2020"] and after["2022"] != first["2022"]
    got = sorted((r.symbol, str(r.week_end_date), r.close) for r in catalog.read("ohlcv_weekly").collect())
    assert got == [("A", "2020-01-03", 1.0), ("A", "2022-01-07", 4.0), ("A", "2022-01-14", 5.0), ("B", "2020-01-03", 9.0), ("B", "2022-01-07", 9.0)]


def test_an_unfinished_version_is_not_read(spark, catalog, tmp_path):
    catalog.upsert("ohlcv_daily", bars(spark, [1, 2]))
    bars(spark, [1, 2, 3]).withColumn("part", F.lit(2022)).write.partitionBy("part").parquet(f"{catalog.root}/ohlcv_daily/v=2")
    assert catalog.read("ohlcv_daily").count() == 2
    catalog.upsert("ohlcv_daily", bars(spark, [1, 2, 3, 4]))
    assert catalog.read("ohlcv_daily").count() == 4


def test_a_merge_writes_only_the_years_it_touches(spark, catalog, tmp_path):
    catalog.upsert("ohlcv_daily", bars(spark, range(100, 900)))
    before = {(r.date, r.close) for r in catalog.read("ohlcv_daily").collect()}
    for k in range(4):
        catalog.upsert("ohlcv_daily", bars(spark, [float(k + 1)], start=dt.date(2023, 5, 1)))
    after = {(r.date, r.close) for r in catalog.read("ohlcv_daily").collect()}
    assert len(after) == 800 and len(after - before) == 1 and (dt.date(2023, 5, 1), 4.0) in after
    assert sorted(p.name for p in (tmp_path / "store/ohlcv_daily").iterdir()) == ["v=1", "v=4", "v=5"]
    assert [p.name for p in (tmp_path / "store/ohlcv_daily/v=5").iterdir() if p.is_dir()] == ["part=2023"]
    assert {r.date.year for r in catalog.read("ohlcv_daily", ["2022"]).select("date").distinct().collect()} == {2022}
    catalog.write("ohlcv_daily", bars(spark, [1.0]))
    assert catalog.read("ohlcv_daily").count() == 1


def test_daily_update_rejects_a_bad_symbol_and_repeats(spark, catalog):
    good = bars(spark, range(100, 115))
    bad = bars(spark, range(50, 60), "B").withColumn("low", F.when(F.col("date") == dt.date(2022, 1, 5), 99.0).otherwise(F.col("low")))
    provider = Files(spark, good.unionByName(bad))
    assert runs.sync_instruments(catalog, provider) == 2
    assert catalog.read("universe").filter("is_active").isEmpty()
    assert runs.apply_universe(catalog, "all", catalog.read("universe").select("symbol"), "2022-02-01")["active_symbols"] == 2
    r = runs.daily_update(catalog, provider, "2022-01-12")
    assert (r["symbols_updated"], r["symbols_failed"], r["rows_added"]) == (1, 1, 10)
    assert "B: invalid bar on 2022-01-05" in catalog.read("ingestion_log").first().notes
    r = runs.daily_update(catalog, provider, "2022-01-31")
    assert r["rows_added"] == 5 and catalog.read("ohlcv_daily").count() == 15
    assert {x.symbol: x.from_date for x in provider.asked}["A"] == dt.date(2022, 1, 13)
    assert runs.daily_update(catalog, provider, "2022-01-17")["rows_added"] == 0
    weeks = {w.week_end_date: w.volume for w in catalog.read("ohlcv_weekly").collect()}
    assert weeks == {dt.date(2022, 1, 7): 7_000_000, dt.date(2022, 1, 14): 7_000_000, dt.date(2022, 1, 21): 1_000_000}
    assert catalog.read("ohlcv_daily").filter("adj_close = close").count() == 15


def test_backfill(spark, catalog):
    provider = Files(spark, bars(spark, range(100, 110)).unionByName(bars(spark, range(10, 20), "B")))
    runs.sync_instruments(catalog, provider)
    runs.apply_universe(catalog, "all", catalog.read("universe").select("symbol"), "2022-02-01")
    with pytest.raises(ValueError):
        runs.backfill_batch(catalog, provider, "2022-01-12", 0)
    assert [r["batch"] for r in runs.backfill_all(catalog, provider, "2022-01-12", 1)] == [["A"], ["B"]]
    assert runs.backfill_batch(catalog, provider, "2022-01-12")["batch"] == []


def test_backfill_stops_when_nothing_comes(spark, catalog):
    provider = Files(spark, bars(spark, [1.0]).filter("false"))
    runs.sync_instruments(catalog, provider)
    runs.apply_universe(catalog, "all", catalog.read("universe").select("symbol"), "2022-02-01")
    assert len(runs.backfill_all(catalog, provider, "2022-01-12")) == 1


def test_snapshot_is_kept_once(spark, catalog):
    catalog.write("universe", universe(spark, "A", "B"))
    for _ in range(2):
        runs.apply_universe(catalog, "mine", universe(spark, "B").select("symbol"), "2024-01-01")
    assert catalog.read("universe_memberships").count() == 1
    assert {r.symbol: r.is_active for r in catalog.read("universe").collect()} == {"A": False, "B": True}


def test_isin_and_listing_dates(spark, catalog):
    catalog.write("universe", universe(spark, "A", "B").withColumn("isin", F.lit("OLD")))
    runs.sync_instruments(catalog, Files(spark, None, ("A", "C")))
    assert {r.symbol: r.isin for r in catalog.read("universe").collect()} == {"A": "IA", "B": "OLD", "C": "IC"}
    staged = spark.createDataFrame([("A", dt.date(2000, 1, 1)), ("X", dt.date(2001, 1, 1))], "symbol string, listing_date date")
    assert runs.sync_listing_dates(catalog, staged) == {"matched_symbols": 1, "updated_symbols": 1, "unmatched_universe_symbols": 2}
    assert runs.sync_listing_dates(catalog, staged)["updated_symbols"] == 0


def test_patterns_and_volume_are_stored_once(spark, catalog):
    catalog.write("universe", universe(spark, "A"))
    catalog.upsert("ohlcv_weekly", textbook(spark).withColumnRenamed("date", "week_end_date"))
    closes = [100 + 0.5 * i for i in range(55)]
    for i in (10, 20, 30, 40):
        closes[i] -= 3
    closes[-1] += 2
    daily = bars(spark, closes, start=dt.date(2024, 4, 1), volume=[100_000] * 54 + [500_000], high=1.002, low=0.99)
    catalog.upsert("ohlcv_daily", daily)
    for _ in range(2):
        assert runs.run_patterns(catalog) == {"symbols_evaluated": 1, "symbols_flagged_vcp": 1}
    assert runs.latest_patterns(catalog).count() == 1 and runs.latest_patterns(catalog).first().pivot_price == 120.0
    catalog.upsert("vcp_results_weekly", catalog.read("vcp_results_weekly").withColumn("pivot_price", F.lit(float(closes[-1]))))
    for _ in range(2):
        assert runs.run_volume(catalog) == {"symbols_evaluated": 1, "symbols_with_pivot_spike": 1}
    r = runs.latest_volumes(catalog).first()
    assert r.up_down_volume_ratio > 1 and r.accumulation_distribution_rising and r.spike_volume == 500_000 and catalog.read("volume_signals_daily").count() == 1


def test_scoring_of_stored_parts(spark, catalog):
    catalog.write("universe", universe(spark, "A"))
    daily = bars(spark, [100 * 1.0015**i for i in range(400)])
    catalog.upsert("ohlcv_daily", daily)
    last = daily.agg(F.max("date")).first()[0]
    catalog.upsert("rs_ratings_daily", spark.createDataFrame([("A", last, 0.3, 85, 1.0, True, 1)], Catalog.schema("rs_ratings_daily")))
    catalog.upsert("market_stages_daily", spark.createDataFrame([("A", last, 2, 1.0, 1.0, 1.0, 1.0, 0.1, 7)], Catalog.schema("market_stages_daily")))
    pattern = ("A", last, True, "A+", "", 1.0, last, 3, 10, True, True, True, True, True, 0.0, 5, True, True, "[]", "[]")
    catalog.upsert("vcp_results_weekly", spark.createDataFrame([pattern], Catalog.schema("vcp_results_weekly")))
    catalog.upsert("volume_signals_daily", spark.createDataFrame([("A", last, 2.5, 5.0, 2.0, 1.0, True, 1.0, True, last, 1.0)], Catalog.schema("volume_signals_daily")))
    for _ in range(2):
        assert runs.run_scoring(catalog) == {"symbols_evaluated": 1, "symbols_gate_passed": 1}
    (r,) = runs.latest_scores(catalog).collect()
    assert r.composite_score == 97.78 and r.gate_passed
    assert runs.scores(catalog, "per_symbol").first().composite_score == 97.78
    with pytest.raises(ValueError):
        runs.scores(catalog, "never")
    assert len(runs.symbol_template(catalog, "A").first().criteria) == 8
    assert runs.symbol_score(catalog, "A").first().composite_score == 97.78 and runs.symbol_score(catalog, "Z").isEmpty()
    assert runs.symbol_volume(catalog, "A").first().pivot_price_used == 1.0 and runs.symbol_pattern(catalog, "A").isEmpty()


def test_all_analytics_and_quality(spark, catalog, tmp_path):
    catalog.write("universe", universe(spark, "A", "B"))
    both = bars(spark, [100 * 1.002**i for i in range(420)]).unionByName(bars(spark, [80 + i % 9 for i in range(420)], "B").filter("date <> date'2022-03-01'"))
    catalog.upsert("ohlcv_daily", both)
    runs.resample(catalog, both.select("symbol").distinct())
    done = runs.run_analytics(catalog)
    assert done["stages"]["symbols_classified"] == 2 and done["scores"]["symbols_evaluated"] == 2
    best = runs.latest_scores(catalog).first()
    assert best.symbol == "A" and best.stage == 2
    q = runs.run_quality(catalog, f"file://{tmp_path}/quality")
    assert (q["daily_rows"], q["missing_observed_market_dates"], q["weekly_reconciliation_mismatches"], q["stale_close_runs_over_10_sessions"]) == (839, 1, 0, 0)
    assert q["symbols_with_missing_dates"] == 1
    (flagged,) = spark.read.json(f"file://{tmp_path}/quality/missing_dates").collect()
    assert flagged.symbol == "B" and flagged.missing_dates == ["2022-03-01"]
    assert spark.read.json(f"file://{tmp_path}/quality/totals").first().daily_rows == 839
    over_http(catalog)


def over_http(catalog):
    """What the stored tables above answer."""
    def get(path):
        return respond(path, settings, catalog)

    settings = load_settings({}, None)
    assert [r["symbol"] for r in get("/universe")[1]] == ["A", "B"] and [r["symbol"] for r in get("/universe?offset=1&limit=1")[1]] == ["B"]
    scores = get("/scores/today")[1]
    assert scores[0]["symbol"] == "A" and len(scores) == 2 and "sector" in scores[0]
    assert [r["symbol"] for r in get(f"/scores/today?min_score={scores[0]['composite_score']}")[1]] == ["A"]
    assert get("/scores/today?sector=none")[1] == [] and get("/scores/today?min_score=high")[0] == 422 and get("/universe?limit=-1")[0] == 422
    status, stock = get("/stock/a?limit=5")
    assert status == 200 and stock["symbol"] == "A" and len(stock["bars"]) == 5 and stock["bars"][0]["date"] > stock["bars"][1]["date"]
    assert len(stock["template"]["criteria"]) == 8 and stock["stage"]["stage"] == 2 and stock["scores"][0]["symbol"] == "A" and stock["ratings"]
    assert get("/stock/Z")[0] == 404 == get("/stock/a/other")[0] and get("/stock/A/vcp-setups") == (200, [])
    assert get("/ingestion/status")[1] == {"last_run": None, "latest_bar": stock["bars"][0]["date"]}


def nights(spark):
    """Bars of four symbols: one begins late, one has gaps, one ends early; and a split at a session."""
    def walk(symbol, n, step, skip=(), start=0):
        rows = bars(spark, [(100 + 7 * step) * (1 + 0.002 * step) ** i + (i * step) % 11 for i in range(start, n)], symbol, dt.date(2022, 1, 3) + dt.timedelta(days=start), volume=[1000 + i * step % 77 for i in range(start, n)], high=1.01, low=0.985)
        return rows.filter(~F.col("date").cast("string").isin(list(skip)))

    every = walk("A", 420, 1).unionByName(walk("B", 420, 2, ("2022-05-05", "2023-02-20"))).unionByName(walk("C", 420, 3, start=150)).unionByName(walk("D", 395, -1))
    first = F.col("date") < "2023-01-20"
    return every.filter(first), every.filter(~first & (F.col("date") < "2023-02-10")), every.filter(F.col("date") >= "2023-02-10")


def rounded(v):
    return round(v, 6) if isinstance(v, float) else [rounded(x) for x in v] if isinstance(v, list | tuple) else v


def table(catalog, name):
    return sorted((tuple(map(rounded, r)) for r in catalog.read(name).collect()), key=repr)


def test_nightly_runs_read_new_bars_and_equal_a_run_over_all(spark, catalog, tmp_path, monkeypatch):
    """Ratings of all sessions, signals and the carried state after three nights are those of one run over everything;
    later nights get only the bars that were added."""
    whole = Catalog(spark, f"file://{tmp_path}/whole")
    for c in (catalog, whole):
        c.write("universe", universe(spark, "A", "B", "C", "D"))
    seen, plain = [], runs.B.adjusted

    def counted(frame, *a, **kw):
        seen.append(frame.count())
        return plain(frame, *a, **kw)

    monkeypatch.setattr(runs.B, "adjusted", counted)
    parts = nights(spark)
    for part in parts:
        catalog.upsert("ohlcv_daily", part, mostly_new=True)
        runs.run_strength(catalog)
        runs.run_volume(catalog)
    assert seen == [n for part in parts for n in [part.count()] * 2]
    for part in parts:
        whole.upsert("ohlcv_daily", part, mostly_new=True)
    runs.run_strength(whole)
    runs.run_volume(whole)
    for name in ("rs_ratings_daily", "strength_calendar", "strength_symbols", "volume_symbols"):
        assert table(catalog, name) == table(whole, name) and table(whole, name)
    last = catalog.read("volume_signals_daily").groupBy("symbol").agg(F.max("date").alias("date"))
    assert sorted(map(repr, (r for r in table(whole, "volume_signals_daily")))) == sorted(repr(r) for r in table(catalog, "volume_signals_daily") if (r[0], r[1]) in {tuple(x) for x in last.collect()})
    seen.clear()
    runs.run_strength(catalog)
    assert seen == [0]


@pytest.mark.parametrize("change", ["replaced", "late", "universe", "settings", "half"])
def test_carried_state_is_not_used_where_the_past_changes(spark, catalog, tmp_path, change):
    from barlens.config import Strength

    first, second, third = nights(spark)
    catalog.write("universe", universe(spark, "A", "B", "C", "D", "E"))
    catalog.upsert("ohlcv_daily", first)
    runs.run_strength(catalog)
    catalog.upsert("ohlcv_daily", second, mostly_new=True)
    config = Strength()
    if change == "replaced":
        catalog.upsert("ohlcv_daily", first.filter("symbol = 'A' and date = '2022-06-01'").withColumn("close", F.lit(50.0)))
    elif change == "late":
        catalog.upsert("ohlcv_daily", bars(spark, [10.0, 11.0], "E", dt.date(2022, 6, 1)), mostly_new=True)
    elif change == "universe":
        catalog.write("universe", universe(spark, "A", "B", "C", "E"))
    elif change == "settings":
        config = Strength(pad_gaps=False)
    else:
        catalog.write("strength_symbols", catalog.read("strength_symbols").limit(1))
    runs.run_strength(catalog, config)
    whole = Catalog(spark, f"file://{tmp_path}/whole")
    whole.write("universe", catalog.read("universe"))
    whole.upsert("ohlcv_daily", catalog.read("ohlcv_daily"))
    runs.run_strength(whole, config)
    kept = {tuple(r[:2]) for r in table(whole, "rs_ratings_daily")}
    assert [r for r in table(catalog, "rs_ratings_daily") if tuple(r[:2]) in kept] == table(whole, "rs_ratings_daily")
    assert table(catalog, "strength_symbols") == table(whole, "strength_symbols")


def test_actions_adjust_the_bars_before_them_once(spark, catalog):
    """A split, a bonus on the same date and a dividend; other symbols and years stay as they are."""
    catalog.write("universe", universe(spark, "A", "B"))
    long = bars(spark, [100.0] * 200 + [50.0] * 200, "A", dt.date(2022, 6, 15))
    catalog.upsert("ohlcv_daily", long.unionByName(bars(spark, [10.0] * 30, "B", dt.date(2021, 6, 1))).withColumn("adj_close", F.col("close")))
    runs.resample(catalog, catalog.read("ohlcv_daily").select("symbol").distinct())
    split = dt.date(2022, 6, 15) + dt.timedelta(days=200)
    found = spark.createDataFrame([("A", split, "SPLIT", "2:1"), ("A", dt.date(2023, 6, 1), "dividend", "5"), ("A", dt.date(2023, 6, 1), "bonus", "1:1"), ("A", split, "merger", "?"), ("Z", split, "split", "3:1")], "symbol string, ex_date date, action_type string, ratio string")
    kept = catalog.newest("ohlcv_daily")
    done = runs.record_actions(catalog, found)
    assert done["actions"] == 5 and done["bars_adjusted"] == (dt.date(2023, 6, 1) - dt.date(2022, 6, 15)).days
    rows = {r.date: r.adj_close for r in catalog.read("ohlcv_daily").filter("symbol = 'A'").collect()}
    assert rows[dt.date(2022, 6, 15)] == pytest.approx(100 * 0.5 * 0.5 * 0.9) and rows[split] == pytest.approx(50 * 0.5 * 0.9) and rows[dt.date(2023, 6, 1)] == 50.0
    assert catalog.newest("ohlcv_daily") == kept + 1 and catalog._current("ohlcv_daily")["2021"] == [kept]
    assert catalog.read("ohlcv_weekly").filter("symbol = 'A'").orderBy("week_end_date").first().adj_close == pytest.approx(22.5)
    assert runs.record_actions(catalog, found) == {"actions": 0, "bars_adjusted": 0} and catalog.newest("ohlcv_daily") == kept + 1


def test_every_failed_symbol_is_noted(spark, catalog):
    names = [f"S{k:03}" for k in range(70)]
    catalog.write("universe", universe(spark, *names, "A"))
    bad = spark.createDataFrame([(s, dt.date(2024, 1, 2), 1.0, 1.0, 2.0, 1.0, 1, None) for s in names], BAR)
    provider = Files(spark, bad.unionByName(bars(spark, [10.0], "A", dt.date(2024, 1, 2))), (*names, "A"))
    runs.sync_instruments(catalog, provider)
    catalog.write("universe", universe(spark, *names, "A"))
    done = runs.daily_update(catalog, provider, "2024-01-05")
    notes = catalog.read("ingestion_log").first().notes.split("; ")
    assert (done["symbols_failed"], done["symbols_updated"]) == (70, 1)
    assert notes == ["controlled incremental update", *(f"{s}: invalid bar on 2024-01-02" for s in names)]


def test_watchlists_and_presets(catalog):
    def post(path, body, **kw):
        return respond(path, settings, catalog, method="POST", body=body, **kw)

    settings = load_settings({}, None)
    assert respond("/watchlist", settings, catalog) == (200, []) == respond("/screener/presets", settings, catalog)
    for _ in range(2):
        assert post("/watchlist", {"name": "mine", "symbols": ["b", "A", "A"]})[0] == 200
    assert [(r["watchlist"], r["symbol"]) for r in respond("/watchlist", settings, catalog)[1]] == [("mine", "A"), ("mine", "B")]
    state.remove_symbols(catalog, "mine", ["A"])
    assert [r.symbol for r in state.watchlist(catalog, "mine").collect()] == ["B"]
    state.drop_watchlist(catalog, "mine")
    assert state.watchlist(catalog).isEmpty() and catalog.read("watchlists").isEmpty()
    for least in (50, 60):
        assert post("/screener/presets", {"name": "strong", "filters": {"min_score": least}})[0] == 200
    (p,) = respond("/screener/presets", settings, catalog)[1]
    assert (p["name"], p["filters"]) == ("strong", {"min_score": 60})
    assert post("/watchlist", {"symbols": ["A"]})[0] == 422 == post("/screener/presets", {"name": "x", "filters": "y"})[0] and post("/universe", {})[0] == 405
    assert post("/ingest/run", {})[0] == 503 and post("/ingest/run", {}, ingest=lambda: {"rows_added": 3}) == (200, {"rows_added": 3})


def test_new_symbols_are_added_to_the_weeks_as_files(spark, catalog):
    for symbol in ("A", "B"):
        rows = bars(spark, range(100, 110), symbol)
        catalog.upsert("ohlcv_daily", rows, mostly_new=True)
        runs.resample(catalog, rows.select("symbol").distinct())
    assert set(versions(catalog, "ohlcv_weekly").values()) == {2}
    assert catalog.read("ohlcv_weekly").select("symbol").distinct().count() == 2
    with catalog.staged(rows) as held:
        assert held.count() == 10 and held.schema == rows.schema
    with pytest.raises(Exception, match="(?i)path|exist"):
        held.count()


FILING = "symbol string, period_start date, period_end date, announcement_date date, is_consolidated boolean, revenue double, basic_eps double, source string, fields_missing boolean, announcement_date_is_estimated boolean, arrival bigint"


def filing(end, eps, sales, *, announced=None, consolidated=True, missing=False, arrival=1, symbol="A"):
    end = dt.date.fromisoformat(end)
    return (symbol, end - dt.timedelta(days=90), end, dt.date.fromisoformat(announced) if announced else end + dt.timedelta(days=40), consolidated, sales, eps, "x", missing, False, arrival)


def test_growth_and_repeats(spark, catalog):
    rows = spark.createDataFrame([filing("2023-06-30", 10.0, 1000.0), filing("2024-06-30", 12.0, 1200.0)], FILING)
    assert runs.fundamentals_update(catalog, rows, "2025-01-01", "arrival")["rows_added"] == 2
    assert runs.fundamentals_update(catalog, rows, "2025-01-01", "arrival")["rows_added"] == 0
    a, b = catalog.read("fundamentals_quarterly").orderBy("quarter_end").collect()
    assert a.eps_yoy_growth is None and (b.eps_yoy_growth, b.sales_yoy_growth) == (20.0, 20.0)
    assert runs.latest_fundamentals(catalog).first().quarter_end == dt.date(2024, 6, 30)


def test_growth_looks_at_stored_quarters(spark, catalog):
    runs.fundamentals_update(catalog, spark.createDataFrame([filing("2023-06-30", 10.0, 1000.0)], FILING), "2023-12-31", "arrival")
    runs.fundamentals_update(catalog, spark.createDataFrame([filing("2024-06-30", 15.0, 900.0)], FILING), "2025-01-01", "arrival")
    assert runs.latest_fundamentals(catalog).first().eps_yoy_growth == 50.0


def test_missing_fields_have_no_growth(spark, catalog):
    rows = spark.createDataFrame([filing("2023-06-30", None, None, missing=True), filing("2024-06-30", None, None, missing=True)], FILING)
    runs.fundamentals_update(catalog, rows, "2025-01-01", "arrival")
    assert all(r.eps_yoy_growth is None and r.fields_missing for r in catalog.read("fundamentals_quarterly").collect())


def test_late_filing_is_flagged(spark, catalog):
    runs.fundamentals_update(catalog, spark.createDataFrame([filing("2021-03-31", 1.0, 1.0, announced="2026-08-24")], FILING), "2026-12-31", "arrival")
    r = catalog.read("fundamentals_quarterly").first()
    assert (r.announcement_lag_days, r.is_backlog_filing) == (1972, True)


def test_consolidated_is_preferred_even_if_invalid(spark, catalog):
    rows = [filing("2023-06-30", 11.4, 100.0, consolidated=False, arrival=1), filing("2023-06-30", 24.48, 235.0, arrival=2)]
    rows += [filing("2023-09-30", 1.0, 1.0, consolidated=False, arrival=3), filing("2023-09-30", 2.0, 2.0, announced="2023-08-01", arrival=4)]
    r = runs.fundamentals_update(catalog, spark.createDataFrame(rows, FILING), "2025-01-01", "arrival")
    assert (r["rows_added"], r["symbols_failed"]) == (1, 1)
    assert catalog.read("fundamentals_quarterly").first().eps == 24.48


def test_nearest_quarter_wins_and_ties_take_the_later(spark):
    from barlens.operators import fundamentals

    day = dt.date(2024, 6, 30)
    rows = [("A", day - dt.timedelta(days=d), e, e, False) for d, e in ((370, 1.0), (360, 2.0), (330, 3.0), (0, 4.0))]
    r = fundamentals.with_growth(spark.createDataFrame(rows, "symbol string, quarter_end date, eps double, sales double, fields_missing boolean")).orderBy(F.desc("quarter_end")).first()
    assert r.eps_yoy_growth == 100.0


def test_older_tables_get_new_columns(spark, catalog):
    old = spark.createDataFrame([("A", dt.date(2024, 3, 31))], "symbol string, quarter_end date")
    old.write.parquet(f"{catalog.root}/fundamentals_quarterly/v=1/part=all")
    catalog._commit("fundamentals_quarterly", 1, {"replaced": ["*"], "held": ["all"]})
    assert catalog.read("fundamentals_quarterly").first().announcement_date_is_estimated is False


def test_bars_normalise(spark):
    from barlens.operators import bars as B

    rows = [("A", "2024-01-02", "1", "2", "1", "5", 1), ("A", "2024-01-02", "3", "3", "3", "6", 2), ("A", "2024-01-03", "x", "2", "1", "5", 1), ("A", "2024-01-04", "-1", "2", "1", "5", 1), ("A", "2024-01-05", "1", "2", "1", "-5", 1)]
    f = spark.createDataFrame(rows, "symbol string, date string, close string, high string, low string, volume string, seq int")
    assert [(r.date, r.close) for r in B.normalised(f, arrival="seq").collect()] == [("2024-01-02", 3.0)]


def test_adjusted_prices(spark):
    from barlens.operators import bars as B

    f = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0, 12.0, 8.0, 10.0, 5, 5.0), ("A", dt.date(2024, 1, 2), 1.0, 12.0, 8.0, 10.0, 5, 0.0)], BAR)
    assert [(r.close, r.high, r.low, r.volume) for r in B.adjusted(f).orderBy("date").collect()] == [(5.0, 6.0, 4.0, 5), (10.0, 12.0, 8.0, 5)]
