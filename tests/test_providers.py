import pytest

from barlens.catalog import Catalog
from barlens.config import load_settings
from barlens.plans import runs
from barlens.schema import INSTRUMENT
from barlens.sources import providers


def service():
    """A stand-in for a provider's service: candles of weekdays."""
    def fetch(symbol, start, end):
        import datetime as dt

        for n in range((end - start).days + 1):
            d = start + dt.timedelta(days=n)
            if d.weekday() < 5:
                yield {"date": f"{d}T00:00:00", "open": 10, "high": 12, "low": 9, "close": 11, "volume": 100}

    return fetch


def silence():
    def fetch(symbol, start, end):
        raise OSError("no answer")

    return fetch


@pytest.fixture
def instruments(spark):
    return spark.createDataFrame([("A", "1", "NSE", "EQ", "EQ", None, "a"), ("B", "2", "NSE", "EQ", "EQ", None, "b"), ("C", "3", "BSE", "EQ", "EQ", None, "c")], INSTRUMENT)


def test_candles_through_the_data_source(spark, instruments, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/store")
    p = providers.FetchedProvider(spark, "service", service(), instruments, delay=0)
    r = runs.daily_pipeline(catalog, p, "all", instruments.filter("exchange = 'NSE'").select("symbol"), "2018-01-10")
    assert r["symbols_updated"] == 2 and r["rows_added"] == 16 and r["active_symbols"] == 2
    assert runs.daily_update(catalog, p, "2018-01-12")["rows_added"] == 4
    assert catalog.read("ohlcv_weekly").filter("symbol = 'A'").count() == 2


def test_a_provider_that_does_not_answer(spark, instruments):
    from pyspark.sql import functions as F

    p = providers.FetchedProvider(spark, "service", silence(), instruments, delay=0, attempts=2)
    span = instruments.limit(1).select("symbol", F.lit("2024-01-01").cast("date").alias("from_date"), F.lit("2024-01-02").cast("date").alias("to_date"))
    with pytest.raises(Exception, match="no answer"):
        p.fetch_daily(span).collect()
    assert p.fetch_daily(span.limit(0)).isEmpty()


def test_all_tasks_together_keep_the_rate(spark, instruments, tmp_path):
    """Calls of four tasks, some of them repeated, fall into slots of time of which none has two."""
    folder, delay = str(tmp_path), 0.25

    def fetch(symbol, start, end):
        import os
        import time

        name = f"{folder}/{symbol}-{start}"
        with open(name, "a") as f:
            f.write(f"{time.time()}\n")
        if start.day % 5 == 0 and os.path.getsize(name) < 25:
            raise OSError("once")
        return [{"date": f"{start}T00:00:00", "open": 1, "high": 1, "low": 1, "close": 1, "volume": 1}]

    from pyspark.sql import functions as F

    p = providers.FetchedProvider(spark, "service", fetch, instruments, delay=delay, at_once=4)
    requests = spark.range(1, 21).select(F.lit("A").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("from_date")).withColumn("to_date", F.col("from_date"))
    assert p.fetch_daily(requests).count() == 20
    times = sorted(float(line) for f in tmp_path.iterdir() for line in f.read_text().split())
    slots = [int(t / delay) for t in times]
    assert len(slots) == 24 and len(set(slots)) == 24


def test_slots_of_lanes():
    taken, after = [], [-1] * 3
    for _ in range(5):
        for lane in (2, 0, 1):
            after[lane] = providers.next_slot(10.01, lane, 3, 0.5, after[lane])
            assert after[lane] % 3 == lane and after[lane] * 0.5 >= 10.01
            taken.append(after[lane])
    assert len(set(taken)) == 15 and sorted(taken) == list(range(21, 36))


def test_selected_provider(spark):
    settings = load_settings({"KITE__API_KEY": "k", "KITE__ACCESS_TOKEN": "t"}, None)
    with pytest.raises(ValueError, match="no provider"):
        providers.selected(spark, settings)
    providers.register("kite", lambda s, st: st.kite.api_key)
    assert providers.selected(spark, settings) == "k"
    with pytest.raises(ValueError, match="credentials"):
        providers.selected(spark, load_settings({}, None))


def test_pages():
    answers = [OSError(), (500, ""), (200, "text")]

    def get(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    waits = []
    assert providers.page_or_none(get, "u", 3, 1.0, waits.append) == "text" and waits == [1.0, 1.0]
    assert providers.page_or_none(lambda u: (404, ""), "u", 3, 1.0, waits.append) is None
    assert providers.page_or_none(lambda u: (500, ""), "u", 2, 1.0, waits.append) is None
