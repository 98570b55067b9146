import datetime as dt
import json

import pytest

from barlens.catalog import Catalog
from barlens.streaming import ingest


def test_stream_counts_each_bar_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def put(name, *rows):
        keys = ("symbol", "date", "open", "high", "low", "close", "volume", "adj_close", "seq")
        (source / name).write_text("\n".join(json.dumps(dict(zip(keys, r, strict=True))) for r in rows))

    catalog = Catalog(spark, f"file://{tmp_path}/store")

    def run():
        q = ingest.into_catalog(ingest.bars_stream(spark, f"file://{source}"), catalog, f"file://{tmp_path}/cp")
        q.awaitTermination(120)

    put("a.json", ("A", "2024-01-02", 1, 2, 1, 2, 10, None, 1), ("A", "2024-01-02", 1, 3, 1, 3, 20, None, 2), ("B", "2024-01-02", 1, 0.5, 1, 2, 10, None, 1))
    run()
    assert [(r.symbol, r.close, r.adj_close) for r in catalog.read("ohlcv_daily").collect()] == [("A", 3.0, 3.0)]
    put("b.json", ("A", "2024-01-03", 3, 4, 3, 4, 5, None, 1), ("A", "2024-01-02", 1, 3, 1, 2.5, 20, None, 3))
    run()
    run()
    w = catalog.read("ohlcv_weekly").collect()
    assert [(r.week_end_date, r.open, r.close, r.volume) for r in w] == [(dt.date(2024, 1, 5), 1.0, 4.0, 25)]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_order_of_batches_does_not_matter(spark, tmp_path, order):
    """Corrections that come before what they correct: the greatest seq of a bar stays, whatever the order."""
    keys = ("symbol", "date", "open", "high", "low", "close", "volume", "adj_close", "seq")
    files = [
        [("A", "2024-01-02", 1, 2, 1, 2, 10, None, 1), ("B", "2024-01-02", 1, 2, 1, 2, 10, None, 1)], [("A", "2024-01-02", 1, 3, 1, 3, 20, None, 2), ("A", "2023-12-29", 1, 3, 1, 3, 7, None, 5)],
        [("A", "2024-01-02", 1, 4, 1, 4, 30, None, 3), ("B", "2024-01-03", 1, 2, 1, 1.5, 10, None, 1)], [("A", "2023-12-29", 1, 9, 1, 9, 70, None, 4)],
    ]
    source = tmp_path / "in"
    source.mkdir()
    catalog = Catalog(spark, f"file://{tmp_path}/store")
    for n, k in enumerate(order):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(keys, r, strict=True))) for r in files[k]))
        ingest.into_catalog(ingest.bars_stream(spark, f"file://{source}"), catalog, f"file://{tmp_path}/cp").awaitTermination(120)
    got = sorted((r.symbol, str(r.date), r.close, r.volume) for r in catalog.read("ohlcv_daily").collect())
    assert got == [("A", "2023-12-29", 3.0, 7), ("A", "2024-01-02", 4.0, 30), ("B", "2024-01-02", 2.0, 10), ("B", "2024-01-03", 1.5, 10)]
    weeks = sorted((r.symbol, str(r.week_end_date), r.close, r.volume) for r in catalog.read("ohlcv_weekly").collect())
    assert weeks == [("A", "2023-12-29", 3.0, 7), ("A", "2024-01-05", 4.0, 30), ("B", "2024-01-05", 1.5, 20)]


def test_weekly_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"symbol": "A", "date": str(dt.date(2024, 1, 1) + dt.timedelta(days=i)), "open": 1.0 + i, "high": 9.0 + i, "low": 0.5, "close": 2.0 + i, "volume": i} for i in range(20)]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = ingest.weekly_stream(ingest.bars_stream(spark, f"file://{source}")).writeStream.outputMode("complete").format("memory").queryName("weeks").trigger(availableNow=True).start()
    q.awaitTermination(120)
    from pyspark.sql import functions as F

    from barlens.operators.bars import weekly

    batch = weekly(spark.read.schema(ingest.RAW).json(f"file://{source}").withColumn("date", F.to_date("date")))
    want = {(r.week_end_date, r.open, r.high, r.close, r.volume) for r in batch.collect()}
    assert {(r.week_end_date, r.open, r.high, r.close, r.volume) for r in spark.table("weeks").collect()} == want
