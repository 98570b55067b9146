"""Daily candles: what to ask a provider for, how to ask, and what its rows become."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.config import Provider

T = TypeVar("T")


class BarProvider(Protocol):
    """A source of instruments and bars; both are DataFrames, so that a provider can read files or a data source."""

    name: str

    def list_instruments(self, exchange: str) -> DataFrame:
        """Rows of barlens.schema.INSTRUMENT."""

    def fetch_daily(self, requests: DataFrame) -> DataFrame:
        """Bars for rows of (symbol, from_date, to_date)."""


def chunks(requests: DataFrame, most_days: int = Provider.max_historical_days) -> DataFrame:
    """(symbol, from_date, to_date) cut into spans of at most most_days days; a request that ends before it
    begins has none."""
    starts = F.when(F.col("to_date") >= F.col("from_date"), F.sequence(F.col("from_date"), F.col("to_date"), F.make_dt_interval(F.lit(most_days))))
    cut = requests.select("symbol", "to_date", F.explode(starts).alias("from_date"))
    return cut.select("symbol", "from_date", F.least(F.col("to_date"), F.date_add("from_date", most_days - 1)).alias("to_date"))


def checked_span(start: str, end: str) -> None:
    """ISO dates; raises if the span ends before it begins."""
    if end < start:
        raise ValueError("the end date must not be before the start date")


def with_retries(fetch: Callable[[], T], attempts: int = Provider.max_retries, delay: float = Provider.request_delay_seconds, sleep: Callable[[float], None] = time.sleep, errors: Iterable[type[Exception]] = (OSError,)) -> T:
    """The result of fetch; after an error the wait doubles, and the last error is raised."""
    for attempt in range(attempts):
        try:
            return fetch()
        except tuple(errors):
            if attempt + 1 == attempts:
                raise
            sleep(delay * 2**attempt)
    raise ValueError("attempts must be positive")


def normalised(raw: DataFrame) -> DataFrame:
    """Bars of provider rows: a date from a timestamp or the first ten characters of text, numbers cast."""
    date = F.col("date").cast("date") if dict(raw.dtypes)["date"] in ("date", "timestamp", "timestamp_ntz") else F.to_date(F.substring("date", 1, 10))
    have = set(raw.columns)
    return raw.select(
        "symbol", date.alias("date"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), F.col("volume").cast("bigint").alias("volume"),
        *((F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in ("delivery_pct", "adj_close")),
    )


def archive(bars: DataFrame, path: str, run_id: str) -> None:
    """The rows as received, as JSON by run and symbol."""
    bars.withColumns({"run_id": F.lit(run_id), "by_symbol": F.col("symbol")}).write.mode("append").partitionBy("run_id", "by_symbol").json(path)
