"""Providers by name, and one that fetches candles on the executors."""

from __future__ import annotations

import base64
import importlib
import math
import pickle
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.config import Provider, Settings, get_settings
from barlens.schema import INSTRUMENT
from barlens.sources.candles import BarProvider, with_retries

CANDLES = "symbol string, date string, open double, high double, low double, close double, volume bigint"

_makers: dict[str, Callable[[SparkSession, Settings], BarProvider]] = {}


def register(name: str, make: Callable[[SparkSession, Settings], BarProvider]) -> None:
    """Makes a provider known under a name, such as that of Settings.data_provider."""
    _makers[name] = make


def selected(spark: SparkSession, settings: Settings | None = None) -> BarProvider:
    """The provider that the settings name; raises if there is none of that name, or it lacks its credentials."""
    s = settings or get_settings()
    if s.data_provider not in _makers:
        raise ValueError(f"no provider {s.data_provider}; known: {', '.join(sorted(_makers)) or 'none'}")
    if not s.provider_configured:
        raise ValueError(f"provider {s.data_provider} has no credentials")
    return _makers[s.data_provider](spark, s)


def page_or_none(get: Callable[[str], tuple[int, str]], url: str, attempts: int = Provider.max_retries, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The text of an address: None where it is not found or no attempt succeeds. get gives a status and a text."""
    for attempt in range(attempts):
        if attempt:
            sleep(delay)
        try:
            status, text = get(url)
        except OSError:
            continue
        if status == 404:
            return None
        if status < 400:
            return text
    return None


def packed(fetch: Callable) -> str:
    """A function as text, so that executors need no module of the caller."""
    return "pickle:" + base64.b64encode(cloudpickle.dumps(fetch)).decode()


def _function(text: str) -> Callable:
    kind, _, rest = text.partition(":")
    return pickle.loads(base64.b64decode(rest)) if kind == "pickle" else getattr(importlib.import_module(kind), rest)


def next_slot(now: float, lane: int, lanes: int, delay: float, after: int = -1) -> int:
    """The number of a lane's next slot of time, from now on and after the one it had last. Slots are delay seconds long and
    counted by the clock; each belongs to one lane, so that all lanes together call once in a slot at most."""
    n = max(math.ceil(now / delay), after + 1)
    return n + (lane - n) % lanes


class FetchedProvider:
    """A provider over a function (module:function, or what packed() gives) of symbol, start and end, giving rows."""

    def __init__(self, spark: SparkSession, name: str, fetch: str | Callable, instruments: DataFrame | None = None, delay: float = Provider.request_delay_seconds, attempts: int = Provider.max_retries, at_once: int = 8):
        self.spark, self.name, self.instruments, self.delay, self.attempts, self.at_once = spark, name, instruments, delay, attempts, at_once
        self.fetch = fetch if isinstance(fetch, str) else packed(fetch)

    def list_instruments(self, exchange: str) -> DataFrame:
        if self.instruments is None:
            return self.spark.createDataFrame([], INSTRUMENT)
        return self.instruments.filter(F.col("exchange") == exchange)

    def fetch_daily(self, requests: DataFrame) -> DataFrame:
        """The candles of (symbol, from_date, to_date), fetched where the requests are, with retries and paced: requests are
        dealt to at_once lanes, a task each, and a call, first or repeated, waits for a slot of its lane. So all tasks together
        make one call in delay seconds at most, on executors whose clocks agree. A task that is lost asks again for its own
        requests, in its lane."""
        packed_fetch, attempts, delay, lanes = self.fetch, self.attempts, self.delay, self.at_once

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fetch, slot = _function(packed_fetch), -1

            def call(symbol, start, end, lane) -> list:
                nonlocal slot
                if delay:
                    slot = next_slot(time.time(), lane, lanes, delay, slot)
                    time.sleep(max(0.0, slot * delay - time.time()))
                return list(fetch(symbol, start, end))

            for batch in batches:
                for request in batch.itertuples(index=False):
                    rows = with_retries(lambda: call(*request), attempts, delay)  # noqa: B023
                    if rows:
                        made = {c: [float(r[c]) for r in rows] for c in ("open", "high", "low", "close")}
                        yield pd.DataFrame({"symbol": request.symbol, "date": [str(r["date"]) for r in rows], **made, "volume": [int(r["volume"]) for r in rows]})

        lane = F.pmod(F.xxhash64("symbol", "from_date"), F.lit(lanes)).cast("int")
        spans = requests.select("symbol", "from_date", "to_date", lane.alias("lane")).repartitionById(lanes, F.col("lane"))
        return spans.mapInPandas(run, CANDLES)
