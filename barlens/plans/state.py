"""What a user keeps beside the market's tables: lists of symbols to watch, and filters of the screener."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.catalog import Catalog


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def _rows(catalog: Catalog, table: str, rows: list[tuple]) -> DataFrame:
    return catalog.spark.createDataFrame(rows, Catalog.schema(table))


def add_symbols(catalog: Catalog, name: str, symbols: Iterable[str]) -> None:
    """Adds symbols to a list, which is made where there is none of that name; those it has keep their time."""
    at = _now()
    catalog.insert("watchlists", _rows(catalog, "watchlists", [(name, at)]))
    catalog.insert("watchlist_symbols", _rows(catalog, "watchlist_symbols", [(name, s, at) for s in sorted({s.strip().upper() for s in symbols})]))


def remove_symbols(catalog: Catalog, name: str, symbols: Iterable[str]) -> None:
    gone = (F.col("watchlist") == name) & F.col("symbol").isin([s.strip().upper() for s in symbols])
    catalog.write("watchlist_symbols", catalog.read("watchlist_symbols").filter(~gone))


def drop_watchlist(catalog: Catalog, name: str) -> None:
    """Drops a list with its symbols."""
    catalog.write("watchlist_symbols", catalog.read("watchlist_symbols").filter(F.col("watchlist") != name))
    catalog.write("watchlists", catalog.read("watchlists").filter(F.col("name") != name))


def watchlist(catalog: Catalog, name: str | None = None) -> DataFrame:
    """The symbols of one list or of all, in order."""
    rows = catalog.read("watchlist_symbols")
    return (rows if name is None else rows.filter(F.col("watchlist") == name)).orderBy("watchlist", "symbol")


def save_preset(catalog: Catalog, name: str, filters: dict) -> None:
    """Keeps filters under a name; those it had before are replaced."""
    catalog.upsert("screener_presets", _rows(catalog, "screener_presets", [(name, json.dumps(filters, sort_keys=True), _now())]))


def presets(catalog: Catalog) -> DataFrame:
    return catalog.read("screener_presets").orderBy("name")
