"""The HTTP surface over a catalog: health, settings, the universe, scores, single symbols, runs, lists and presets.

Without a catalog the lists are empty. Lists are given page by page (offset, and limit up to PAGE_ROWS).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.catalog import Catalog
from barlens.config import Settings, get_settings
from barlens.operators import bars as B
from barlens.plans import runs, state

PAGE_ROWS = 500
Query = dict[str, str]
NOT_FOUND, NOT_ALLOWED = (404, {"detail": "Not Found"}), (405, {"detail": "Method Not Allowed"})


def _rows(frame: DataFrame, query: Query, default: int = PAGE_ROWS) -> list[dict]:
    """A page of an ordered frame."""
    start, most = int(query.get("offset", 0)), int(query.get("limit", default))
    if start < 0 or most < 0:
        raise ValueError("offset and limit must not be negative")
    page = frame.offset(start).limit(min(most, PAGE_ROWS)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    return [json.loads(row[0]) for row in page.collect()]


def _one(frame: DataFrame) -> dict | None:
    return next(iter(_rows(frame, {"limit": "1"})), None)


def _universe(catalog: Catalog, query: Query) -> list[dict]:
    return _rows(catalog.read("universe").orderBy("symbol"), query)


def _scores(catalog: Catalog, query: Query) -> list[dict]:
    """Scores of the latest date as ranked; min_score, min_rating, sector and gate_passed narrow them."""
    rows = B.latest_date(catalog.read("scores_daily")).join(catalog.read("universe").select("symbol", "sector", "industry"), "symbol", "left")
    if "min_score" in query:
        rows = rows.filter(F.col("composite_score") >= float(query["min_score"]))
    if "min_rating" in query:
        rows = rows.filter(F.col("relative_strength_rating") >= int(query["min_rating"]))
    if "sector" in query:
        rows = rows.filter(F.col("sector") == query["sector"])
    if "gate_passed" in query:
        rows = rows.filter(F.col("gate_passed") == (query["gate_passed"].lower() == "true"))
    return _rows(rows.orderBy(F.desc("gate_passed"), F.desc("composite_score"), "symbol"), query)


def _stock(catalog: Catalog, symbol: str, query: Query) -> dict | None:
    """One symbol's latest bars, explained template, stage, pattern, volume signals, and its ratings and scores; None for a
    symbol without bars."""
    def history(table: str, default: int = PAGE_ROWS) -> list[dict]:
        return _rows(catalog.read(table).filter(F.col("symbol") == symbol).orderBy(F.desc("date")), query, default)

    if not (bars := history("ohlcv_daily", 250)):
        return None
    return {
        "symbol": symbol, "bars": bars, "template": _one(runs.symbol_template(catalog, symbol)), "stage": next(iter(history("market_stages_daily")), None),
        "pattern": _one(runs.symbol_pattern(catalog, symbol)), "volume": _one(runs.symbol_volume(catalog, symbol)), "ratings": history("rs_ratings_daily"), "scores": history("scores_daily"),
    }


def _setups(catalog: Catalog, symbol: str, query: Query) -> list[dict]:
    """The patterns that were found in a symbol, the latest first."""
    return _rows(catalog.read("vcp_results_weekly").filter((F.col("symbol") == symbol) & F.col("is_vcp")).orderBy(F.desc("date")), query)


def _status(catalog: Catalog) -> dict:
    """The last run of the log, and the date of the latest bar."""
    latest = catalog.read("ohlcv_daily").agg(F.max("date")).first()[0]
    return {"last_run": _one(catalog.read("ingestion_log").orderBy(F.desc("run_at"))), "latest_bar": latest and str(latest)}


def _presets(catalog: Catalog, query: Query) -> list[dict]:
    return [{"name": r["name"], "filters": json.loads(r["filters_json"])} for r in _rows(state.presets(catalog), query)]


def _get(path: list[str], query: Query, settings: Settings, catalog: Catalog | None) -> tuple[int, Any]:
    match path:
        case ["health"]:
            return 200, {"status": "ok"}
        case ["settings", "provider"]:
            return 200, {"provider": settings.data_provider, "configured": settings.provider_configured}
        case ["universe"]:
            return 200, _universe(catalog, query) if catalog else []
        case ["scores", "today"]:
            return 200, _scores(catalog, query) if catalog else []
        case ["watchlist"]:
            return 200, _rows(state.watchlist(catalog, query.get("name")), query) if catalog else []
        case ["screener", "presets"]:
            return 200, _presets(catalog, query) if catalog else []
        case ["ingestion", "status"] if catalog:
            return 200, _status(catalog)
        case ["stock", symbol] if catalog and (found := _stock(catalog, symbol.upper(), query)):
            return 200, found
        case ["stock", symbol, "vcp-setups"] if catalog:
            return 200, _setups(catalog, symbol.upper(), query)
    return NOT_FOUND


def _post(path: list[str], body: Any, catalog: Catalog | None, ingest: Callable[[], Any] | None) -> tuple[int, Any]:
    if path not in (["ingest", "run"], ["watchlist"], ["screener", "presets"]):
        return NOT_ALLOWED
    if path == ["ingest", "run"]:
        return (200, ingest()) if ingest else (503, {"detail": "no run is set up"})
    if catalog is None:
        return 503, {"detail": "no catalog is set up"}
    name, kind = (body.get("name"), dict if path[0] == "screener" else list) if isinstance(body, dict) else (None, list)
    content = body.get("filters" if kind is dict else "symbols") if name else None
    if not isinstance(name, str) or not isinstance(content, kind) or (kind is list and not all(isinstance(s, str) for s in content)):
        raise ValueError("name and " + ("filters" if path[0] == "screener" else "symbols") + " are needed")
    if kind is dict:
        state.save_preset(catalog, name, content)
    else:
        state.add_symbols(catalog, name, content)
    return 200, {"name": name}


def respond(
    address: str, settings: Settings | None = None, catalog: Catalog | None = None, *, method: str = "GET", body: Any = None, ingest: Callable[[], Any] | None = None
) -> tuple[int, Any]:
    """Status and body of a request; 422 for parameters that don't parse. ingest is what POST /ingest/run calls."""
    split = urlsplit(address)
    path, query = [unquote(p) for p in split.path.split("/") if p], dict(parse_qsl(split.query))
    try:
        return _post(path, body, catalog, ingest) if method == "POST" else _get(path, query, settings or get_settings(), catalog)
    except ValueError as e:
        return 422, {"detail": str(e)}


class Handler(BaseHTTPRequestHandler):
    def __init__(self, *args, catalog: Catalog | None = None, ingest: Callable[[], Any] | None = None, **kw):
        self.catalog, self.ingest = catalog, ingest
        super().__init__(*args, **kw)

    def _answer(self, method: str, body: Any = None) -> None:
        status, found = respond(self.path, None, self.catalog, method=method, body=body, ingest=self.ingest)
        data = json.dumps(found, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self) -> None:
        self._answer("GET")

    def do_POST(self) -> None:
        try:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")
        except ValueError:
            body = None
        self._answer("POST", body)


def serve(port: int = 8000, catalog: Catalog | None = None, ingest: Callable[[], Any] | None = None) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), partial(Handler, catalog=catalog, ingest=ingest))
