"""Batch runs over a catalog of stored tables. Each reads tables, makes one lazy plan and writes the result by key."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from barlens.catalog import Catalog, upserted
from barlens.config import PERIODS, Contraction, Fundamentals, Score, Stage, Strength, Trend, Volume
from barlens.operators import bars as B
from barlens.operators import actions, contraction, fundamentals, quality, score, stage, strength, trend, universe, volume
from barlens.sources import candles

FIRST_DATE = "2018-01-01"


def _now():
    return F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")


def _log(catalog: Catalog, run_id: str, updated: int, failed: int, added: int, notes: str, failures: DataFrame | None = None) -> dict[str, Any]:
    """failures (symbol, note) are all put into the notes, by symbol; Spark joins them, so that they don't pass through the driver."""
    row = Row(run_id=run_id, run_at=datetime.now(UTC).replace(tzinfo=None), symbols_updated=updated, symbols_failed=failed, rows_added=added, notes=notes)
    logged = catalog.spark.createDataFrame([row], Catalog.schema("ingestion_log"))
    if failures is not None:
        lines = failures.agg(F.array_sort(F.collect_list(F.concat_ws(": ", "symbol", "note"))).alias("_lines"))
        logged = logged.crossJoin(lines).withColumn("notes", F.array_join(F.concat(F.array("notes"), "_lines"), "; "))
    catalog.append("ingestion_log", logged)
    return {"run_id": run_id, "symbols_updated": updated, "symbols_failed": failed, "rows_added": added}


def _counted(frame: DataFrame, **tests) -> dict[str, int]:
    """Several counts of a frame in one pass."""
    row = frame.agg(*(F.coalesce(F.sum(F.when(t, 1).otherwise(0)), F.lit(0)).alias(k) for k, t in tests.items())).first()
    return row.asDict()


def daily_update(catalog: Catalog, provider: candles.BarProvider, end_date: str, symbols: list[str] | None = None, initial: str = FIRST_DATE, archive: str | None = None) -> dict[str, Any]:
    """Bars of the dates that are missing, for all active symbols or some. All of a symbol's bars are rejected
    in this run if one is invalid; that is counted and noted. Weeks of what was touched are derived anew."""
    run_id = str(uuid.uuid4())
    mapped = catalog.read("provider_instruments").filter(F.col("provider") == provider.name)
    wanted = B.active_only(mapped.select("symbol").distinct(), catalog.read("universe"))
    if symbols is not None:
        wanted = wanted.filter(F.col("symbol").isin(symbols))
    stored = catalog.read("ohlcv_daily")
    requests = B.delta_start(wanted, stored, initial).withColumn("to_date", F.lit(end_date).cast("date")).filter("from_date <= to_date")
    with catalog.staged(candles.normalised(provider.fetch_daily(candles.chunks(requests)))) as received:
        accepted, notes = B.split_valid(received)
        if archive:
            candles.archive(accepted, archive, run_id)
        staged = B.with_adjusted_close(accepted).withColumns({"source": F.lit(provider.name), "ingested_at": _now()})
        counts = staged.agg(F.count(F.lit(1)), F.count_distinct("symbol")).first()
        failed = notes.count()
        touched = staged.select("symbol").distinct() if symbols is None else catalog.spark.createDataFrame([(s,) for s in sorted(set(symbols))], "symbol string")
        if counts[0]:
            catalog.upsert("ohlcv_daily", staged, mostly_new=True)
        resample(catalog, touched)
        return _log(catalog, run_id, counts[1], failed, counts[0], "controlled incremental update", notes)


def resample(catalog: Catalog, touched: DataFrame) -> None:
    """Derives the weeks of some symbols anew and replaces theirs."""
    daily = catalog.read("ohlcv_daily").join(touched.select("symbol"), "symbol", "left_semi")
    catalog.replace("ohlcv_weekly", B.weekly(daily))


def _pending(catalog: Catalog, provider: candles.BarProvider) -> DataFrame:
    """(symbol): those that lack bars."""
    return universe.pending_backfill(catalog.read("universe"), catalog.read("provider_instruments").filter(F.col("provider") == provider.name), catalog.read("ohlcv_daily")).select("symbol")


def record_actions(catalog: Catalog, found: DataFrame) -> dict[str, int]:
    """Stores corporate actions that are new, and adjusts all bars of the symbols they are of; only bars whose
    adjusted close changes are written, and their weeks derived anew. Recording them again changes nothing."""
    columns = list(Catalog.schema("corporate_actions").names)
    stored = catalog.read("corporate_actions")
    same = [stored[c].eqNullSafe(F.col(f"_new.{c}")) for c in columns]
    new = found.select(*columns).distinct().alias("_new").join(stored, same, "left_anti")
    with catalog.staged(new) as rows:
        if not (n := rows.count()):
            return {"actions": 0, "bars_adjusted": 0}
        catalog.append("corporate_actions", rows)
        touched = rows.select("symbol").distinct()
        bars = catalog.read("ohlcv_daily").join(touched, "symbol", "left_semi")
        whole = actions.retro_adjusted(bars.withColumn("_was", F.col("adj_close")), catalog.read("corporate_actions").join(touched, "symbol", "left_semi"))
        with catalog.staged(whole.filter(~F.col("_was").eqNullSafe(F.col("adj_close"))).drop("_was")) as changed:
            if m := changed.count():
                catalog.upsert("ohlcv_daily", changed)
                resample(catalog, changed.select("symbol").distinct())
    return {"actions": n, "bars_adjusted": m}


def backfill_batch(catalog: Catalog, provider: candles.BarProvider, end_date: str, batch_size: int = 25) -> dict[str, Any]:
    """An update of the first symbols that lack bars, in alphabetical order."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    batch = [r.symbol for r in _pending(catalog, provider).orderBy("symbol").limit(batch_size).collect()]
    if not batch:
        return {"batch": [], "rows_added": 0, "symbols_failed": 0}
    return {"batch": batch} | daily_update(catalog, provider, end_date, batch)


def backfill_all(catalog: Catalog, provider: candles.BarProvider, end_date: str, batch_size: int = 25) -> list[dict[str, Any]]:
    """Batches until none is pending; stops after a batch that failed or added nothing. The list of what is pending is
    taken once, not for each batch, and again when it is through, for symbols that a provider sent nothing of."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    done: list[dict[str, Any]] = []
    while True:
        with catalog.staged(_pending(catalog, provider).withColumn("place", F.row_number().over(Window.orderBy("symbol")))) as pending:
            n = pending.count()
            for first in range(1, n + 1, batch_size):
                batch = sorted(r.symbol for r in pending.filter(F.col("place").between(first, first + batch_size - 1)).collect())
                done.append({"batch": batch} | daily_update(catalog, provider, end_date, batch))
                if done[-1]["symbols_failed"] or not done[-1]["rows_added"]:
                    return done
            if not n:
                return done


def sync_instruments(catalog: Catalog, provider: candles.BarProvider, exchange: str = "NSE") -> int:
    """Upserts a provider's cash equities and adds new symbols to the universe, not active."""
    rows = universe.cash_equities(provider.list_instruments(exchange), exchange).withColumns({"provider": F.lit(provider.name), "refreshed_at": _now()})
    if not (n := rows.count()):
        return 0
    catalog.upsert("provider_instruments", rows)
    catalog.write("universe", universe.merged_universe(catalog.read("universe"), rows))
    return n


def apply_universe(catalog: Catalog, name: str, symbols: DataFrame, as_of: str, source_url: str | None = None) -> dict[str, Any]:
    """Makes the given symbols the active ones and keeps the snapshot, once for each name and date."""
    catalog.write("universe", universe.active_exactly(catalog.read("universe"), symbols))
    snapshot = symbols.select(F.lit(name).alias("universe_name"), "symbol", F.lit(as_of).cast("date").alias("as_of_date"), F.lit(source_url).alias("source_url"), _now().alias("retrieved_at")).distinct()
    catalog.insert("universe_memberships", snapshot)
    return {"universe": name, "active_symbols": catalog.read("universe").filter("is_active").count()}


def sync_listing_dates(catalog: Catalog, staged: DataFrame) -> dict[str, int]:
    synced = universe.with_listing_dates(catalog.read("universe"), staged)
    summary = universe.listing_summary(synced).first().asDict()
    catalog.write("universe", synced)
    return summary


def _adjusted(catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    names = catalog.read("universe")
    return B.adjusted(catalog.read("ohlcv_daily"), names), B.adjusted(catalog.read("ohlcv_weekly"), names, on="week_end_date")


def run_stages(catalog: Catalog, config: Stage = Stage()) -> dict[str, int]:
    daily, _ = _adjusted(catalog)
    with catalog.staged(stage.classify(trend.template(trend.latest(daily, PERIODS["daily"])), config)) as rows:
        catalog.upsert("market_stages_daily", rows)
        return {"symbols_classified": rows.count()}


def _mark(catalog: Catalog, run: str) -> dict[str, Any]:
    row = catalog.read("run_marks").filter(F.col("run") == run).first()
    return json.loads(row.mark) if row else {}


def _since(catalog: Catalog, run: str, state: tuple[str, ...], config: Any) -> tuple[DataFrame | None, dict[str, Any]]:
    """(bars that were added since a run wrote its state, what to mark the next state with). None instead of bars
    where the state can't be carried on: it isn't there or not whole, the settings or the active symbols are others,
    stored bars were replaced, or bars came of dates that it covers."""
    active = catalog.read("universe").filter("is_active").select("symbol").distinct()
    drawn = active.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("symbol")), F.sum(F.xxhash64(F.reverse("symbol")).cast("decimal(38,0)"))).first()
    mark = {"settings": repr(config), "active": [str(x) for x in drawn], "bars": catalog.newest("ohlcv_daily")}
    old = _mark(catalog, run)
    if any(old.get(k) != mark[k] for k in ("settings", "active")) or old.get("state") != [catalog.newest(t) for t in state]:
        return None, mark
    added = catalog.added("ohlcv_daily", old["bars"])
    mark["as_of"] = old.get("as_of")
    if added is None or mark["as_of"] is not None and not added.filter(F.col("date") <= F.lit(mark["as_of"]).cast("date")).isEmpty():
        return None, mark
    return added, mark


def _marked(catalog: Catalog, run: str, state: tuple[str, ...], mark: dict[str, Any]) -> None:
    """Written last: a state without its mark, where a run failed half way, isn't used."""
    as_of = catalog.read("ohlcv_daily").agg(F.max("date")).first()[0]
    mark |= {"state": [catalog.newest(t) for t in state], "as_of": as_of and as_of.isoformat()}
    catalog.upsert("run_marks", catalog.spark.createDataFrame([(run, json.dumps(mark))], "run string, mark string"))


_STRENGTH, _VOLUME = ("strength_calendar", "strength_symbols"), ("volume_symbols",)


def run_strength(catalog: Catalog, config: Strength = Strength()) -> dict[str, int]:
    """Ratings of all sessions, or of the new ones alone where they only add to what the last run has seen: then the
    new bars and the carried state are read, a row per symbol with its last 252 sessions."""
    added, mark = _since(catalog, "strength", _STRENGTH, config)
    bars = B.adjusted(catalog.read("ohlcv_daily") if added is None else added, catalog.read("universe"))
    carried = None
    if added is not None:
        last = catalog.read("strength_calendar").orderBy(F.desc("session")).limit(1)
        carried = None if last.isEmpty() else strength.Carried(catalog.read("strength_symbols"), last)
    with catalog.staged(strength.lines(bars, config, carried)) as lined:
        if added is None or not lined.isEmpty():
            catalog.upsert("rs_ratings_daily", strength.rated(lined))
            calendar = lined.groupBy("date", "session").agg(F.first("benchmark").alias("benchmark"), F.first("known").alias("known"))
            state = strength.carry(lined, config, carried)
            catalog.write("strength_symbols", state.symbols)
            catalog.upsert("strength_calendar", calendar) if carried else catalog.write("strength_calendar", calendar)
    _marked(catalog, "strength", _STRENGTH, mark)
    row = catalog.read("rs_ratings_daily").agg(F.count(F.lit(1)).alias("rows_persisted"), F.count_distinct("symbol").alias("symbols_rated")).first()
    return row.asDict()


def run_patterns(catalog: Catalog, config: Contraction = Contraction()) -> dict[str, int]:
    daily, weekly = _adjusted(catalog)
    with catalog.staged(contraction.detect(weekly, daily, config)) as rows:
        catalog.upsert("vcp_results_weekly", rows)
        return _counted(rows, symbols_evaluated=F.lit(True), symbols_flagged_vcp=F.col("is_vcp"))


def run_volume(catalog: Catalog, config: Volume = Volume()) -> dict[str, int]:
    """Signals at the last bar of each symbol, from the bars that are new and the last ones before them."""
    added, mark = _since(catalog, "volume", _VOLUME, config)
    bars = B.adjusted(catalog.read("ohlcv_daily") if added is None else added, catalog.read("universe"))
    carried = None if added is None else catalog.read("volume_symbols")
    pivots = B.latest_date(catalog.read("vcp_results_weekly")).select("symbol", "pivot_price")
    with catalog.staged(volume.carry(bars, config, carried)) as state:
        # the carried bars are all that the signals look at
        nothing = bars.limit(0)
        with catalog.staged(volume.signals(nothing, pivots, config, state)) as rows:
            catalog.upsert("volume_signals_daily", rows)
            catalog.write("volume_symbols", state)
            _marked(catalog, "volume", _VOLUME, mark)
            return _counted(rows, symbols_evaluated=F.lit(True), symbols_with_pivot_spike=F.col("volume_spike_near_pivot"))


def scores(catalog: Catalog, as_of: str = "global", config: Score = Score(), trend_config: Trend = Trend()) -> DataFrame:
    """Scores of all active symbols from the stored parts. as_of per_symbol takes each symbol's latest parts."""
    daily, weekly = _adjusted(catalog)
    ratings = catalog.read("rs_ratings_daily")
    d = trend.template(trend.latest(daily, PERIODS["daily"]), trend_config, ratings)
    w = trend.template(trend.latest(weekly, PERIODS["weekly"]), trend_config, ratings)
    rows = score.assemble(d, w, catalog.read("market_stages_daily"), ratings, catalog.read("vcp_results_weekly"), catalog.read("volume_signals_daily"), as_of)
    return score.combine(score.components(rows, config), config)


def run_scoring(catalog: Catalog, config: Score = Score()) -> dict[str, int]:
    with catalog.staged(scores(catalog, config=config)) as rows:
        catalog.upsert("scores_daily", rows)
        return _counted(rows, symbols_evaluated=F.lit(True), symbols_gate_passed=F.col("gate_passed"))


def fundamentals_update(catalog: Catalog, filings: DataFrame, end_date: str, arrival: str, config: Fundamentals = Fundamentals()) -> dict[str, Any]:
    """Stores filings announced after what is stored and up to end_date; growth is computed afresh over the
    full history of the touched symbols, and only years in which that changes anything are written. The preferred filing
    is chosen before validity is looked at. All filings are kept as they were announced, too."""
    run_id = str(uuid.uuid4())
    existing = catalog.read("fundamentals_quarterly")
    with catalog.staged(fundamentals.due(filings, existing, FIRST_DATE, end_date)) as arrived:
        chosen = fundamentals.preferred(arrived, arrival)
        rejected = chosen.filter(fundamentals.rejection_reason().isNotNull()).count()
        staged = fundamentals.stored(chosen, config).withColumn("ingested_at", _now())
        added, updated = staged.agg(F.count(F.lit(1)), F.count_distinct("symbol")).first()
        if added:
            growth = ("eps_yoy_growth", "sales_yoy_growth")
            with catalog.staged(staged) as new:
                whole = upserted(existing.drop(*growth), new, ("symbol", "quarter_end"))
                fresh = fundamentals.with_growth(whole.join(new.select("symbol").distinct(), "symbol", "left_semi"))
                with catalog.staged(fresh) as rows:
                    catalog.replace("fundamentals_quarterly", rows)
        catalog.insert("fundamentals_announced", arrived.filter("announcement_date is not null").withColumn("arrival", F.col(arrival).cast("long")))
    return _log(catalog, run_id, updated, rejected, added, "fundamentals update")


def run_quality(catalog: Catalog, path: str | None = None) -> dict[str, Any]:
    """The totals of the audit of all stored bars. With a path, they are written to its folder totals as JSON,
    and the symbols with missing sessions to its folder missing_dates, one in a row."""
    daily, names = catalog.read("ohlcv_daily"), catalog.read("universe")
    lists = quality.missing_lists(daily, names)
    if path:
        lists.write.mode("overwrite").json(f"{path}/missing_dates")
        lists = catalog.spark.read.schema(lists.schema).json(f"{path}/missing_dates")
    totals = quality.report(daily, catalog.read("ohlcv_weekly"), names, lists)
    row = totals.select(F.to_json(F.struct("*"))).first()[0]
    if path:
        catalog.spark.createDataFrame([(row,)], "value string").write.mode("overwrite").text(f"{path}/totals")
    return json.loads(row)


def run_analytics(catalog: Catalog) -> dict[str, dict[str, int]]:
    """All analytic runs in the order that they need each other."""
    return {"stages": run_stages(catalog), "strength": run_strength(catalog), "patterns": run_patterns(catalog), "volume": run_volume(catalog), "scores": run_scoring(catalog)}


def daily_pipeline(catalog: Catalog, provider: candles.BarProvider, name: str, symbols: DataFrame, end_date: str) -> dict[str, Any]:
    """Instruments, the active universe, then bars."""
    sync_instruments(catalog, provider)
    return apply_universe(catalog, name, symbols, end_date) | daily_update(catalog, provider, end_date)


# What is read of the stored results, in the order that it is shown in.


def latest_ratings(catalog: Catalog) -> DataFrame:
    return B.latest_date(catalog.read("rs_ratings_daily")).orderBy(F.desc("rating"), "symbol")


def latest_patterns(catalog: Catalog) -> DataFrame:
    return B.latest_date(catalog.read("vcp_results_weekly")).orderBy(F.desc("is_vcp"), "symbol")


def latest_volumes(catalog: Catalog) -> DataFrame:
    return B.latest_date(catalog.read("volume_signals_daily")).orderBy("symbol")


def latest_scores(catalog: Catalog) -> DataFrame:
    return score.ranked(catalog.read("scores_daily"))


def latest_fundamentals(catalog: Catalog) -> DataFrame:
    return fundamentals.latest(catalog.read("fundamentals_quarterly"))


def fundamentals_as_of(catalog: Catalog, dates: DataFrame) -> DataFrame:
    """Rows of (symbol, date) with the fundamentals that had been announced by then."""
    wanted = dates.select("symbol").distinct()
    return fundamentals.as_of(dates, fundamentals.known(catalog.read("fundamentals_announced").join(wanted, "symbol", "left_semi"), "arrival"))


def symbol_template(catalog: Catalog, symbol: str, timeframe: str = "daily", config: Trend = Trend()) -> DataFrame:
    """The explained criteria of one symbol; the filter reaches the scan."""
    table, on = ("ohlcv_daily", "date") if timeframe == "daily" else ("ohlcv_weekly", "week_end_date")
    bars = B.adjusted(catalog.read(table).filter(F.col("symbol") == symbol), on=on)
    rows = trend.template(trend.latest(bars, config.of(timeframe)), config, catalog.read("rs_ratings_daily").filter(F.col("symbol") == symbol))
    return trend.explained(rows, config)


def symbol_pattern(catalog: Catalog, symbol: str, config: Contraction = Contraction()) -> DataFrame:
    """The pattern of one symbol, active or not, from adjusted prices as in the batch."""
    mine = F.col("symbol") == symbol
    return contraction.detect(B.adjusted(catalog.read("ohlcv_weekly").filter(mine), on="week_end_date"), B.adjusted(catalog.read("ohlcv_daily").filter(mine)), config)


def symbol_volume(catalog: Catalog, symbol: str, config: Volume = Volume()) -> DataFrame:
    """The volume signals of one symbol, near the last pivot that any of its patterns had."""
    mine = F.col("symbol") == symbol
    pivots = B.latest_per_symbol(catalog.read("vcp_results_weekly").filter(mine & F.col("pivot_price").isNotNull()).select("symbol", "date", "pivot_price"))
    return volume.signals(B.adjusted(catalog.read("ohlcv_daily").filter(mine)), pivots.select("symbol", "pivot_price"), config)


def symbol_score(catalog: Catalog, symbol: str, config: Score = Score(), trend_config: Trend = Trend()) -> DataFrame:
    """The score of one symbol from its own latest parts."""
    def of(table: str) -> DataFrame:
        return catalog.read(table).filter(F.col("symbol") == symbol)

    ratings = of("rs_ratings_daily")
    d = trend.template(trend.latest(B.adjusted(of("ohlcv_daily")), PERIODS["daily"]), trend_config, ratings)
    w = trend.template(trend.latest(B.adjusted(of("ohlcv_weekly"), on="week_end_date"), PERIODS["weekly"]), trend_config, ratings)
    rows = score.assemble(d, w, of("market_stages_daily"), ratings, of("vcp_results_weekly"), of("volume_signals_daily"), "per_symbol")
    return score.combine(score.components(rows, config), config)
