"""Schemas of the stored tables and of provider records, with the keys of their rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _struct(text: str) -> T.StructType:
    """Flat columns written as name and type; StructType.fromDDL would need a running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(","))])


@dataclass(frozen=True)
class Table:
    schema: T.StructType
    keys: tuple[str, ...]
    by_year: str | None = None  # the date whose year parts the stored table


_BARS = "open double, high double, low double, close double, volume bigint"

# Columns and keys of the stored tables.
TABLES: dict[str, Table] = {
    "ohlcv_daily": Table(_struct(f"symbol string, date date, {_BARS}, delivery_pct double, adj_close double, source string, ingested_at timestamp"), ("symbol", "date"), "date"),
    "ohlcv_weekly": Table(_struct(f"symbol string, week_end_date date, {_BARS}, adj_close double"), ("symbol", "week_end_date"), "week_end_date"),
    "corporate_actions": Table(_struct("symbol string, ex_date date, action_type string, ratio string"), ()),
    "universe": Table(_struct("symbol string, isin string, sector string, industry string, listing_date date, is_active boolean"), ("symbol",)),
    "fundamentals_quarterly": Table(
        _struct(
            "symbol string, quarter_end date, period_start date, announcement_date date, eps double, sales double, roe double, eps_yoy_growth double, sales_yoy_growth double, "
            "source string, fields_missing boolean, announcement_lag_days int, is_backlog_filing boolean, ingested_at timestamp, announcement_date_is_estimated boolean"
        ),
        ("symbol", "quarter_end"), "quarter_end",
    ),
    "ingestion_log": Table(_struct("run_id string, run_at timestamp, symbols_updated int, symbols_failed int, rows_added int, notes string"), ("run_id",)),
    "rs_ratings_daily": Table(_struct("symbol string, date date, composite_return double, rating int, rs_line double, rs_line_new_high boolean, universe_size int"), ("symbol", "date"), "date"),
    "market_stages_daily": Table(
        _struct("symbol string, date date, stage int, price double, ma_short double, ma_medium double, ma_long double, ma_long_slope double, trend_template_passes int"), ("symbol", "date")
    ),
    "provider_instruments": Table(
        _struct("provider string, symbol string, exchange string, provider_instrument_id string, segment string, instrument_type string, isin string, name string, refreshed_at timestamp"),
        ("provider", "symbol", "exchange"),
    ),
    "vcp_results_weekly": Table(
        _struct(
            "symbol string, date date, is_vcp boolean, quality_grade string, reason string, pivot_price double, pivot_date date, contraction_count int, base_length_weeks int, "
            "depth_decay_passed boolean, volume_decay_passed boolean, base_length_passed boolean, daily_confirmation_available boolean, near_pivot boolean, "
            "distance_to_pivot_fraction double, tight_close_count int, tight_closes_confirmed boolean, breakout_confirmed boolean, contractions_json string, swings_json string"
        ),
        ("symbol", "date"),
    ),
    "universe_memberships": Table(_struct("universe_name string, symbol string, as_of_date date, source_url string, retrieved_at timestamp"), ("universe_name", "symbol", "as_of_date")),
    "volume_signals_daily": Table(
        _struct(
            "symbol string, date date, up_down_volume_ratio double, up_volume double, down_volume double, accumulation_distribution_value double, accumulation_distribution_rising boolean, "
            "pivot_price_used double, volume_spike_near_pivot boolean, spike_date date, spike_volume double"
        ),
        ("symbol", "date"),
    ),
    "scores_daily": Table(
        _struct(
            "symbol string, date date, composite_score double, gate_passed boolean, gate_trend_template_passed boolean, gate_relative_strength_passed boolean, trend_template_score double, "
            "trend_template_evaluated boolean, stage_score double, stage_evaluated boolean, relative_strength_score double, relative_strength_evaluated boolean, vcp_score double, "
            "vcp_evaluated boolean, volume_score double, volume_evaluated boolean, fundamentals_score double, fundamentals_evaluated boolean, quality_grade string, stage int, "
            "relative_strength_rating int"
        ),
        ("symbol", "date"),
    ),
    "watchlists": Table(_struct("name string, created_at timestamp"), ("name",)),
    "watchlist_symbols": Table(_struct("watchlist string, symbol string, added_at timestamp"), ("watchlist", "symbol")),
    "screener_presets": Table(_struct("name string, filters_json string, created_at timestamp"), ("name",)),
}

#: Every filing as it was announced, with its place in the order of arrival.
TABLES["fundamentals_announced"] = Table(
    _struct(
        "symbol string, period_start date, period_end date, announcement_date date, is_consolidated boolean, revenue double, basic_eps double, source string, fields_missing boolean, "
        "announcement_date_is_estimated boolean, arrival bigint"
    ),
    ("symbol", "period_end", "announcement_date", "is_consolidated", "arrival"), "announcement_date",
)

#: What runs carry from one night to the next, and what of the bars it covers.
_OF_SYMBOL = T.StructField("symbol", T.StringType())
TABLES |= {
    "strength_calendar": Table(_struct("date date, session int, benchmark double, known bigint"), ("date",)),
    "strength_symbols": Table(T.StructType([_OF_SYMBOL, *_struct("top_line double, top_close double"), T.StructField("recent", T.ArrayType(_struct("session int, date date, close double")))]), ("symbol",)),
    "volume_symbols": Table(
        T.StructType([_OF_SYMBOL, T.StructField("recent", T.ArrayType(_struct("date date, close double, high double, low double, volume double, line double, place bigint")))]), ("symbol",)
    ),
    "stream_seqs": Table(_struct("symbol string, date date, seq bigint"), ("symbol", "date"), "date"),
    "run_marks": Table(_struct("run string, mark string"), ("run",)),
}

#: A quarterly filing as providers give it.
FILING = _struct(
    "symbol string, period_start date, period_end date, announcement_date date, is_consolidated boolean, is_audited boolean, revenue double, pat double, basic_eps double, diluted_eps double, "
    "shares_outstanding double, source string, source_url string, fields_missing boolean, announcement_date_is_estimated boolean"
)
INSTRUMENT = _struct("symbol string, provider_instrument_id string, exchange string, segment string, instrument_type string, isin string, name string")
