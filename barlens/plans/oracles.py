"""The registered queries as SQL for DuckDB, built from shared common table expressions."""

from __future__ import annotations

from barlens.config import Trend


def bars(market: str = "supplier") -> str:
    """raw_bars and universe of a market, and adj: adjusted daily bars of active symbols."""
    if market == "nation":
        source = "SELECT 'N' || s_nationkey AS symbol, lineitem.* FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
        names = """SELECT 'N' || n_nationkey AS symbol, CAST(NULL AS VARCHAR) AS isin, r_name AS sector, n_name AS industry, CAST(NULL AS DATE) AS listing_date, TRUE AS is_active
          FROM nation JOIN region ON n_regionkey = r_regionkey"""
    else:
        source = "SELECT 'S' || l_suppkey AS symbol, * FROM lineitem"
        names = """SELECT 'S' || s_suppkey AS symbol, 'IN' || s_suppkey AS isin, r_name AS sector, n_name AS industry,
            CASE WHEN s_suppkey % 5 <> 0 THEN CAST(DATE '1992-01-01' + CAST(s_suppkey * 37 % 900 AS INTEGER) AS DATE) END AS listing_date, s_acctbal > 0 AS is_active
          FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
    return f"""
    src AS ({source}),
    days AS (
      SELECT symbol, CAST(l_shipdate AS DATE) AS date, sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS k,
        max(CAST(round(l_tax * 100) AS BIGINT)) AS tx, min(CAST(round(l_tax * 100) AS BIGINT)) AS tn, CAST(sum(l_quantity) AS BIGINT) AS volume
      FROM src GROUP BY ALL
    ),
    walk AS (SELECT *, sum(k) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS ck FROM days),
    prices AS (
      SELECT symbol, date, round(100 * exp(0.004 * CAST(ck - k AS DOUBLE)), 4) AS open, round(100 * exp(0.004 * CAST(ck AS DOUBLE)), 4) AS close, tx, tn, volume FROM walk
    ),
    raw_bars AS (
      SELECT symbol, date, open, greatest(open, close) * (1 + tx / 1000.0E0) AS high, least(open, close) * (1 - tn / 1000.0E0) AS low, close, volume,
        CASE WHEN CAST(substr(symbol, 2) AS INTEGER) % 7 = 0 AND date < DATE '1995-06-17' THEN close / 2 ELSE close END AS adj_close
      FROM prices
    ),
    universe AS ({names}),
    adj AS (
      SELECT symbol, date, coalesce(nullif(adj_close, 0), close) AS close, high * coalesce(nullif(adj_close, 0) / nullif(close, 0), 1) AS high,
        low * coalesce(nullif(adj_close, 0) / nullif(close, 0), 1) AS low, volume
      FROM raw_bars JOIN universe USING (symbol) WHERE is_active
    ),
    raw_weeks AS (
      SELECT symbol, CAST(date_trunc('week', date) + INTERVAL 4 DAY AS DATE) AS week_end_date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
        arg_max(close, date) AS close, CAST(sum(volume) AS BIGINT) AS volume, arg_max(adj_close, date) AS adj_close
      FROM raw_bars GROUP BY symbol, date_trunc('week', date)
    ),
    adj_weeks AS (
      SELECT symbol, week_end_date AS date, coalesce(nullif(adj_close, 0), close) AS close, high * coalesce(nullif(adj_close, 0) / nullif(close, 0), 1) AS high,
        low * coalesce(nullif(adj_close, 0) / nullif(close, 0), 1) AS low, volume
      FROM raw_weeks JOIN universe USING (symbol) WHERE is_active
    )"""


def r(column: str, digits: int = 4, name: str | None = None) -> str:
    return f"round({column}, {digits}) + 0.0E0 AS {name or column}"


CRITERIA = (
    "price_above_150_and_200_ma", "ma_150_above_200", "ma_200_trending_up", "ma_50_above_150_and_200", "price_above_50_ma",
    "price_at_least_25pct_above_52_week_low", "price_within_25pct_of_52_week_high", "relative_strength_at_least_70",
)
_TECHNICAL = ", ".join(CRITERIA[:7])


def trend(source: str, name: str, s: int, m: int, lng: int, month: int, year: int, ratings: str | None = None) -> str:
    """{name}_m: the measures at every bar; {name}: the criteria and roll-ups at every bar."""
    def rolling(fn: str, n: int) -> str:
        return f"CASE WHEN bar_count >= {n} THEN {fn} OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) END"

    joined = f"LEFT JOIN (SELECT symbol, date, rating FROM {ratings}) USING (symbol, date)" if ratings else ""
    rating = "rating" if ratings else "CAST(NULL AS INTEGER)"

    def tally(test: str, names) -> str:
        return " + ".join(f"CASE WHEN {c} {test} THEN 1 ELSE 0 END" for c in names)

    return f"""
    {name}_n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS bar_count FROM {source}),
    {name}_a AS (
      SELECT symbol, date, close, CAST(bar_count AS INTEGER) AS bar_count, {rolling("avg(close)", s)} AS ma_short, {rolling("avg(close)", m)} AS ma_medium, {rolling("avg(close)", lng)} AS ma_long,
        {rolling("min(low)", year)} AS low_year, {rolling("max(high)", year)} AS high_year
      FROM {name}_n
    ),
    {name}_m AS (SELECT *, lag(ma_long, {month}) OVER (PARTITION BY symbol ORDER BY date) AS ma_long_prior FROM {name}_a),
    {name}_c AS (
      SELECT *, {rating} AS the_rating,
        CASE WHEN ma_long IS NOT NULL THEN close > ma_medium AND close > ma_long END AS {CRITERIA[0]},
        CASE WHEN ma_long IS NOT NULL THEN ma_medium > ma_long END AS {CRITERIA[1]},
        CASE WHEN ma_long_prior IS NOT NULL THEN ma_long > ma_long_prior END AS {CRITERIA[2]},
        CASE WHEN ma_long IS NOT NULL THEN ma_short > ma_medium AND ma_short > ma_long END AS {CRITERIA[3]},
        CASE WHEN ma_long IS NOT NULL THEN close > ma_short END AS {CRITERIA[4]},
        CASE WHEN low_year IS NOT NULL THEN close >= low_year * 1.25E0 END AS {CRITERIA[5]},
        CASE WHEN high_year IS NOT NULL THEN close >= high_year * 0.75E0 END AS {CRITERIA[6]},
        CASE WHEN {rating} IS NOT NULL THEN {rating} >= 70 END AS {CRITERIA[7]}
      FROM {name}_m {joined}
    ),
    {name}_t AS (
      SELECT *, {tally("", CRITERIA)} AS passed_count, {tally("IS NOT NULL", CRITERIA)} AS evaluated_count, {tally("", CRITERIA[:7])} AS technical_passes,
        {tally("IS NOT NULL", CRITERIA[:7])} AS technical_evaluated
      FROM {name}_c
    ),
    {name} AS (
      SELECT *, passed_count / nullif(evaluated_count, 0) AS pass_rate, passed_count >= 6 AND evaluated_count = 8 AS meets_gate, technical_evaluated = 7 AS minimum_history_available,
        evaluated_count = 8 AS all_criteria_evaluated, close / low_year - 1 AS percent_above_low, 1 - close / high_year AS percent_below_high
      FROM {name}_t
    ),
    {name}_last AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"""


def daily(source: str = "adj", name: str = "daily", ratings: str | None = None) -> str:
    return trend(source, name, 50, 150, 200, 21, 252, ratings)


def weekly(source: str = "adj_weeks", name: str = "weekly") -> str:
    return trend(source, name, 10, 30, 40, 4, 52)


def stages(source: str, name: str = "stages") -> str:
    return f"""
    {name}_s AS (SELECT *, (ma_long - ma_long_prior) / nullif(ma_long_prior, 0) AS ma_long_slope FROM {source}),
    {name} AS (
      SELECT symbol, date, CAST(CASE
          WHEN close > ma_short AND ma_short > ma_medium AND ma_medium > ma_long AND ma_long_slope > 0.02 AND technical_passes >= 6 THEN 2
          WHEN close < ma_short AND ma_short < ma_medium AND ma_medium < ma_long AND ma_long_slope < -0.02 THEN 4
          WHEN (close < ma_short AND (ma_long_slope <= 0.02 OR ma_short <= ma_medium)) OR (close >= ma_short * 1.2E0 AND ma_long_slope <= 0.02) THEN 3
          ELSE 1 END AS INTEGER) AS stage,
        close AS price, ma_short, ma_medium, ma_long, ma_long_slope, technical_passes AS trend_template_passes
      FROM {name}_s WHERE ma_short IS NOT NULL AND ma_medium IS NOT NULL AND ma_long IS NOT NULL AND ma_long_slope IS NOT NULL
    )"""


#: Over the closes of adj, on a dense grid of sessions and symbols.
STRENGTH = """
    sessions AS (SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM adj)),
    grid AS (SELECT symbol, date, session FROM sessions CROSS JOIN (SELECT DISTINCT symbol FROM adj)),
    dense AS (SELECT symbol, date, session, close FROM grid LEFT JOIN (SELECT symbol, date, close FROM adj) USING (symbol, date)),
    filled AS (
      SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session ROWS UNBOUNDED PRECEDING) AS padded,
        close / lag(close, 63) OVER w - 1 AS return_63, close / lag(close, 126) OVER w - 1 AS return_126, close / lag(close, 189) OVER w - 1 AS return_189, close / lag(close, 252) OVER w - 1 AS return_252,
        lag(close) OVER w AS before_close
      FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY session)
    ),
    changed AS (SELECT *, padded / lag(padded) OVER (PARTITION BY symbol ORDER BY session) - 1 AS change, 0.4 * return_63 + 0.2 * return_126 + 0.2 * return_189 + 0.2 * return_252 AS composite_return FROM filled),
    means AS (SELECT date, session, coalesce(avg(change), 0) AS mean FROM changed GROUP BY ALL),
    marks AS (SELECT date, product(1 + mean) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS benchmark FROM means),
    lined AS (SELECT changed.*, close / benchmark AS rs_line FROM changed JOIN marks USING (date)),
    highs AS (
      SELECT *, coalesce(before_close IS NOT NULL AND rs_line >= max(rs_line) OVER w AND close < max(close) OVER w, FALSE) AS rs_line_new_high
      FROM lined WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    usable AS (SELECT * FROM highs WHERE composite_return IS NOT NULL AND rs_line IS NOT NULL),
    ratings AS (
      SELECT symbol, date, composite_return, rs_line, rs_line_new_high, CAST(count(*) OVER (PARTITION BY date) AS INTEGER) AS universe_size,
        CAST(round_even(98 * ((rank() OVER (PARTITION BY date ORDER BY composite_return) + (count(*) OVER (PARTITION BY date, composite_return) - 1) / 2.0E0) / count(*) OVER (PARTITION BY date)) + 1, 0) AS INTEGER) AS rating
      FROM usable
    )"""

#: Over adj_weeks and adj.
PATTERN = """
    weeks_k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM adj_weeks),
    weeks AS (
      SELECT symbol, date, high, low, close, volume, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY symbol) AS n,
        sum(volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS cv
      FROM weeks_k WHERE back <= 65 QUALIFY n >= 7
    ),
    framed AS (
      SELECT *, max(high) OVER f AS mh, min(low) OVER f AS ml, lag(high, 2) OVER w AS h0, lead(high, 2) OVER w AS h4, lag(low, 2) OVER w AS l0, lead(low, 2) OVER w AS l4
      FROM weeks WINDOW w AS (PARTITION BY symbol ORDER BY i), f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
    ),
    raw_swings AS (
      SELECT symbol, i, date, 'high' AS kind, 0 AS second, high AS price, cv, volume FROM framed WHERE i >= 2 AND i < n - 2 AND high = mh AND high > h0 AND high > h4
      UNION ALL
      SELECT symbol, i, date, 'low', 1, low, cv, volume FROM framed WHERE i >= 2 AND i < n - 2 AND low = ml AND low < l0 AND low < l4
    ),
    runs_c AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY symbol ORDER BY i, second) THEN 0 ELSE 1 END AS changed FROM raw_swings),
    runs AS (SELECT *, sum(changed) OVER (PARTITION BY symbol ORDER BY i, second ROWS UNBOUNDED PRECEDING) AS run FROM runs_c),
    swings AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY symbol, run ORDER BY CASE WHEN kind = 'high' THEN -price ELSE price END, i) = 1),
    followed AS (
      SELECT *, lead(i) OVER w AS low_i, lead(date) OVER w AS low_date, lead(kind) OVER w AS low_kind, lead(price) OVER w AS low, lead(cv) OVER w AS low_cv
      FROM swings WINDOW w AS (PARTITION BY symbol ORDER BY run)
    ),
    pairs AS (
      SELECT symbol, i AS start_i, date AS start_date, price AS start_high, low_date, low, (price - low) / price AS depth_fraction, CAST(low_cv - cv + volume AS DOUBLE) / (low_i - i + 1) AS average_volume
      FROM followed WHERE kind = 'high' AND low_kind = 'low'
    ),
    contractions AS (
      SELECT *, CAST(row_number() OVER w AS INTEGER) AS c, depth_fraction / nullif(lag(depth_fraction) OVER w, 0) AS depth_ratio_to_prior, average_volume / nullif(lag(average_volume) OVER w, 0) AS volume_ratio_to_prior
      FROM pairs WINDOW w AS (PARTITION BY symbol ORDER BY start_i)
    ),
    islands AS (SELECT *, sum(CASE WHEN depth_ratio_to_prior <= 0.8 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY c ROWS UNBOUNDED PRECEDING) AS island FROM contractions),
    sized AS (
      SELECT *, CAST(count(*) OVER (PARTITION BY symbol, island) AS INTEGER) AS length, CAST(row_number() OVER (PARTITION BY symbol, island ORDER BY c) AS INTEGER) AS place FROM islands
    ),
    chosen AS (
      SELECT symbol, island FROM (SELECT DISTINCT symbol, island, length FROM sized) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY length >= 2 DESC, island DESC) = 1
    ),
    sequence AS (SELECT sized.* FROM sized JOIN chosen USING (symbol, island)),
    checked AS (
      SELECT symbol, CAST(count(*) AS INTEGER) AS contraction_count, arg_max(start_high, c) AS pivot_price, arg_max(start_date, c) AS pivot_date,
        CASE WHEN count(*) >= 2 THEN CAST((arg_max(low_date, c) - arg_min(start_date, c)) // 7 + 1 AS INTEGER) END AS base_length_weeks,
        coalesce(bool_and(CASE WHEN place > 1 THEN coalesce(depth_ratio_to_prior <= 0.8, FALSE) END), TRUE) AS depth_decay_passed,
        coalesce(bool_and(CASE WHEN place > 1 THEN coalesce(volume_ratio_to_prior BETWEEN 0.4 AND 0.6, FALSE) END), TRUE) AS volume_decay_passed
      FROM sequence GROUP BY symbol
    ),
    checks AS (
      SELECT *, coalesce(base_length_weeks BETWEEN 5 AND 65, FALSE) AS base_length_passed, contraction_count BETWEEN 2 AND 4 AS count_passed FROM checked
    ),
    recent AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM adj QUALIFY k <= 21),
    anchored AS (SELECT recent.*, first_value(close) OVER (PARTITION BY symbol ORDER BY k) AS anchor FROM recent),
    confirm_m AS (
      SELECT symbol, max(date) AS as_of_date, max(anchor) AS price, max(CASE WHEN k = 1 THEN volume END) AS latest_volume,
        CAST(sum(CASE WHEN k <= 10 AND abs(close - anchor) / anchor <= 0.015 THEN 1 ELSE 0 END) AS INTEGER) AS tight_close_count,
        (max(CASE WHEN k <= 10 THEN close END) - min(CASE WHEN k <= 10 THEN close END)) / min(CASE WHEN k <= 10 THEN close END) AS tight_close_range_fraction,
        avg(CASE WHEN k BETWEEN 2 AND 21 THEN volume END) AS average_volume
      FROM anchored GROUP BY symbol
    ),
    confirmation AS (
      SELECT symbol, as_of_date, price, (price - pivot_price) / pivot_price AS distance_to_pivot_fraction, abs((price - pivot_price) / pivot_price) <= 0.05 AS near_pivot, tight_close_count,
        tight_close_range_fraction, tight_close_count >= 3 AND tight_close_range_fraction <= 0.015 AS tight_closes_confirmed,
        price > pivot_price AND coalesce(latest_volume >= average_volume * 1.4E0, FALSE) AS breakout_confirmed
      FROM confirm_m JOIN checks USING (symbol)
    ),
    joined AS (
      SELECT w.symbol, w.date, coalesce(contraction_count, 0) AS contraction_count, pivot_price, pivot_date, base_length_weeks, coalesce(depth_decay_passed, FALSE) AS depth_decay_passed,
        coalesce(volume_decay_passed, FALSE) AS volume_decay_passed, coalesce(base_length_passed, FALSE) AS base_length_passed, coalesce(count_passed, FALSE) AS count_passed,
        near_pivot IS NOT NULL AS daily_confirmation_available, near_pivot, distance_to_pivot_fraction, coalesce(tight_close_count, 0) AS tight_close_count,
        coalesce(tight_closes_confirmed, FALSE) AS tight_closes_confirmed, coalesce(breakout_confirmed, FALSE) AS breakout_confirmed
      FROM (SELECT symbol, max(date) AS date FROM weeks GROUP BY symbol) w LEFT JOIN checks USING (symbol) LEFT JOIN confirmation USING (symbol)
    ),
    judged AS (SELECT *, count_passed AND depth_decay_passed AND base_length_passed AS structure, count_passed AND depth_decay_passed AND base_length_passed AND volume_decay_passed AS is_vcp FROM joined),
    patterns AS (
      SELECT symbol, date, is_vcp,
        CASE WHEN is_vcp AND tight_closes_confirmed AND coalesce(near_pivot, FALSE) THEN 'A+' WHEN is_vcp AND (coalesce(near_pivot, FALSE) OR breakout_confirmed) THEN 'A' WHEN structure THEN 'B' ELSE 'C' END AS quality_grade,
        CASE WHEN is_vcp THEN 'Weekly structure qualifies.' ELSE 'Weekly structure needs: ' || concat_ws(', ', CASE WHEN NOT count_passed THEN 'contraction count' END, CASE WHEN NOT depth_decay_passed THEN 'depth decay' END,
          CASE WHEN NOT volume_decay_passed THEN 'volume dry-up' END, CASE WHEN NOT base_length_passed THEN 'base length' END) || '.' END AS reason,
        pivot_price, pivot_date, contraction_count, base_length_weeks, depth_decay_passed, volume_decay_passed, base_length_passed, daily_confirmation_available, near_pivot, distance_to_pivot_fraction,
        tight_close_count, tight_closes_confirmed, breakout_confirmed
      FROM judged
    )"""


def pattern_history() -> str:
    """patterns of every week e: PATTERN's steps within symbol and week, over a join of each week with those before it."""
    steps = PATTERN[PATTERN.index("    framed AS (") : PATTERN.index("    recent AS (")]
    judged = PATTERN[PATTERN.index("    judged AS (") :]
    for old, new in (("PARTITION BY symbol", "PARTITION BY symbol, e"), ("SELECT symbol,", "SELECT symbol, e,"), ("DISTINCT symbol,", "DISTINCT symbol, e,"), ("GROUP BY symbol", "GROUP BY symbol, e"), ("USING (symbol, island)", "USING (symbol, e, island)")):
        steps = steps.replace(old, new)
    return f"""
    weeks_t AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS t FROM adj_weeks),
    ends AS (SELECT symbol, t AS e, date AS as_of FROM weeks_t WHERE t >= 6),
    weeks AS (
      SELECT symbol, e, date, high, low, close, volume, t - greatest(e - 64, 0) AS i, least(e + 1, 65) AS n, sum(volume) OVER (PARTITION BY symbol, e ORDER BY t ROWS UNBOUNDED PRECEDING) AS cv
      FROM weeks_t JOIN ends USING (symbol) WHERE t BETWEEN e - 64 AND e
    ),
{steps}
    days_b AS (SELECT symbol, date, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY date) AS b, CAST(date_trunc('week', date) + INTERVAL 4 DAY AS DATE) AS friday FROM adj),
    tops AS (SELECT symbol, e, max(b) AS top FROM ends JOIN days_b USING (symbol) WHERE friday <= as_of GROUP BY symbol, e),
    anchored AS (
      SELECT symbol, e, d.close, d.volume, top - d.b + 1 AS k, a.close AS anchor FROM tops JOIN days_b a USING (symbol) JOIN days_b d USING (symbol) WHERE a.b = top AND d.b BETWEEN top - 20 AND top
    ),
    confirm_m AS (
      SELECT symbol, e, max(anchor) AS price, max(CASE WHEN k = 1 THEN volume END) AS latest_volume,
        CAST(sum(CASE WHEN k <= 10 AND abs(close - anchor) / anchor <= 0.015 THEN 1 ELSE 0 END) AS INTEGER) AS tight_close_count,
        (max(CASE WHEN k <= 10 THEN close END) - min(CASE WHEN k <= 10 THEN close END)) / min(CASE WHEN k <= 10 THEN close END) AS tight_close_range_fraction,
        avg(CASE WHEN k BETWEEN 2 AND 21 THEN volume END) AS average_volume
      FROM anchored GROUP BY symbol, e
    ),
    confirmation AS (
      SELECT symbol, e, (price - pivot_price) / pivot_price AS distance_to_pivot_fraction, abs((price - pivot_price) / pivot_price) <= 0.05 AS near_pivot, tight_close_count,
        tight_close_count >= 3 AND tight_close_range_fraction <= 0.015 AS tight_closes_confirmed, price > pivot_price AND coalesce(latest_volume >= average_volume * 1.4E0, FALSE) AS breakout_confirmed
      FROM confirm_m JOIN checks USING (symbol, e)
    ),
    joined AS (
      SELECT ends.symbol, as_of AS date, coalesce(contraction_count, 0) AS contraction_count, pivot_price, pivot_date, base_length_weeks, coalesce(depth_decay_passed, FALSE) AS depth_decay_passed,
        coalesce(volume_decay_passed, FALSE) AS volume_decay_passed, coalesce(base_length_passed, FALSE) AS base_length_passed, coalesce(count_passed, FALSE) AS count_passed,
        near_pivot IS NOT NULL AS daily_confirmation_available, near_pivot, distance_to_pivot_fraction, coalesce(tight_close_count, 0) AS tight_close_count,
        coalesce(tight_closes_confirmed, FALSE) AS tight_closes_confirmed, coalesce(breakout_confirmed, FALSE) AS breakout_confirmed
      FROM ends LEFT JOIN checks USING (symbol, e) LEFT JOIN confirmation USING (symbol, e)
    ),
{judged}"""


def volumes(pivots: str | None) -> str:
    """pivots: a relation of symbol and pivot_price."""
    joined = f"LEFT JOIN (SELECT symbol, pivot_price FROM {pivots} WHERE pivot_price IS NOT NULL) USING (symbol)" if pivots else ""
    pivot = "pivot_price" if pivots else "CAST(NULL AS DOUBLE)"
    return f"""
    flows AS (
      SELECT *, {pivot} AS pivot_used, row_number() OVER w - 1 AS place, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, lag(close) OVER w AS before_close,
        sum(coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS line,
        CASE WHEN row_number() OVER w > 20 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS average_before
      FROM adj {joined} WINDOW w AS (PARTITION BY symbol ORDER BY date)
    ),
    marked AS (
      SELECT *, coalesce(back <= 10 AND place >= 20 AND close > before_close AND abs(close - pivot_used) / pivot_used <= 0.05 AND average_before > 0 AND volume >= average_before * 1.4E0, FALSE) AS spike FROM flows
    ),
    sums AS (
      SELECT symbol, max(date) AS date, count(*) AS bars, CAST(coalesce(sum(CASE WHEN back <= 50 AND close > before_close THEN volume END), 0) AS DOUBLE) AS up,
        CAST(coalesce(sum(CASE WHEN back <= 50 AND close < before_close THEN volume END), 0) AS DOUBLE) AS down, max(CASE WHEN back = 1 THEN line END) AS line, max(CASE WHEN back = 51 THEN line END) AS earlier,
        max(pivot_used) AS pivot_price_used, bool_or(spike) AS volume_spike_near_pivot,
        arg_max(date, volume * 1000 + back) FILTER (spike) AS spike_date, CAST(max(volume) FILTER (spike) AS DOUBLE) AS spike_volume
      FROM marked GROUP BY symbol
    ),
    volumes AS (
      SELECT symbol, date, CASE WHEN bars > 50 THEN up END AS up_volume, CASE WHEN bars > 50 THEN down END AS down_volume, CASE WHEN bars > 50 THEN up / nullif(down, 0) END AS up_down_volume_ratio,
        line AS accumulation_distribution_value, line > earlier AS accumulation_distribution_rising, pivot_price_used, volume_spike_near_pivot, spike_date, spike_volume
      FROM sums
    )"""


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_STRENGTH_BARS = bars("nation") + "," + STRENGTH
_TODAYS_PIVOTS = "todays AS (SELECT symbol, pivot_price FROM patterns WHERE date = (SELECT max(date) FROM patterns))"
_SCORED = (
    _STRENGTH_BARS + "," + daily("adj", "daily", "ratings") + "," + weekly() + "," + stages("daily_last") + "," + PATTERN + "," + _TODAYS_PIVOTS + "," + volumes("todays") + """,
    parts AS (
      SELECT symbol, d.date AS daily_date, w.date AS weekly_date, d.pass_rate AS dr, w.pass_rate AS wr, d.passed_count AS dp, d.evaluated_count AS de, st.stage, rt.rating, rt.rs_line_new_high,
        pt.symbol_p IS NOT NULL AS has_pattern, pt.* EXCLUDE (symbol_p), vl.symbol_v IS NOT NULL AS has_volume, vl.* EXCLUDE (symbol_v)
      FROM daily_last d FULL JOIN weekly_last w USING (symbol)
      LEFT JOIN (SELECT symbol, stage FROM stages WHERE date = (SELECT max(date) FROM stages)) st USING (symbol)
      LEFT JOIN (SELECT symbol, rating, rs_line_new_high FROM ratings WHERE date = (SELECT max(date) FROM ratings)) rt USING (symbol)
      LEFT JOIN (SELECT symbol AS symbol_p, contraction_count, depth_decay_passed, volume_decay_passed, base_length_passed, daily_confirmation_available, near_pivot, tight_closes_confirmed, breakout_confirmed,
          quality_grade FROM patterns WHERE date = (SELECT max(date) FROM patterns)) pt ON symbol = symbol_p
      LEFT JOIN (SELECT symbol AS symbol_v, up_down_volume_ratio, accumulation_distribution_rising, volume_spike_near_pivot FROM volumes WHERE date = (SELECT max(date) FROM volumes)) vl ON symbol = symbol_v
    ),
    scored AS (
      SELECT *, CASE WHEN dr IS NULL THEN wr WHEN wr IS NULL THEN dr ELSE (dr + wr) / 2 END * 100 AS trend_score,
        CAST(CASE stage WHEN 1 THEN 50 WHEN 2 THEN 100 WHEN 3 THEN 25 WHEN 4 THEN 0 END AS DOUBLE) AS stage_score,
        CASE WHEN rating IS NOT NULL THEN least(CAST(rating AS DOUBLE) + CASE WHEN rs_line_new_high THEN 5 ELSE 0 END, 100) END AS strength_score,
        CASE WHEN has_pattern THEN
          0.7E0 * (depth_decay_passed::INT + volume_decay_passed::INT + base_length_passed::INT + (contraction_count BETWEEN 2 AND 4)::INT) / 4 * 100
          + 0.3E0 * CASE WHEN daily_confirmation_available THEN (near_pivot::INT + tight_closes_confirmed::INT + breakout_confirmed::INT) / 3.0E0 * 100 ELSE 50 END END AS contraction_score,
        CASE WHEN has_volume THEN least(CASE WHEN up_down_volume_ratio IS NULL THEN 50 ELSE (least(greatest(up_down_volume_ratio, 0.5), 2.0) - 0.5) / 1.5E0 * 100 END
          + CASE WHEN accumulation_distribution_rising THEN 15 ELSE 0 END + CASE WHEN volume_spike_near_pivot THEN 15 ELSE 0 END, 100) END AS volume_score,
        coalesce(de = 8 AND dp >= 6, FALSE) AS gate_trend, coalesce(rating >= 70, FALSE) AS gate_strength
      FROM parts
    ),
    scores AS (
      SELECT symbol, coalesce(daily_date, weekly_date) AS date, gate_trend AND gate_strength AS gate_passed, quality_grade, stage, rating AS relative_strength_rating,
        coalesce(round((coalesce(trend_score * 0.25E0, 0) + coalesce(stage_score * 0.1E0, 0) + coalesce(strength_score * 0.2E0, 0) + coalesce(contraction_score * 0.3E0, 0) + coalesce(volume_score * 0.05E0, 0))
          / nullif(CASE WHEN trend_score IS NULL THEN 0 ELSE 0.25E0 END + CASE WHEN stage_score IS NULL THEN 0 ELSE 0.1E0 END + CASE WHEN strength_score IS NULL THEN 0 ELSE 0.2E0 END
            + CASE WHEN contraction_score IS NULL THEN 0 ELSE 0.3E0 END + CASE WHEN volume_score IS NULL THEN 0 ELSE 0.05E0 END, 0), 2), 0) AS composite_score
      FROM scored WHERE coalesce(daily_date, weekly_date) IS NOT NULL
    )"""
)

_FILINGS = """
    sums AS (
      SELECT c_nationkey, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS period_end, o_orderstatus, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, count(*) AS n,
        min(o_orderkey) AS arrival
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
    ),
    filings AS (
      SELECT 'N' || c_nationkey AS symbol, CAST(date_trunc('quarter', period_end) AS DATE) AS period_start, period_end, CAST(period_end + CAST(arrival % 250 - 5 AS INTEGER) AS DATE) AS announcement_date,
        o_orderstatus = 'F' AS is_consolidated, CASE WHEN arrival % 11 <> 0 THEN cents / 100.0E0 END AS revenue, CASE WHEN arrival % 11 <> 0 THEN cents / (n * 1000.0E0) END AS basic_eps,
        arrival % 11 = 0 AS fields_missing, arrival
      FROM sums
    ),
    preferred AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY symbol, period_end ORDER BY is_consolidated DESC, arrival) = 1),
    stored AS (
      SELECT symbol, period_end AS quarter_end, basic_eps AS eps, revenue AS sales, fields_missing, announcement_date - period_end > 180 AS is_backlog_filing
      FROM preferred WHERE period_start <= period_end AND announcement_date >= period_end
    ),
    matched AS (
      SELECT c.*, p.eps AS p_eps, p.sales AS p_sales, p.fields_missing AS p_missing FROM stored c
      LEFT JOIN stored p ON p.symbol = c.symbol AND p.quarter_end BETWEEN c.quarter_end - 410 AND c.quarter_end - 320
      QUALIFY row_number() OVER (PARTITION BY c.symbol, c.quarter_end ORDER BY abs(c.quarter_end - 365 - p.quarter_end), p.quarter_end DESC) = 1
    ),
    grown AS (
      SELECT *, CASE WHEN NOT fields_missing AND NOT p_missing THEN (eps - p_eps) / nullif(abs(p_eps), 0) * 100 END AS eps_yoy_growth,
        CASE WHEN NOT fields_missing AND NOT p_missing THEN (sales - p_sales) / nullif(abs(p_sales), 0) * 100 END AS sales_yoy_growth
      FROM matched
    )"""

#: latest_known: the last quarter known at each asked date, with growth as known then; asked: symbol and date.
_KNOWN = """,
    asked AS ({asked}),
    seen AS (
      SELECT a.symbol, a.date, f.* EXCLUDE (symbol) FROM asked a JOIN filings f ON f.symbol = a.symbol AND f.announcement_date <= a.date
      QUALIFY row_number() OVER (PARTITION BY a.symbol, a.date, period_end ORDER BY is_consolidated DESC, arrival) = 1
    ),
    valid AS (SELECT *, CAST(count(*) OVER (PARTITION BY symbol, date) AS INTEGER) AS quarters_known FROM seen WHERE period_start <= period_end AND announcement_date >= period_end),
    newest AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY period_end DESC) = 1),
    based AS (
      SELECT c.*, p.basic_eps AS p_eps, p.revenue AS p_sales, p.fields_missing AS p_missing FROM newest c
      LEFT JOIN valid p ON p.symbol = c.symbol AND p.date = c.date AND p.period_end BETWEEN c.period_end - 410 AND c.period_end - 320
      QUALIFY row_number() OVER (PARTITION BY c.symbol, c.date ORDER BY abs(c.period_end - 365 - p.period_end), p.period_end DESC) = 1
    ),
    latest_known AS (
      SELECT symbol, date, period_end AS quarter_end, announcement_date, is_consolidated, basic_eps AS eps, revenue AS sales, quarters_known,
        CASE WHEN NOT fields_missing AND NOT p_missing THEN (basic_eps - p_eps) / nullif(abs(p_eps), 0) * 100 END AS eps_yoy_growth,
        CASE WHEN NOT fields_missing AND NOT p_missing THEN (revenue - p_sales) / nullif(abs(p_sales), 0) * 100 END AS sales_yoy_growth
      FROM based
    )"""

_GAPS = """,
    market_days AS (SELECT DISTINCT date FROM raw_bars),
    coverage AS (
      SELECT symbol, listing_date, first_date, last_date, greatest(first_date, coalesce(listing_date, first_date)) AS expected_from
      FROM (SELECT symbol, min(date) AS first_date, max(date) AS last_date FROM raw_bars GROUP BY symbol) LEFT JOIN universe USING (symbol)
    ),
    gaps AS (
      SELECT c.symbol, c.listing_date, c.first_date, c.last_date, m.date FROM coverage c JOIN market_days m ON m.date BETWEEN c.expected_from AND c.last_date
      ANTI JOIN raw_bars b ON b.symbol = c.symbol AND b.date = m.date
    )"""
_K = "CAST(substr(symbol, 2) AS INTEGER)"
#: facts: actions with their factors, over unadjusted closes.
_ACTIONS = f""",
    unadjusted AS (
      SELECT symbol, date, volume, close * CASE WHEN {_K} % 7 = 0 AND date < DATE '1995-06-17' THEN 2.0E0 ELSE 1 END
        * CASE WHEN {_K} % 5 = 0 AND date < DATE '1996-03-01' + {_K} * 3 % 97 THEN 1.5E0 ELSE 1 END
        * CASE WHEN {_K} % 10 = 0 AND date < DATE '1996-03-01' + {_K} * 3 % 97 THEN 2.5E0 ELSE 1 END * CASE WHEN {_K} % 13 = 0 AND date < DATE '1997-06-16' THEN 10.0E0 ELSE 1 END AS close
      FROM raw_bars
    ),
    keys AS (SELECT CAST(s_suppkey AS INTEGER) AS k, 'S' || s_suppkey AS symbol FROM supplier),
    acts AS (
      SELECT symbol, DATE '1995-06-17' AS ex_date, 1.0E0 / 2 AS fixed, NULL::DOUBLE AS paid FROM keys WHERE k % 7 = 0
      UNION ALL SELECT symbol, DATE '1996-03-01' + k * 3 % 97, 2.0E0 / 3, NULL FROM keys WHERE k % 5 = 0
      UNION ALL SELECT symbol, DATE '1994-05-02' + k * 5 % 97, NULL, 1.5E0 FROM keys WHERE k % 3 = 0
      UNION ALL SELECT symbol, DATE '1996-03-01' + k * 3 % 97, 2.0E0 / 5, NULL FROM keys WHERE k % 10 = 0
    ),
    priced AS (SELECT a.*, (SELECT arg_max(u.close, u.date) FROM unadjusted u WHERE u.symbol = a.symbol AND u.date < a.ex_date) AS before FROM acts a),
    facts AS (SELECT symbol, CAST(ex_date AS DATE) AS ex_date, coalesce(fixed, 1 - paid / before) AS factor FROM priced WHERE coalesce(fixed, 1 - paid / before) > 0)"""
_STAGED = "staged AS (SELECT symbol, CAST(DATE '1992-01-01' + CAST(CAST(substr(symbol, 2) AS INTEGER) % 2 * 30 AS INTEGER) AS DATE) AS new_date FROM universe WHERE CAST(substr(symbol, 2) AS INTEGER) % 3 <> 0)"
_SYNCED = "synced AS (SELECT symbol, new_date IS NOT NULL AS matched, coalesce(new_date, listing_date) AS listing_date, new_date IS NOT NULL AND listing_date IS DISTINCT FROM new_date AS changed FROM universe LEFT JOIN staged USING (symbol))"
_KEY = "CAST(substr(symbol, 2) AS INTEGER)"

ORACLES: dict[str, str] = {
    "bars_daily": q(bars(), f"SELECT symbol, date, {r('open')}, {r('high')}, {r('low')}, {r('close')}, volume, {r('adj_close')} FROM raw_bars"),
    "bars_adjusted": q(bars(), f"SELECT symbol, date, {r('close')}, {r('high')}, {r('low')}, volume FROM adj"),
    "bars_retro_adjusted": q(
        bars() + _ACTIONS,
        f"""SELECT symbol, date, {r('close', 6)}, round(close * coalesce((SELECT product(factor) FROM facts f WHERE f.symbol = u.symbol AND f.ex_date > u.date), 1), 6) + 0.0E0 AS adj_close FROM unadjusted u""",
    ),
    "action_factors": q(bars() + _ACTIONS, f"SELECT symbol, ex_date, {r('factor', 8)} FROM facts"),
    "dq_large_moves": q(
        bars() + _ACTIONS + """,
    stepped AS (SELECT symbol, date, ln(close / lag(close) OVER w) AS move, lag(date) OVER w AS before, (row_number() OVER w - 1) // 63 AS block FROM unadjusted WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    moves AS (SELECT *, move - coalesce((SELECT sum(ln(factor)) FROM facts f WHERE f.symbol = s.symbol AND f.ex_date > s.before AND f.ex_date <= s.date), 0) AS residual FROM stepped s),
    medians AS (SELECT symbol, block, median(residual) AS median, count(residual) AS n FROM moves GROUP BY ALL),
    spreads AS (SELECT m.symbol, m.block, any_value(median) AS median, median(abs(residual - median)) AS deviation FROM moves m JOIN medians d ON d.symbol = m.symbol AND d.block = m.block WHERE n >= 62 GROUP BY ALL)""",
        f"""SELECT m.symbol, date, {r('move', 6)}, {r('residual', 6)}, NOT (abs(residual - median) > 8 * deviation AND abs(residual) > 0.1) AS explained
FROM moves m JOIN spreads s ON s.symbol = m.symbol AND s.block + 1 = m.block WHERE deviation > 0 AND abs(move - median) > 8 * deviation AND abs(move) > 0.1""",
    ),
    "bars_valid": q(
        bars(),
        f"SELECT symbol, count(*) AS n FROM raw_bars WHERE symbol NOT IN (SELECT symbol FROM raw_bars WHERE {_KEY} % 11 = 3 AND dayofmonth(date) = 7) GROUP BY symbol",
    ),
    "weekly_resample": q(bars(), f"SELECT symbol, week_end_date, {r('open')}, {r('high')}, {r('low')}, {r('close')}, volume, {r('adj_close')} FROM raw_weeks"),
    "trend_daily_latest": q(bars() + "," + daily(), f"SELECT symbol, date, bar_count, {_TECHNICAL} FROM daily_last"),
    "trend_weekly_latest": q(bars() + "," + weekly(), f"SELECT symbol, date, bar_count, {_TECHNICAL} FROM weekly_last"),
    "trend_measures": q(
        bars() + "," + daily(),
        f"SELECT symbol, date, bar_count, {', '.join(r(c, 8) for c in ('close', 'ma_short', 'ma_medium', 'ma_long', 'ma_long_prior', 'low_year', 'high_year'))} FROM daily_m",
    ),
    "trend_rollup": q(
        _STRENGTH_BARS + "," + daily("adj", "daily", "ratings"),
        f"SELECT symbol, date, passed_count, evaluated_count, {r('pass_rate')}, meets_gate, minimum_history_available, all_criteria_evaluated, {r('percent_above_low')}, {r('percent_below_high')} FROM daily_last",
    ),
    "stage_latest": q(
        bars() + "," + daily() + "," + stages("daily_last"),
        f"SELECT symbol, date, stage, {r('price')}, {r('ma_short', 8)}, {r('ma_medium', 8)}, {r('ma_long', 8)}, {r('ma_long_slope')}, trend_template_passes FROM stages",
    ),
    "stage_history": q(bars() + "," + daily() + "," + stages("daily"), "SELECT symbol, date, stage, trend_template_passes FROM stages"),
    "stage_distribution": q(bars() + "," + daily() + "," + stages("daily"), "SELECT stage, count(*) AS n FROM stages GROUP BY stage"),
    "rs_returns": q(
        _STRENGTH_BARS, f"SELECT symbol, date, {', '.join(r(f'return_{k}') for k in (63, 126, 189, 252))}, {r('composite_return')} FROM changed WHERE close IS NOT NULL"
    ),
    "rs_benchmark": q(_STRENGTH_BARS, f"SELECT date, {r('benchmark')} FROM marks"),
    "rs_line": q(_STRENGTH_BARS, f"SELECT symbol, date, {r('rs_line')} FROM lined WHERE close IS NOT NULL"),
    "rs_new_high": q(_STRENGTH_BARS, "SELECT symbol, date FROM highs WHERE rs_line_new_high"),
    "rs_rating_history": q(_STRENGTH_BARS, f"SELECT symbol, date, {r('composite_return')}, rating, universe_size FROM ratings"),
    "rs_incremental": q(
        _STRENGTH_BARS, f"SELECT symbol, date, {r('composite_return')}, rating, {r('rs_line', 6)}, rs_line_new_high, universe_size FROM ratings WHERE date > DATE '1997-05-14'"
    ),
    "rs_carried": q(
        _STRENGTH_BARS + """,
    ends AS (SELECT max(session) AS last FROM sessions),
    kept AS (SELECT * FROM lined CROSS JOIN ends WHERE close IS NOT NULL QUALIFY session > last - 252 OR row_number() OVER (PARTITION BY symbol ORDER BY session DESC) = 1),
    tops AS (SELECT symbol, max(rs_line) AS top_line, max(close) AS top_close FROM lined WHERE close IS NOT NULL GROUP BY symbol)""",
        f"SELECT symbol, {r('top_line', 6)}, {r('top_close')}, CAST(count(*) AS INTEGER) AS n_recent, min(date) AS first_recent FROM kept JOIN tops USING (symbol) GROUP BY symbol, top_line, top_close",
    ),
    "rs_latest": q(_STRENGTH_BARS, "SELECT symbol, date, rating, rs_line_new_high FROM ratings WHERE date = (SELECT max(date) FROM ratings)"),
    "vcp_swings_raw": q(bars() + "," + PATTERN, f"SELECT symbol, i, date, kind, {r('price')} FROM raw_swings"),
    "vcp_swings_reduced": q(bars() + "," + PATTERN, f"SELECT symbol, i, date, kind, {r('price')} FROM swings"),
    "vcp_contractions": q(
        bars() + "," + PATTERN,
        f"SELECT symbol, c, start_date, low_date, {r('start_high')}, {r('low')}, {r('depth_fraction')}, {r('average_volume')}, {r('depth_ratio_to_prior')}, {r('volume_ratio_to_prior')} FROM contractions",
    ),
    "vcp_sequence": q(bars() + "," + PATTERN, f"SELECT symbol, place, length, start_date, {r('depth_fraction')} FROM sequence"),
    "vcp_checks": q(
        bars() + "," + PATTERN,
        f"SELECT symbol, contraction_count, {r('pivot_price')}, pivot_date, base_length_weeks, depth_decay_passed, volume_decay_passed, base_length_passed, count_passed FROM checks",
    ),
    "vcp_daily_confirmation": q(
        bars() + "," + PATTERN,
        f"SELECT symbol, as_of_date, {r('distance_to_pivot_fraction')}, near_pivot, tight_close_count, {r('tight_close_range_fraction')}, tight_closes_confirmed, breakout_confirmed FROM confirmation",
    ),
    "vcp_results": q(bars() + "," + PATTERN, "SELECT * REPLACE (round(pivot_price, 4) AS pivot_price, round(distance_to_pivot_fraction, 4) AS distance_to_pivot_fraction) FROM patterns"),
    "vcp_history": q(
        bars() + "," + pattern_history(), "SELECT * REPLACE (round(pivot_price, 4) AS pivot_price, round(distance_to_pivot_fraction, 4) AS distance_to_pivot_fraction) FROM patterns"
    ),
    "vcp_history_flagged": q(bars() + "," + pattern_history(), "SELECT date, quality_grade, count(*) AS n, CAST(sum(CASE WHEN is_vcp THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM patterns GROUP BY ALL"),
    "updown_volume": q(bars() + "," + volumes(None), f"SELECT symbol, up_volume, down_volume, {r('up_down_volume_ratio')} FROM volumes"),
    "ad_line": q(bars() + "," + volumes(None), f"SELECT symbol, date, {r('line', 2)} FROM flows"),
    "volume_incremental": q(
        bars() + "," + volumes(None),
        f"SELECT symbol, date, {r('up_down_volume_ratio')}, up_volume, down_volume, {r('accumulation_distribution_value', 2)}, accumulation_distribution_rising FROM volumes",
    ),
    "pivot_spike": q(
        bars() + ", lasts AS (SELECT symbol, arg_max(close, date) AS pivot_price FROM adj GROUP BY symbol)," + volumes("lasts"), "SELECT symbol, volume_spike_near_pivot, spike_date, spike_volume FROM volumes"
    ),
    "volume_signals": q(
        bars() + "," + PATTERN + "," + _TODAYS_PIVOTS + "," + volumes("todays"),
        f"SELECT symbol, date, {r('up_down_volume_ratio')}, up_volume, down_volume, {r('accumulation_distribution_value', 2)}, accumulation_distribution_rising, {r('pivot_price_used')}, volume_spike_near_pivot, "
        "spike_date, spike_volume FROM volumes",
    ),
    "score_components": q(_SCORED, f"SELECT symbol, {', '.join(r(f'{p}_score', 2) for p in ('trend', 'stage', 'strength', 'contraction', 'volume'))}, gate_trend, gate_strength FROM scored"),
    "score_composite": q(_SCORED, "SELECT symbol, date, composite_score, gate_passed, quality_grade, stage, relative_strength_rating FROM scores"),
    "score_ranked": q(_SCORED, "SELECT symbol, composite_score, gate_passed FROM scores WHERE date = (SELECT max(date) FROM scores)"),
    "gate_filter": q(
        _STRENGTH_BARS + "," + daily("adj", "daily", "ratings"),
        """SELECT symbol, round((pass_rate * 25 + least(today.rating + CASE WHEN today.rs_line_new_high THEN 5 ELSE 0 END, 100) * 0.2E0) / 0.45E0, 2) AS composite_score
        FROM daily_last JOIN (SELECT * FROM ratings WHERE date = (SELECT max(date) FROM ratings)) today USING (symbol) WHERE evaluated_count = 8 AND passed_count >= 5 AND today.rating >= 40""",
    ),
    "fund_preferred": q(_FILINGS, "SELECT symbol, period_end, is_consolidated, arrival FROM preferred"),
    "fund_validate_flag": q(
        _FILINGS,
        """SELECT symbol, period_end, CASE WHEN period_start > period_end THEN 'period starts after it ends' WHEN announcement_date < period_end THEN 'announced before the period ended' END AS rejection_reason,
        CAST(announcement_date - period_end AS INTEGER) AS lag_days, announcement_date - period_end > 180 AS is_backlog FROM preferred""",
    ),
    "fund_yoy": q(_FILINGS, f"SELECT symbol, quarter_end, {r('eps', 8)}, {r('sales', 2)}, {r('eps_yoy_growth')}, {r('sales_yoy_growth')} FROM grown"),
    "fund_latest": q(_FILINGS, f"SELECT symbol, quarter_end, {r('sales_yoy_growth')}, is_backlog_filing FROM grown QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY quarter_end DESC) = 1"),
    "universe_active": q(bars(), f"SELECT symbol, sector, {_KEY} % 2 = 0 AS is_active FROM universe UNION ALL SELECT 'NEW', NULL, TRUE"),
    "listing_date_sync": q(bars() + "," + _STAGED + "," + _SYNCED, "SELECT symbol, listing_date, changed FROM synced"),
    "listing_date_summary": q(
        bars() + "," + _STAGED + "," + _SYNCED,
        "SELECT count(*) FILTER (matched) AS matched_symbols, count(*) FILTER (changed) AS updated_symbols, count(*) FILTER (listing_date IS NULL) AS unmatched_universe_symbols FROM synced",
    ),
    "universe_merge": q(bars(), f"SELECT symbol, CASE WHEN {_KEY} % 8 = 0 THEN 'X' || symbol ELSE isin END AS isin, is_active FROM universe UNION ALL SELECT 'NEW', 'XNEW', FALSE"),
    "membership_insert_ignore": q(
        bars(), f"SELECT 'all' AS universe_name, symbol, DATE '1998-01-01' AS as_of_date, CASE WHEN {_KEY} % 3 = 0 THEN 'old' ELSE 'new' END AS source_url FROM universe WHERE is_active"
    ),
    "pending_backfill": q(
        bars(),
        f"""SELECT symbol FROM universe LEFT JOIN (SELECT symbol, max(date) AS last FROM raw_bars GROUP BY symbol) USING (symbol)
        WHERE is_active AND {_KEY} % 10 <> 9 AND (last IS NULL OR last < (SELECT max(date) FROM raw_bars))""",
    ),
    "upsert_merge": q(
        bars(), f"SELECT symbol, week_end_date, {r('close')}, CASE WHEN week_end_date >= DATE '1997-01-01' THEN volume * 2 ELSE volume END AS volume FROM raw_weeks"
    ),
    "replace_symbols": q(
        bars(), "SELECT symbol, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM raw_weeks WHERE symbol NOT IN ('S1', 'S2') OR week_end_date > DATE '1996-01-01' GROUP BY symbol"
    ),
    "dq_counts": q(
        bars(),
        """SELECT count(*) AS daily_rows, count(DISTINCT symbol) FILTER (listing_date IS NOT NULL) AS symbols_with_listing_date, count(DISTINCT symbol) FILTER (listing_date IS NULL) AS symbols_missing_listing_date,
        count(*) FILTER (low > least(open, close) OR high < greatest(open, close)) AS invalid_ohlc_rows, count(*) FILTER (least(open, high, low, close) < 0 OR volume < 0) AS negative_price_or_volume_rows,
        count(*) FILTER (volume = 0) AS zero_volume_rows FROM raw_bars LEFT JOIN universe USING (symbol)""",
    ),
    "dq_weekly_reconcile": q(bars(), "SELECT symbol, week_end_date FROM raw_weeks WHERE symbol IN ('S1', 'S2')"),
    "dq_missing_dates": q(bars() + _GAPS, "SELECT symbol, count(*) AS missing, min(date) AS first_missing, max(date) AS last_missing FROM gaps GROUP BY symbol"),
    "dq_missing_list": q(
        bars("nation") + _GAPS, "SELECT symbol, first_date, last_date, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS missing_dates, count(*) AS missing_date_count FROM gaps GROUP BY ALL"
    ),
    "dq_stale_runs": q(
        bars() + """,
    floors AS (SELECT symbol, date, floor(close / 10) AS close FROM raw_bars),
    marks AS (SELECT *, CASE WHEN close IS DISTINCT FROM lag(close) OVER (PARTITION BY symbol ORDER BY date) THEN 1 ELSE 0 END AS changed FROM floors),
    stale AS (SELECT *, sum(changed) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM marks)""",
        "SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS sessions FROM stale GROUP BY symbol, run HAVING count(*) > 10",
    ),
    "delta_start": q(
        bars(), "SELECT symbol, coalesce(CAST(last + 1 AS DATE), DATE '1990-01-01') AS from_date FROM universe LEFT JOIN (SELECT symbol, max(date) AS last FROM raw_bars GROUP BY symbol) USING (symbol) WHERE is_active"
    ),
    "latest_row_per_symbol": q(bars(), f"SELECT symbol, date, volume, {r('close')} FROM raw_bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"),
}

ORACLES |= {
    "candle_chunks": q(
        bars(),
        """SELECT symbol, CAST(listing_date + CAST(400 * k AS INTEGER) AS DATE) AS from_date, least(DATE '1998-12-31', CAST(listing_date + CAST(400 * k + 399 AS INTEGER) AS DATE)) AS to_date
        FROM (SELECT symbol, listing_date, unnest(range(0, (DATE '1998-12-31' - listing_date) // 400 + 1)) AS k FROM universe WHERE listing_date IS NOT NULL)""",
    ),
    "adjusted_close": q(
        bars(),
        """SELECT symbol, date, round(CASE WHEN dayofmonth(date) % 3 = 0 OR dayofmonth(date) % 5 = 0 THEN close ELSE adj_close END, 5) + 0.0E0 AS adj_close FROM raw_bars""",
    ),
    "filing_pages": """
SELECT 'n' || n_nationkey AS symbol, CASE WHEN n_nationkey % 3 = 0 THEN 'own' ELSE 'consolidated' END AS url, n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 1 AS is_consolidated,
  CAST(4 AS INTEGER) AS n_heads, CAST(4 AS INTEGER) AS n_lines FROM nation
""",
    "quarter_tables": """
WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 100 ELSE n_nationkey END AS v, n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 1 AS is_consolidated FROM nation)
SELECT 'N' || k AS symbol, DATE '2023-01-01' AS period_start, DATE '2023-03-31' AS period_end, DATE '2023-05-30' AS announcement_date, is_consolidated, TRUE AS is_audited,
  ((v + 1) * 1000 + 250) * 1e7 AS revenue, CAST(NULL AS DOUBLE) AS pat, k + 0.25E0 AS basic_eps, FALSE AS fields_missing FROM n
UNION ALL
SELECT 'N' || k, DATE '2023-04-01', DATE '2023-06-30', DATE '2023-08-14', is_consolidated, FALSE, 1000 * 1e7, -k * 1e7 + 0.0E0, NULL, FALSE FROM n
""",
    "filing_documents": q(
        _FILINGS,
        """SELECT symbol, period_start, period_end, announcement_date, is_consolidated, round(revenue, 2) + 0.0E0 AS revenue, round(basic_eps, 6) + 0.0E0 AS basic_eps, fields_missing, 'd' || arrival AS source_url
FROM filings WHERE arrival % 17 <> 3 AND arrival % 19 <> 3 AND arrival % 13 <> 5""",
    ),
    "fund_known": q(
        _FILINGS + _KNOWN.format(asked="SELECT DISTINCT symbol, announcement_date AS date FROM filings"),
        f"""SELECT symbol, date AS known_from, (SELECT min(announcement_date) FROM filings f WHERE f.symbol = l.symbol AND f.announcement_date > l.date) AS known_until, quarter_end, is_consolidated, {r('eps', 8)},
  {r('eps_yoy_growth')}, {r('sales_yoy_growth')}, quarters_known FROM latest_known l WHERE quarter_end IS NOT NULL""",
    ),
    "fund_as_of": q(
        bars("nation") + "," + _FILINGS.replace("sums AS", "filing_sums AS").replace("FROM sums", "FROM filing_sums") + _KNOWN.format(asked="SELECT symbol, date FROM adj"),
        f"SELECT symbol, date, {r('close')}, quarter_end, announcement_date, {r('eps', 8)}, {r('eps_yoy_growth')}, {r('sales_yoy_growth')} FROM adj LEFT JOIN latest_known USING (symbol, date)",
    ),
    "run_summaries": q(
        bars() + "," + daily() + "," + stages("daily_last") + "," + PATTERN + "," + _TODAYS_PIVOTS + "," + volumes("todays"),
        """SELECT 'stage' AS run, count(*) AS evaluated, count(*) FILTER (stage = 2) AS flagged FROM stages
        UNION ALL SELECT 'pattern', count(*), count(*) FILTER (is_vcp) FROM patterns UNION ALL SELECT 'volume', count(*), count(*) FILTER (volume_spike_near_pivot) FROM volumes""",
    ),
}

_THRESHOLDS = (None,) * 5 + (Trend().least_gain_from_low, Trend().most_decline_from_high, Trend().least_rating)
_MEASURED = (4, 3, 2, 3, 2, 3, 3, 1)
_UPDATED = _FILINGS.replace(
    "preferred AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY symbol, period_end ORDER BY is_consolidated DESC, arrival) = 1)",
    """early AS (SELECT * FROM filings WHERE announcement_date <= DATE '1995-06-30'),
    since AS (SELECT symbol, coalesce(max(early.announcement_date) + 1, DATE '1992-01-01') AS from_date FROM (SELECT DISTINCT symbol FROM filings) LEFT JOIN early USING (symbol) GROUP BY symbol),
    old AS (SELECT * FROM early QUALIFY row_number() OVER (PARTITION BY symbol, period_end ORDER BY is_consolidated DESC, arrival) = 1),
    new AS (
      SELECT filings.* FROM filings JOIN since USING (symbol) WHERE announcement_date BETWEEN from_date AND DATE '1996-12-31'
      QUALIFY row_number() OVER (PARTITION BY symbol, period_end ORDER BY is_consolidated DESC, arrival) = 1
    ),
    good AS (SELECT symbol, period_end FROM new WHERE period_start <= period_end AND announcement_date >= period_end),
    preferred AS (SELECT * FROM new UNION ALL SELECT old.* FROM old ANTI JOIN good USING (symbol, period_end))""",
)
_SUPPLIERS = "SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS key FROM supplier"

ORACLES |= {
    "bars_last_of_date": q(
        bars(),
        f"""SELECT symbol, date, {r("close * CASE WHEN dayofmonth(date) % 8 = 1 THEN 4 WHEN dayofmonth(date) % 4 = 1 THEN 2 ELSE 1 END", name="close")},
        volume + CASE WHEN dayofmonth(date) % 6 = 2 AND dayofmonth(date) % 4 <> 1 THEN 1 ELSE 0 END AS volume FROM raw_bars""",
    ),
    "vcp_contractions_json": q(
        bars() + "," + PATTERN,
        f"SELECT symbol, place, start_date, low_date, {r('start_high')}, {r('low')}, {r('depth_fraction')}, {r('average_volume')} FROM sequence",
    ),
    "vcp_swings_json": q(bars() + "," + PATTERN, f"SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY i, date, kind) AS INTEGER) AS place, i, date, kind, {r('price')} FROM swings"),
    "trend_explained": q(
        _STRENGTH_BARS + "," + daily("adj", "daily", "ratings"),
        " UNION ALL ".join(
            f"SELECT symbol, date, '{c}' AS key, {c} AS passed, CAST({'NULL' if t is None else t} AS DOUBLE) AS threshold, {m} AS n_measured FROM daily_last"
            for c, t, m in zip(CRITERIA, _THRESHOLDS, _MEASURED, strict=True)
        ),
    ),
    "fund_due": q(_UPDATED, "SELECT symbol, period_end, announcement_date, arrival FROM new"),
    "fund_upsert": q(_UPDATED, f"SELECT symbol, quarter_end, {r('eps', 8)}, {r('eps_yoy_growth')}, {r('sales_yoy_growth')} FROM grown"),
    "listing_constituents": f"SELECT DISTINCT 'S' || CASE WHEN k % 7 = 0 THEN '1' ELSE key END AS symbol FROM ({_SUPPLIERS})",
    "listing_master": f"SELECT 'S' || key AS symbol, CAST(DATE '1992-01-01' + CAST(k * 37 % 900 AS INTEGER) AS DATE) AS listing_date FROM ({_SUPPLIERS}) WHERE k % 3 < 2",
    "listing_custom": f"SELECT 'S' || key AS symbol FROM ({_SUPPLIERS}) WHERE k % 4 <> 0 AND k % 9 <> 0",
    "listing_instruments": f"SELECT 'S' || key AS symbol, key AS provider_instrument_id, 'EQ' AS instrument_type FROM ({_SUPPLIERS}) WHERE k % 5 <> 0 AND k % 3 <> 0",
    "candle_archive": q(bars("nation"), "SELECT symbol, count(*) AS n, max(date) AS last, CAST(sum(volume) AS BIGINT) AS volume FROM raw_bars GROUP BY symbol"),
    "delta_requests": q(
        bars(),
        """SELECT symbol, coalesce(CAST(max(b.date) + 1 AS DATE), DATE '1992-01-01') AS from_date FROM (SELECT symbol FROM universe WHERE is_active AND CAST(substr(symbol, 2) AS INTEGER) % 4 <> 1)
        LEFT JOIN (SELECT symbol, date FROM raw_bars WHERE CAST(substr(symbol, 2) AS INTEGER) % 3 <> 0) b USING (symbol) GROUP BY symbol HAVING from_date <= DATE '1998-11-20'""",
    ),
    "run_summaries_rated": q(
        _SCORED,
        "SELECT 'strength' AS run, count(*) AS evaluated, count(DISTINCT symbol) AS flagged FROM ratings UNION ALL SELECT 'score', count(*), count(*) FILTER (gate_passed) FROM scores",
    ),
}
