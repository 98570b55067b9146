"""The composite score: weighted parts from 0 to 100, renormalised over those that were evaluated, and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.config import Contraction, Score
from barlens.operators.bars import latest_date, latest_per_symbol
from barlens.operators.trend import CRITERIA

PARTS = ("trend", "stage", "strength", "contraction", "volume", "fundamentals")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)).cast("int")


def assemble(
    daily: DataFrame, weekly: DataFrame | None, stages: DataFrame | None, ratings: DataFrame | None, patterns: DataFrame | None, volumes: DataFrame | None, as_of: str = "global"
) -> DataFrame:
    """One row per symbol of daily (or weekly) templates with what the parts need. as_of: take the stored
    parts at their greatest date of all (global), where symbols that lag behind lack them, or per_symbol."""
    if as_of not in ("global", "per_symbol"):
        raise ValueError("as_of must be global or per_symbol")
    pick = latest_date if as_of == "global" else latest_per_symbol

    def part(frame: DataFrame | None, columns: dict[str, str], mark: str) -> DataFrame | None:
        if frame is None:
            return None
        return pick(frame).select("symbol", *(F.col(c).alias(n) for c, n in columns.items()), F.lit(True).alias(mark))

    rows = daily.select("symbol", F.col("date").alias("daily_date"), F.col("pass_rate").alias("daily_rate"), F.col("passed_count").alias("daily_passed"), F.col("evaluated_count").alias("daily_evaluated"))
    joined = [
        weekly.select("symbol", F.col("date").alias("weekly_date"), F.col("pass_rate").alias("weekly_rate")) if weekly is not None else None,
        part(stages, {"stage": "stage"}, "has_stage"),
        part(ratings, {"rating": "rating", "rs_line_new_high": "rs_line_new_high"}, "has_rating"),
        part(patterns, {c: c for c in ("contraction_count", "depth_decay_passed", "volume_decay_passed", "base_length_passed", "daily_confirmation_available", "near_pivot", "tight_closes_confirmed", "breakout_confirmed", "quality_grade")}, "has_pattern"),
        part(volumes, {c: c for c in ("up_down_volume_ratio", "accumulation_distribution_rising", "volume_spike_near_pivot")}, "has_volume"),
    ]
    empty = (
        "weekly_date date, weekly_rate double", "stage int, has_stage boolean", "rating int, rs_line_new_high boolean, has_rating boolean",
        "contraction_count int, depth_decay_passed boolean, volume_decay_passed boolean, base_length_passed boolean, daily_confirmation_available boolean, near_pivot boolean, "
        "tight_closes_confirmed boolean, breakout_confirmed boolean, quality_grade string, has_pattern boolean",
        "up_down_volume_ratio double, accumulation_distribution_rising boolean, volume_spike_near_pivot boolean, has_volume boolean",
    )
    for k, frame in enumerate(joined):
        if frame is not None:
            rows = rows.join(frame, "symbol", "full" if k == 0 else "left")
        else:
            rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in (x.split() for x in empty[k].split(", "))})
    return rows


def components(rows: DataFrame, config: Score = Score(), pattern: Contraction = Contraction()) -> DataFrame:
    """The score of each part (null if not evaluated) and the gates, for rows as of assemble()."""
    rates = F.array_compact(F.array("daily_rate", "weekly_rate"))
    trend = F.aggregate(rates, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(rates), F.lit(0)) * 100
    stage_points = F.coalesce(F.create_map(*(F.lit(x) for kv in config.stage_scores.items() for x in kv))[F.col("stage")], F.lit(0.0))
    strength = F.least(F.col("rating") + F.when(F.coalesce("rs_line_new_high", F.lit(False)), config.new_high_bonus).otherwise(0.0), F.lit(100.0))
    count_ok = F.coalesce(F.col("contraction_count").between(pattern.min_contractions, pattern.max_contractions), F.lit(False)).cast("int")
    structure = (_flag("depth_decay_passed") + _flag("volume_decay_passed") + _flag("base_length_passed") + count_ok) / 4.0 * 100
    confirmation = F.when(F.coalesce("daily_confirmation_available", F.lit(False)), (_flag("near_pivot") + _flag("tight_closes_confirmed") + _flag("breakout_confirmed")) / 3.0 * 100).otherwise(50.0)
    low, high = config.ratio_floor, config.ratio_ceiling
    clipped = F.least(F.greatest(F.col("up_down_volume_ratio"), F.lit(low)), F.lit(high))
    ratio = F.when(F.col("up_down_volume_ratio").isNull() | F.lit(high <= low), 50.0).otherwise((clipped - low) / F.lit((high - low) or 1.0) * 100)
    volume = F.least(ratio + config.accumulation_bonus * _flag("accumulation_distribution_rising") + config.spike_bonus * _flag("volume_spike_near_pivot"), F.lit(100.0))
    return rows.withColumns(
        {
            "trend_score": trend,
            "stage_score": F.when(F.col("stage").isNotNull(), stage_points),
            "strength_score": F.when(F.col("rating").isNotNull(), strength),
            "contraction_score": F.when(F.col("has_pattern"), structure * config.structure_weight + confirmation * config.confirmation_weight),
            "volume_score": F.when(F.col("has_volume"), volume),
            "fundamentals_score": F.lit(None).cast("double"),
            "gate_trend": F.coalesce((F.col("daily_evaluated") == len(CRITERIA)) & (F.col("daily_passed") >= config.gate_passes), F.lit(False)),
            "gate_strength": F.coalesce(F.col("rating") >= config.gate_rating, F.lit(False)),
        }
    )


def combine(scored: DataFrame, config: Score = Score()) -> DataFrame:
    """Rows as stored: the weighted mean of the evaluated parts to two digits (0 if none was), and the gate."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for p in PARTS:
        total = total + F.coalesce(F.col(f"{p}_score") * config.weights[p], F.lit(0.0))
        weight = weight + F.when(F.col(f"{p}_score").isNotNull(), config.weights[p]).otherwise(0.0)
    composite = F.coalesce(F.bround(total / F.nullif(weight, F.lit(0.0)), 2), F.lit(0.0))
    names = {"trend": "trend_template", "stage": "stage", "strength": "relative_strength", "contraction": "vcp", "volume": "volume", "fundamentals": "fundamentals"}
    parts = [c for p, n in names.items() for c in (F.col(f"{p}_score").alias(f"{n}_score"), F.col(f"{p}_score").isNotNull().alias(f"{n}_evaluated"))]
    date = F.coalesce("daily_date", "weekly_date")
    return scored.filter(date.isNotNull()).select(
        "symbol", date.alias("date"), composite.alias("composite_score"), (F.col("gate_trend") & F.col("gate_strength")).alias("gate_passed"), F.col("gate_trend").alias("gate_trend_template_passed"),
        F.col("gate_strength").alias("gate_relative_strength_passed"), *parts, "quality_grade", "stage", F.col("rating").alias("relative_strength_rating"),
    )


def ranked(scores: DataFrame) -> DataFrame:
    """Scores of the latest date, those that pass the gate first, then by score and symbol."""
    return latest_date(scores).orderBy(F.desc("gate_passed"), F.desc("composite_score"), "symbol")
