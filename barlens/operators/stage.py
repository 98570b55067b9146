"""The four market stages, by the first rule that holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.config import Stage
from barlens.operators.bars import above


def classify(template: DataFrame, config: Stage = Stage()) -> DataFrame:
    """Rows of the trend template with a stage; rows whose inputs are missing have none and are left out."""
    price, s, m, lng = (F.col(c) for c in ("close", "ma_short", "ma_medium", "ma_long"))
    slope = (lng - F.col("ma_long_prior")) / F.nullif(F.col("ma_long_prior"), F.lit(0.0))
    falling_or_flat = F.col("ma_long_slope") <= config.flat_slope
    stage = (
        F.when(above(price, s) & above(s, m) & above(m, lng) & (F.col("ma_long_slope") > config.flat_slope) & (F.col("technical_passes") >= config.least_passes), 2)
        .when(above(s, price) & above(m, s) & above(lng, m) & (F.col("ma_long_slope") < -config.flat_slope), 4)
        .when((above(s, price) & (falling_or_flat | ~above(s, m))) | (~above(s * (1 + config.extended), price) & falling_or_flat), 3)
        .otherwise(1)
    )
    known = price.isNotNull() & s.isNotNull() & m.isNotNull() & lng.isNotNull() & F.col("ma_long_slope").isNotNull()
    return (
        template.withColumn("ma_long_slope", slope)
        .filter(known)
        .select("symbol", "date", stage.alias("stage"), price.alias("price"), "ma_short", "ma_medium", "ma_long", "ma_long_slope", F.col("technical_passes").alias("trend_template_passes"))
    )
