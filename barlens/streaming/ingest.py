"""Bars that arrive as a stream: micro-batches go through the same checks and upserts as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barlens.catalog import Catalog
from barlens.operators import bars as B
from barlens.plans.runs import resample
from barlens.sources import candles

RAW = "symbol string, date string, open double, high double, low double, close double, volume bigint, adj_close double, seq bigint"


def bars_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Bars of JSON files that appear in a folder; seq orders what arrives for one symbol and date."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(path)


def into_catalog(stream: DataFrame, catalog: Catalog, checkpoint: str, source: str = "stream", available_now: bool = True) -> StreamingQuery:
    """Upserts each micro-batch by key and derives the weeks it touches anew; a batch that is repeated after
    a failure changes nothing more, so that each bar counts once. Of what arrives for one symbol and date, in
    whichever batch and order, the greatest seq stays: the seq of each stored bar is kept beside it, written after the bar."""

    def write(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in ("symbol", "date")]
        last = batch.groupBy("symbol", "date").agg(F.max_by(F.struct(*rest), F.coalesce("seq", F.lit(-1))).alias("r")).select("symbol", "date", "r.*")
        with catalog.staged(last.withColumn("_day", F.to_date("date"))) as rows:
            known = catalog.read("stream_seqs", [str(y) for (y,) in rows.select(F.year("_day")).distinct().collect()])
            newer = rows.join(known.select("symbol", F.col("date").alias("_day"), F.col("seq").alias("_known")), ["symbol", "_day"], "left")
            newer = newer.filter("_known is null or seq > _known").drop("_known", "_day")
            accepted, _notes = B.split_valid(candles.normalised(newer).join(newer.select("symbol", F.to_date("date").alias("date"), "seq"), ["symbol", "date"]))
            with catalog.staged(B.with_adjusted_close(accepted).withColumn("source", F.lit(source))) as staged:
                if not staged.isEmpty():
                    catalog.upsert("ohlcv_daily", staged)
                    resample(catalog, staged.select("symbol").distinct())
                    catalog.upsert("stream_seqs", staged.select("symbol", "date", "seq"))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def weekly_stream(stream: DataFrame, late: str = "14 days") -> DataFrame:
    """Weekly bars as a windowed aggregation with a watermark, for streams whose weeks need no table."""
    timed = stream.withColumn("at", F.to_timestamp("date")).withWatermark("at", late)
    # windows of a week begin on a Thursday in epoch time; Monday is four days on
    week = F.window("at", "7 days", "7 days", "4 days")
    return timed.groupBy("symbol", week.alias("w")).agg(
        F.min_by("open", "at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "at").alias("close"), F.sum("volume").alias("volume")
    ).select("symbol", F.date_add(F.col("w.start").cast("date"), 4).alias("week_end_date"), "open", "high", "low", "close", "volume")
