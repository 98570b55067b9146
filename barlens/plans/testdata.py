"""Bars, a universe and filings derived from the TPC-H-like tables: integer-exact geometric walks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlens.operators.bars import last_bar

SPLIT_DATE = "1995-06-17"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column, digits: int) -> Column:
    """As DuckDB rounds doubles: what is scaled is rounded, and kept as it is where scaling overflows."""
    scaled = value * float(10**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / float(10**digits)).otherwise(value)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads again, in the place that executors share; only a local
    session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='barlens-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bars(spark: SparkSession, sf_dir: str, market: str = "supplier") -> DataFrame:
    """Daily bars, of supplier (S and key) or nation (N and key) symbols; every seventh had a split of two to one."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_discount", "l_tax", "l_quantity")
    if market == "nation":
        nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        keyed = li.join(nation, "l_suppkey").withColumn("symbol", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))
    else:
        keyed = li.withColumn("symbol", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    tax = F.round(F.col("l_tax") * 100).cast("bigint")
    days = keyed.groupBy("symbol", "date").agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint") - 5).alias("k"), F.max(tax).alias("tx"), F.min(tax).alias("tn"), F.sum("l_quantity").cast("bigint").alias("volume")
    )
    steps = F.sum("k").over(last_bar().rowsBetween(Window.unboundedPreceding, 0))
    p = days.withColumn("ck", steps).select(
        "symbol", "date", rounded(100 * F.exp(0.004 * (F.col("ck") - F.col("k"))), 4).alias("open"), rounded(100 * F.exp(0.004 * F.col("ck")), 4).alias("close"), "tx", "tn", "volume"
    )
    split = (F.substring("symbol", 2, 10).cast("int") % 7 == 0) & (F.col("date") < F.lit(SPLIT_DATE).cast("date"))
    return p.select(
        "symbol", "date", "open", (F.greatest("open", "close") * (1 + F.col("tx") / 1000.0)).alias("high"), (F.least("open", "close") * (1 - F.col("tn") / 1000.0)).alias("low"), "close", "volume",
        F.when(split, F.col("close") / 2).otherwise(F.col("close")).alias("adj_close"),
    )


def universe(spark: SparkSession, sf_dir: str, market: str = "supplier") -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    if market == "nation":
        return places.select(
            F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("symbol"), F.lit(None).cast("string").alias("isin"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"),
            F.lit(None).cast("date").alias("listing_date"), F.lit(True).alias("is_active"),
        )
    key = F.col("s_suppkey")
    listed = F.when(key % 5 != 0, F.date_add(F.lit("1992-01-01").cast("date"), (key * 37 % 900).cast("int")))
    return table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("S"), key.cast("string")).alias("symbol"), F.concat(F.lit("IN"), key.cast("string")).alias("isin"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"),
        listed.alias("listing_date"), (F.col("s_acctbal") > 0).alias("is_active"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly filings of N and nation key: orders of a nation by quarter and status. Some are consolidated,
    some lack their fields, some are announced before the period's end or long after it."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    quarter = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate").cast("date"), 2))
    sums = orders.groupBy("c_nationkey", quarter.alias("period_end"), "o_orderstatus").agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("arrival")
    )
    gap = (F.col("arrival") % 250).cast("int") - 5
    missing = F.col("arrival") % 11 == 0
    return sums.select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("symbol"), F.date_add(F.last_day(F.add_months("period_end", -3)), 1).alias("period_start"), "period_end",
        F.date_add("period_end", gap).alias("announcement_date"), (F.col("o_orderstatus") == "F").alias("is_consolidated"),
        F.when(~missing, F.col("cents") / 100.0).alias("revenue"), F.when(~missing, F.col("cents") / (F.col("n") * 1000.0)).alias("basic_eps"),
        F.lit("orders").alias("source"), missing.alias("fields_missing"), F.lit(False).alias("announcement_date_is_estimated"), "arrival",
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions of supplier symbols: splits, bonuses, dividends, two on one date, and one that can't be read."""
    key, day = F.col("s_suppkey"), lambda start, step: F.date_add(F.lit(start).cast("date"), (F.col("s_suppkey") * step % 97).cast("int"))
    every = table(spark, sf_dir, "supplier")
    parts = [
        every.filter(key % 7 == 0).select(key, F.lit(SPLIT_DATE).cast("date").alias("ex_date"), F.lit("Split").alias("action_type"), F.lit("2:1").alias("ratio")),
        every.filter(key % 5 == 0).select(key, day("1996-03-01", 3), F.lit("bonus"), F.lit("1:2")), every.filter(key % 3 == 0).select(key, day("1994-05-02", 5), F.lit("dividend"), F.lit("1.5")),
        every.filter(key % 10 == 0).select(key, day("1996-03-01", 3), F.lit("split"), F.lit("5:2")), every.filter(key % 4 == 0).select(key, day("1997-01-07", 2), F.lit("split"), F.lit("none")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), "ex_date", "action_type", "ratio")


def unadjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose closes stand on the scale of their own time: those before the splits and bonuses of actions() are
    higher, and those of every thirteenth symbol before a split that no action tells of."""
    key = F.substring("symbol", 2, 10).cast("int")
    start = F.date_add(F.lit("1996-03-01").cast("date"), (key * 3 % 97).cast("int"))
    scale = F.when((key % 7 == 0) & (F.col("date") < SPLIT_DATE), 2.0).otherwise(1.0) * F.when((key % 5 == 0) & (F.col("date") < start), 1.5).otherwise(1.0)
    scale = scale * F.when((key % 10 == 0) & (F.col("date") < start), 2.5).otherwise(1.0) * F.when((key % 13 == 0) & (F.col("date") < "1997-06-16"), 10.0).otherwise(1.0)
    return bars(spark, sf_dir).select("symbol", "date", (F.col("close") * scale).alias("close"), "volume")
