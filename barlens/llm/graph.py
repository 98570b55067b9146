"""Connected components of a graph of links, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import cut, spread_join


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours. Aggregated before it is joined, so that a node
    with very many neighbours makes no large group; the join's large keys are split at run time."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return spread_join(links, least, ["u"])


def components(links: DataFrame) -> DataFrame:
    """Returns (node, root) for each node of links (columns a and b, of one orderable type, not null):
    root is the least node that can be reached. Repeated links, both directions and self-links may occur;
    an empty table gives an empty table."""
    edges = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = _with_least(large)
        small = stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(stars.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
