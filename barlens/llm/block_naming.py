"""Exact deduplication by deterministic block naming (Karp, Miller and Rosenberg's way to name repeats).

A normalised text is cut into blocks of fixed size. All distinct blocks are sorted, and a block's place in
that order is its integer name. Then neighbouring names are taken in pairs, distinct pairs are sorted and
named by their places in the same way, and so on until each document has one name; together with its number
of blocks that is its identity. Names are 0, 1, 2, ... over the whole table and depend on nothing but the
texts: they are the same however many partitions there are.

Blocks are sorted by a 128-bit key. That no two distinct blocks share one is checked over all blocks, and
another salt is taken if two do, so that equal identities mean equal texts, never just equal hashes. Only
distinct blocks are shuffled with their contents, once, and after a partial aggregation; sorting and finding
the names of a row's blocks take the keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import ascii_lower, cut, fresh, semi, spread_join

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as empty. lower() is the same for texts of ASCII only, and much faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


def _named(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct rows with their place in the order of keys over the whole frame: ranges of keys are sorted each in
    a task of its own, and the number of rows before a range is added to the places in it. Only these numbers,
    one for each task, are summed in one place."""
    placed = cut(
        distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    )
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def _block_key(block: Column, salt: int) -> list[Column]:
    return [F.xxhash64(block, F.lit(salt)).alias("k1"), F.xxhash64(F.lit(salt), F.lit("key"), block).alias("k2")]


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Returns one row per input row: row (a number of this row), the id column, text_sha256 (binary, of the
    normalised text), n_blocks and name; (n_blocks, name) is equal exactly where normalised texts are equal.

    Null and empty texts are one block of no bytes. Null ids are kept. Repeated rows are rows of their own.
    Other columns of docs are not read.
    """
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    count = F.greatest(F.ceil(F.octet_length("t") / F.lit(float(block_bytes))), F.lit(1)).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("b"), i * block_bytes + F.lit(1), F.lit(block_bytes))
    )
    cut_up = text.select(
        "id", F.monotonically_increasing_id().alias("row"), F.encode("t", "UTF-8").alias("b"), count.alias("n")
    )
    contents = cut_up.select(F.explode(cells).alias("block")).groupBy("block").agg(F.lit(1).alias("one"))
    salt = 0
    while True:
        block_keys = cut(contents.select(*_block_key(F.col("block"), salt)))
        if block_keys.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
            break
        salt += 1
    names = _named(block_keys, ["k1", "k2"], "name")
    # a text is hashed once, and its digest stands beside its first block only
    hashed = cut_up.withColumn("sha", F.unhex(F.sha2("b", 256))).select("id", "row", "n", "sha", F.posexplode(cells).alias("pos", "block"))
    places = cut(hashed.select("id", "row", "n", F.when(F.col("pos") == 0, F.col("sha")).alias("text_sha256"), "pos", *_block_key(F.col("block"), salt)))
    state = cut(places.join(names.hint("shuffle_merge"), ["k1", "k2"]).select("row", "n", "pos", "name"))
    heads = places.filter("pos = 0").select("row", "id", "text_sha256")
    done = [state.filter("n = 1").select("row", "n", "name")]
    width = 1
    longest = places.agg(F.max("n")).first()[0] or 1
    while width < longest:
        # those whose names now cover the whole text are done; the others go on in pairs
        pairs = cut(
            state.filter(F.col("n") > width)
            .groupBy("row", "n", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        named = _named(pairs.groupBy("left", "right").agg(F.lit(1).alias("one")), ["left", "right"], "name").drop("one")
        width *= 2
        state = cut(spread_join(pairs, named, ["left", "right"]).select("row", "n", "pos", "name"))
        done.append(state.filter((F.col("n") <= width)).select("row", "n", "name"))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return heads.join(whole, "row").select(
        "row", F.col("id").alias(id_col), "text_sha256", F.col("n").alias("n_blocks"), "name"
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Returns one row per input row: the id column, keep_id, group_size (long), kept and text_sha256.

    Of equal texts (identical after lower-casing A-Z; null counts as empty) the row with the largest id
    stays, of rows that repeat that id just one; a null id is smaller than any. Empty table: empty result.
    """
    named = cut(identities(docs, id_col, text_col, block_bytes).withColumn("_order", F.struct(F.col(id_col).alias("id"), (-F.col("row")).alias("order"))))
    best = named.groupBy("n_blocks", "name").agg(F.max("_order").alias("_best"), F.count(F.lit(1)).alias("group_size"))
    return spread_join(named, best, ["n_blocks", "name"]).select(
        F.col(id_col),
        F.col("_best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("_best.order")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that groups() drops, with all their columns. Of rows that repeat an id and
    its normalised text, one stays; rows with a null id stay if no other row has their text."""
    found = cut(groups(docs, id_col, text_col, block_bytes))
    per_id = found.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("kept").cast("int")).alias("kept"))
    mixed = cut(per_id.filter(F.col(id_col).isNull() | (F.col("rows") > 1)).select(id_col))
    dropped = cut(per_id.filter(F.col(id_col).isNotNull() & (F.col("rows") == 1) & (F.col("kept") == 0)).select(id_col))
    simple = semi(docs, dropped, id_col, dropped.count(), "left_anti")
    n_mixed = mixed.count()
    if not n_mixed:
        return simple
    plain = semi(simple, mixed, id_col, n_mixed, "left_anti").filter(F.col(id_col).isNotNull())
    # ids that several rows have, or none: decided by id and text together, in columns of names that docs doesn't have
    its_id, its_sha, own_id, own_sha = fresh(docs, "its_id", "its_sha", "own_id", "own_sha")
    keys = found.filter("kept").select(F.col(id_col).alias(its_id), F.col("text_sha256").alias(its_sha))
    mixed = mixed.select(F.col(id_col).alias(own_id))
    keys = keys.join(mixed, F.col(its_id).eqNullSafe(F.col(own_id)), "left_semi")
    repeated = docs.withColumn(own_sha, F.sha2(normalised(F.col(text_col)), 256))
    repeated = repeated.join(keys, F.col(its_id).eqNullSafe(F.col(id_col)) & (F.col(its_sha) == F.col(own_sha)), "left_semi")
    return plain.unionByName(repeated.dropDuplicates([id_col, own_sha]).drop(own_sha))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
