"""Benchmark decontamination: a size-partitioned MinHash containment search, verified exactly.

Test items are short and documents long, so that their Jaccard similarity says little; what matters is the
share of an item's shingles that a document contains. Items are partitioned by their number q of distinct
shingles, so that all sizes of a partition may miss the same number of shingles at the threshold. Each partition
has its own search: its sketches are the m shingles of least hash of each item (bottom-m MinHash), m being one
more than may be missing, and only documents of as many words as its smallest item needs are held against them. By the pigeonhole principle a document that contains the required share of an item contains a
shingle of its sketch, so that the search misses nothing. In the order of hashes, shingles that several items
share come last: what is common to many tells little and makes candidates of them all.

What leaves the scan of documents are the hashes that stand in some sketch. Few of these are broadcast; beyond
a bound a bitmap of fixed size is broadcast instead, whose false positives the next join drops, so that documents
are read and hashed once however many items there are. Candidates, pairs of a document and an item, are then
verified by the exact containment of shingles as strings, each pair by the item's own shingles.

Only DataFrame functions are used. Shingles are hashed within each document's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import BROADCAST_BYTES, cut, semi

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: Bytes that a broadcast hash, and one in a row with its item and shingle, take at most on an executor.
HASH_BYTES, SHINGLE_BYTES = 64, 512
#: Bits of the bitmap of hashes, as a power of two (2^26 are 8 MiB), and of its rows of 64-bit words.
BITMAP_BITS, ROW_BITS = 26, 15
NOT_IN_WORDS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_IN_WORDS), "")


def _shingles(w: str, size: int, make) -> Column:
    """make(list of word columns) for each run of size words of array column w; none if it is shorter."""
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: make([F.get(F.col(w), i + j) for j in range(size)]))


def _hashes(w: str, size: int) -> Column:
    return _shingles(w, size, lambda run: F.xxhash64(*run))


def _strings(w: str, size: int) -> Column:
    return F.array_distinct(_shingles(w, size, lambda run: F.concat_ws(" ", *run)))


def item_shingles(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(item, unnamed, q, n_sizes, size, shingle, h): the distinct shingles of each item. An item of fewer words than a shingle
    has its whole sequence as its only one (size is its number of words); one without words has none.
    Rows that repeat an item's id count as one item with the shingles of all of them. A row without an id is an
    item of its own: unnamed, null for the others, is the SHA-256 of its text."""
    text = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    cut_up = benchmark.select(F.col(id_col).alias("item"), F.when(F.col(id_col).isNull(), text).alias("unnamed"), words(F.col(text_col)).alias("w"))
    parts = []
    for size in range(1, shingle_words + 1):
        own = F.size("w") == size if size < shingle_words else F.size("w") >= size
        row = F.struct(F.concat_ws(" ", *(F.col("s")[j] for j in range(size))).alias("shingle"), F.xxhash64(*(F.col("s")[j] for j in range(size))).alias("h"))
        of_size = cut_up.filter(own).select("item", "unnamed", F.explode(_shingles("w", size, lambda run: F.array(*run))).alias("s"))
        parts.append(of_size.select("item", "unnamed", F.lit(size).alias("size"), row.alias("r")).select("item", "unnamed", "size", "r.*"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.distinct()
    counts = every.groupBy(F.col("item").alias("i"), F.col("unnamed").alias("u")).agg(F.count(F.lit(1)).alias("q"), F.countDistinct("size").alias("n_sizes"))
    return every.join(counts, F.col("item").eqNullSafe(F.col("i")) & F.col("unnamed").eqNullSafe(F.col("u"))).drop("i", "u")


def partitions(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The items' shingles with part (as many shingles as sizes of this partition may miss), m (the length of its
    sketches) and least (the fewest words that a document must have to hold any of its items)."""
    needed = F.ceil(F.col("q") * threshold - 1e-9)
    # n words have n - size + 1 places for shingles of one size; rows that repeat an item's id may give it several sizes
    words_ = F.when(F.col("n_sizes") == 1, needed + F.col("size") - 1).otherwise(F.ceil(needed / F.col("n_sizes")))
    parted = shingles.withColumn("part", F.col("q") - needed)
    of_part = parted.groupBy("part").agg(F.min(words_).alias("least")).withColumn("m", F.col("part") + 1)
    return parted.join(of_part, "part")


def sketches(parted: DataFrame) -> DataFrame:
    """(item, unnamed, part, least, shingle, h): the m least hashes of each item, those that fewer items have before others."""
    shared = parted.groupBy(F.col("h").alias("shared_h")).agg(F.count(F.lit(1)).alias("n_items"))
    ordered = parted.join(shared, F.col("h") == F.col("shared_h")).withColumn("n_items", F.floor(F.log2("n_items")))
    rank = F.row_number().over(Window.partitionBy("item", "unnamed").orderBy("n_items", "h", "shingle"))
    return ordered.withColumn("k", rank).filter("k <= m").select("item", "unnamed", "part", "least", "shingle", "h").distinct()


def _bitmap(hashes: DataFrame) -> DataFrame:
    """(bits_row, bits): a bit for the lowest BITMAP_BITS bits of each hash (column h), in rows of 64-bit words. At most
    2^(BITMAP_BITS - ROW_BITS) rows, of 2^ROW_BITS bits each, however many hashes there are."""
    words_a_row = 1 << (ROW_BITS - 6)
    at = F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    words_ = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    rows = words_.groupBy(F.shiftright("word", ROW_BITS - 6).alias("bits_row")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(words_a_row - 1)).cast("int").alias("word"), "bits"))).alias("some")
    )
    return rows.select("bits_row", F.transform(F.sequence(F.lit(0), F.lit(words_a_row - 1)), lambda i: F.coalesce(F.try_element_at("some", i), F.lit(0))).alias("bits"))


def hits(text: DataFrame, sketch: DataFrame, sizes: list[int]) -> DataFrame:
    """(none, known), distinct: the texts (columns none, known and w, its words) that hold a shingle of the sketch of a
    partition for which they are long enough, by hash."""
    hashed = text.select("none", "known", F.size("w").alias("n"), F.explode(F.concat(*(_hashes("w", s) for s in sizes))).alias("h"))
    asked = cut(sketch.groupBy("h").agg(F.min("least").alias("words")))
    if asked.count() * HASH_BYTES < BROADCAST_BYTES:
        asked = F.broadcast(asked)
    else:
        in_row = F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
        held = hashed.withColumn("bits_row", F.shiftright(in_row, ROW_BITS)).join(F.broadcast(_bitmap(asked)), "bits_row")
        word = F.get("bits", F.shiftright(in_row, 6).bitwiseAND(F.lit((1 << (ROW_BITS - 6)) - 1)).cast("int"))
        hashed = held.withColumn("word", word).filter("shiftrightunsigned(word, cast(h & 63 as int)) & 1 = 1").select("none", "known", "n", "h").distinct()
        asked = asked.hint("shuffle_merge")
    return hashed.join(asked, "h").filter("n >= words").select("none", "known").distinct()


def _keyed(column: str) -> tuple[Column, Column]:
    """What an id is compared by, of any type and null: whether it is null, and itself as text."""
    return F.col(column).isNull().alias("none"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("known")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    shingle_words: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Returns a row for each document and item of whose distinct shingles the document contains the share
    threshold or more: the id columns, n_found and n_shingles (long) and containment (double).

    Null texts and texts without words contain nothing and leak nowhere. Of rows that repeat a doc_id, that
    with the most shingles of the item counts, in one row. A null id is kept as an id of its own. Ids may be of any
    type that casts to text. Items without an id are searched like others, each text being an item, and have a row each
    with a null item. An empty table on either side gives an empty result. Other columns are not read.
    """
    parted = cut(partitions(item_shingles(benchmark, item_col, "text", shingle_words), threshold))
    # items by number, as ids may be null: one row for each item
    numbered = cut(parted.select("item", "unnamed", "q").distinct().withColumn("number", F.monotonically_increasing_id()))
    same = F.col("item").eqNullSafe(F.col("i")) & F.col("unnamed").eqNullSafe(F.col("u"))
    number = numbered.select(F.col("item").alias("i"), F.col("unnamed").alias("u"), "number")
    items = cut(parted.join(number, same).select("number", "size", "shingle"))
    sketch = cut(sketches(parted).join(number, same).select("number", "least", "shingle", "h"))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect()) or [shingle_words]  # no more than shingle_words values
    ids = cut(hits(docs.select(*_keyed(id_col), words(F.col(text_col)).alias("w")), sketch, sizes))
    keyed = docs.select(F.col(id_col).alias("id"), *_keyed(id_col), F.col(text_col).alias("text"))
    hit = semi(keyed, ids, ["none", "known"], ids.count())
    hit = hit.select(F.monotonically_increasing_id().alias("row"), "id", words(F.col("text")).alias("w"))
    strings = hit.select("row", "id", F.size("w").alias("n"), F.explode(F.concat(*(_strings("w", s) for s in sizes))).alias("shingle"))
    distinct = cut(items.select("shingle").distinct())
    known = F.broadcast(distinct) if distinct.count() * SHINGLE_BYTES < BROADCAST_BYTES else distinct.hint("shuffle_merge")
    # only shingles of items stay, so that what is written is small
    held = cut(strings.join(known, "shingle", "left_semi"))
    # a candidate is a row and an item of whose sketch it holds a shingle; it then asks for the item's own shingles
    pairs = held.join(sketch.hint("shuffle_merge"), "shingle").filter("n >= least").select("row", "number").distinct()
    asked = pairs.join(items.select("number", "shingle").hint("shuffle_merge"), "number").select("row", "number", "shingle")
    counted = (
        held.select("row", "id", "shingle").join(asked.hint("shuffle_merge"), ["row", "shingle"])
        .groupBy("row", "id", "number").agg(F.count(F.lit(1)).alias("found"))
        .groupBy("id", "number").agg(F.max("found").alias("found"))
    )
    verified = counted.join(numbered, "number").filter(F.col("found") >= F.col("q") * threshold - 1e-9)
    return verified.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        F.col("found").alias("n_found"),
        F.col("q").alias("n_shingles"),
        (F.col("found") / F.col("q")).alias("containment"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that leak an item of benchmark, with all their columns; rows without an id stay."""
    leaked = cut(leaks(docs, benchmark, id_col, text_col).filter(F.col(id_col).isNotNull()).select(id_col).distinct())
    return semi(docs, leaked, id_col, leaked.count(), "left_anti")


ORACLE = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), ish AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS size, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS shingle
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), q AS (
  SELECT item_id, count(*) AS q FROM ish GROUP BY item_id
), dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), sizes AS (
  SELECT DISTINCT size FROM ish
), dsh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + size - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
), found AS (
  SELECT doc_id, item_id, count(*) AS n FROM dsh JOIN ish USING (shingle) GROUP BY ALL
)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_found, CAST(q AS BIGINT) AS n_shingles, n / q AS containment
FROM found JOIN q USING (item_id) WHERE n >= q * 0.8 - 1e-9
"""
