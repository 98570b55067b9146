"""What the text operators share: reading tables, row batches of bounded size, and places for written tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Arrow batches hold at most so many bytes, however long the texts are.
BATCH_BYTES = 8 << 20
#: A side is broadcast only if it was counted or bounded to fewer bytes than this.
BROADCAST_BYTES = 16 << 20


#: Tables of fewer bytes for each core are dealt anew after they are read.
LEAST_BYTES_A_CORE = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_dealt(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of texts; one so small that its files would keep only some cores busy is dealt to all of them, which
    for a larger one would be a needless shuffle."""
    frame = spark.read.parquet(path := f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return frame.repartition(cores) if size < cores * LEAST_BYTES_A_CORE else frame


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, mod: int = 5) -> Column:
    """crc32 of the id as text, modulo mod: 0 marks the held-out fold. Null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(mod))


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of each Arrow batch, so that few very long texts make small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def rows_to_arrow(
    fn: Callable[[list, list[str]], Iterable[tuple]], schema: pa.Schema, rows: int = 512
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function over (id, text) batches. fn gets the ids and texts of a slice and gives
    the columns of the result in the order of schema, ids first. Slices keep the output batches small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0)
                texts = part.column(1).to_pylist()
                columns = fn(ids.to_pylist(), texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, t.type) for c, t in zip(columns, list(schema)[1:], strict=True))], schema=schema
                )

    return run


def map_texts(
    docs: DataFrame, id_col: str, text_col: str, fn: Callable[[list, list[str]], Iterable[tuple]], fields: list[tuple[str, pa.DataType]], rows: int = 512
) -> DataFrame:
    """The id column, of whatever type, and the columns named in fields that fn makes of slices of ids and texts."""
    bound_batches(docs.sparkSession)
    made = from_arrow_schema(pa.schema(fields))
    result = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def typed(first: pa.RecordBatch) -> pa.Schema:
            return pa.schema([("id", first.column(0).type), *fields])

        for batch in batches:
            yield from rows_to_arrow(fn, typed(batch), rows)(iter([batch]))

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, result)
    return frame.withColumnRenamed("id", id_col)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """names, each with underscores before it until no column of frame has it."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written table below spark.checkpoint.dir, which all executors share. Only where
    that is unset (a local session, as in tests) a folder of this machine is set as the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        shared = context.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='barlens-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return shared.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The same rows read from the shared checkpoint folder: later steps don't recompute what came before."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def semi(frame: DataFrame, ids: DataFrame, key: str, n_ids: int, how: str = "left_semi") -> DataFrame:
    """frame restricted to (left_semi) or without (left_anti) the keys of ids. ids, which holds n_ids
    rows of a long or a word, is broadcast only below BROADCAST_BYTES; beyond, both sides shuffle on the key."""
    if n_ids * 64 < BROADCAST_BYTES:
        ids = F.broadcast(ids)
    else:
        ids = ids.hint("shuffle_merge")
    return frame.join(ids, key, how)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on integer keys where left may have a hot key and right has each key once. Both sides go by the
    complement of their keys, for which no earlier partitioning is known: so each is exchanged for this
    join alone, and adaptive execution can split the partition of a hot key."""
    made = [f"_join_{k}" for k in keys]
    left = left.withColumns({m: F.bitwise_not(F.col(k)) for m, k in zip(made, keys, strict=True)})
    right = right.select(*(F.bitwise_not(F.col(k)).alias(m) for m, k in zip(made, keys, strict=True)), *(c for c in right.columns if c not in keys))
    return left.join(right.hint("shuffle_merge"), made, how).drop(*made)


def least_hashed(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """The at most so many rows of the least hashes of their ids: a bounded sample that does not depend on
    how rows are dealt. Where there are many, a cut of the hashes far above what is needed comes first, so
    that the partitions don't each send as many rows to the last task."""
    spread = 1 << 30
    n = rows.count()
    hashed = rows.withColumn("_hash", F.pmod(F.xxhash64(id_col), F.lit(spread)))
    if n > 8 * most:
        hashed = hashed.filter(F.col("_hash") < spread * 4 * most // n)
    return hashed.orderBy("_hash", id_col).limit(most).drop("_hash")
