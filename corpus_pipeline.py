"""The corpus pipeline: documents in, token digests of what is worth training on out.

Each stage gets the rows its predecessor kept, reread from Parquet, and its decisions take effect; all but
the last return the columns of documents. A null text counts as empty everywhere. Rows without a doc_id are
judged like others by quality, dropped as copies only of rows with the same text, and kept by the stages that
decide by doc_id. An empty table passes through all stages as an empty table, and columns beyond those of
documents are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barlens.llm import block_naming, bpe, decontaminate, quality, simhash
from barlens.llm.common import read, read_dealt, scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without what the quality classifier, trained on labels, rejects; without any label all rows stay. Each
    row is judged by its own text, so that rows that repeat stay or go together."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest doc_id; of rows that repeat it, one."""
    return block_naming.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest doc_id; texts without words
    are near duplicates of each other."""
    return simhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain four fifths of the five-word shingles of an item of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to, for every row that is left."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written to the shared folder and read again."""
    docs = read_dealt(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Training the classifier, fingerprints and byte-level BPE can't be expressed in SQL; tests/llm holds the
#: pipeline against a version in plain Python.
ORACLE_SQL: str | None = None
