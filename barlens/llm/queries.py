"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barlens.llm import block_naming, bpe, decontaminate, jaccard, language, licenses, pii, quality, repetition, secrets, simhash, trie, warc
from barlens.llm.common import read, read_dealt


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(read_dealt(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_dealt(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.groups(read_dealt(spark, sf_dir, "documents"))


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read_dealt(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_dealt(spark, sf_dir, "documents"))


def op6_secrets_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_dealt(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(read_dealt(spark, sf_dir, "pages"))


def op8_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(read_dealt(spark, sf_dir, "documents"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read_dealt(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read_dealt(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(read(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(read_dealt(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.report(read_dealt(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_containment": op2_containment,
    "op3_block_naming_dedup": op3_block_naming_dedup,
    "op4_quality_trees": op4_quality_trees,
    "op5_pii": op5_pii,
    "op6_secrets_crf": op6_secrets_crf,
    "op7_warc": op7_warc,
    "op8_language_gru": op8_language_gru,
    "op9_license_rules": op9_license_rules,
    "op10_simhash": op10_simhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_containment": decontaminate.ORACLE,
    "op3_block_naming_dedup": block_naming.ORACLE,
    "op7_warc": warc.ORACLE,
}
