"""One query for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import decontam, divergence, fingerprints, langid, mixing, paragraphs, quality, repair, secrets, sharding, simhash, suffix, topk
from .common import documents, tune


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return topk.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Native throughout: read as it is, since dealing out a small table asks for its partitions. Unbounded, as its SQL has it.
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), bounded=False)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return langid.identify(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return secrets.scan(documents(spark, sf_dir))


def op7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return paragraphs.repeated(documents(spark, sf_dir), least=1)


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return suffix.remove_repeats(documents(spark, sf_dir), shorter=suffix.PASSAGE)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return repair.repair(read_table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return divergence.audit(documents(spark, sf_dir))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return fingerprints.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_exact_topk": op2_exact_topk,
    "op3_mixing": op3_mixing,
    "op4_language": op4_language,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_paragraphs": op7_paragraphs,
    "op8_compression_quality": op8_compression_quality,
    "op9_repeated_strings": op9_repeated_strings,
    "op10_sharding": op10_sharding,
    "op11_repair": op11_repair,
    "op12_divergence": op12_divergence,
    "op13_fingerprints": op13_fingerprints,
}

SQL: dict[str, str] = {"op2_exact_topk": topk.NEIGHBOURS_SQL, "op3_mixing": mixing.mix_sql(), "op12_divergence": divergence.audit_sql()}
