"""The corpus pipeline: each stage takes all that the one before it kept.

quality -> near copies -> repeated passages -> benchmark leaks -> pieces. run() writes each stage's result as
Parquet in the shared folder and reads it again as the documents of the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, near_dedup, pieces, quality, suffix_dedup
from gridloom.llm._shared import drop_scratch, materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays."""
    return near_dedup.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go out of the texts; every document stays."""
    return suffix_dedup.strip_repeats(docs, chars="n_chars")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and whether decoding gave the text back."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_classifier),
    ("near_dedup", minhash_near_dedup),
    ("suffix_dedup", suffix_array_dedup),
    ("decontaminate", benchmark_decontamination),
    ("encode", sentencepiece_encoding),
]

#: The stages learn, hash and sample: SQL can't express them. Tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_scratch(spark, docs)
        docs = out
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
