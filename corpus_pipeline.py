"""The training-corpus pipeline: language ID, exact and near de-duplication, decontamination, packing.

Every stage is written as Parquet and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import fresh, read_table, stored, with_row
from rivulet.llm.decontaminate import contamination
from rivulet.llm.dedup_exact import exact_dedup
from rivulet.llm.language import UNKNOWN, identify, learnt
from rivulet.llm.packing import pack
from rivulet.llm.simhash import simhash_dedup


def _only_kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided(_row, kept)`` keeps."""
    row = fresh(docs, "_row")
    kept = decided.where("kept").select(F.col("_row").alias(row))
    return with_row(docs, row).join(kept, row, "left_semi").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in some known language; texts with no letter go."""
    named = identify(docs, learnt(docs))
    predicted = named.columns[len(docs.columns)]
    return named.where(F.col(predicted) != UNKNOWN).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return _only_kept(docs, exact_dedup(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component."""
    return _only_kept(docs, simhash_dedup(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that aren't contaminated by the benchmark."""
    judged = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    flag = judged.columns[len(docs.columns) + 4]
    return judged.where(~F.col(flag)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    return pack(docs)


STAGES = [
    ("language", language_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: EM, component search and dynamic programming have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
