"""Dataset idioms (D1-D8) as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.indexing import index_within_groups, running_total
from rivulet.session import ensure_checkpoint_dir, last_committed


# --------------------------------------------------------------------- D1
def word_count(df: DataFrame, text_col: str, sep: str = ",") -> DataFrame:
    """(word, n): split on ``sep`` (a regex), count each word; map-side partial counts absorb hot words."""
    words = df.select(F.explode(F.split(F.col(text_col), sep)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- D2 / D3
def key_by(df: DataFrame, key: Column, name: str = "k") -> DataFrame:
    """Attach a key computed from the row, e.g. ``x % 2``."""
    return df.withColumn(name, key)


def chunk_group_list(df: DataFrame, chunk: Column, key: Column, value: str) -> DataFrame:
    """D3: group to a sorted list inside each chunk: a key appears once per chunk.

    ``chunk`` is an explicit column (not the physical partition id, which is
    not repeatable), so chunks bound the size of every list.
    """
    return (df.select(chunk.alias("chunk"), key.alias("k"), F.col(value))
            .groupBy("chunk", "k").agg(F.sort_array(F.collect_list(value)).alias("values")))


# --------------------------------------------------------------------- D4
def group_list(df: DataFrame, key: Column, value: str, piece_rows: int = 10_000) -> DataFrame:
    """Every group's values as a sorted list, emitted in pieces of at most ``piece_rows``.

    Concatenating a group's pieces in ``piece`` order gives its whole sorted
    list.  No piece -- and so no task -- ever holds more than ``piece_rows``
    values, however large the group.
    """
    # equal values are interchangeable in a sorted list; the row id spreads a repeated one over tasks
    keyed = df.select(key.alias("k"), F.col(value), F.monotonically_increasing_id().alias("_tie"))
    indexed = index_within_groups(keyed, ["k"], [value, "_tie"], name="_i")
    return (indexed.withColumn("piece", F.expr(f"_i div {int(piece_rows)}"))
            .groupBy("k", "piece").agg(F.sort_array(F.collect_list(value)).alias("values")))


# --------------------------------------------------------------------- D5 / D6
def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union (duplicates kept), no shuffle."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def map_elements(df: DataFrame, col: str, fn: Callable, out: str = "y", out_type: str = "bigint",
                 pandas: bool = False) -> DataFrame:
    """Apply ``fn`` to every element.

    ``fn`` maps a Column to a Column and stays a JVM expression; with
    ``pandas`` it maps a pandas Series to a Series over Arrow batches.
    Whatever ``fn`` raises reaches the caller.
    """
    if not pandas:
        expr = fn(F.col(col))
        if not isinstance(expr, Column):
            raise TypeError("fn has to return a Column; pass pandas=True for a function of a pandas Series")
        return df.withColumn(out, expr.cast(out_type))
    schema = df.select("*", F.lit(None).cast(out_type).alias(out)).schema

    def apply(batches):
        for pdf in batches:
            yield pdf.assign(**{out: fn(pdf[col])})

    return df.mapInPandas(apply, schema)


# --------------------------------------------------------------------- D7 / D8
def accumulating_counts(df: DataFrame, batch: Column) -> DataFrame:
    """Row count after each append when batches arrive in ``batch`` order.

    One aggregate per batch, checkpointed (D8: lineage cut in the shared
    checkpoint folder), then a range-partitioned running sum over the
    per-batch counts.
    """
    ensure_checkpoint_dir(df.sparkSession)
    per = df.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n_rows")).checkpoint()
    return running_total(per, [], ["batch"], "n_rows", "running_rows")


class AccumulatingTable:
    """D7 as a live table: each :meth:`append` adds a batch and returns the new row count.

    Batches go to their own folder under ``path`` (rewritten on retry, so a
    replayed append does not double count); the count reads only footers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        last = last_committed(spark, self.path, "batch")
        self.batches = 0 if last is None else last + 1

    def append(self, df: DataFrame) -> int:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={self.batches}")
        self.batches += 1
        return self.count()

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> int:
        return self.table().count()
