"""Partitioned and bucketed Parquet tables.

Reads rely on Spark's own planner for partition pruning, pushed filters and
column pruning; the helpers here only shape the request so those rules can
fire (filters on partition columns, projections before actions).  Writes
never overwrite the folder they read from: a rewrite goes to a fresh folder
and the view is re-pointed.
"""

from __future__ import annotations

import datetime
import decimal
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.lines import ident, parse_schema, sql_str


# --------------------------------------------------------------------- S1 / S3
def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Schema from the Parquet footers, partition columns from ``key=value`` folders."""
    return spark.read.parquet(path)


def register_view(df: DataFrame, name: str, replace: bool = True) -> None:
    """``createTempView`` fails if ``name`` is taken; the replace form does not."""
    (df.createOrReplaceTempView if replace else df.createTempView)(name)


# --------------------------------------------------------------------- S2
def write_partitioned(df: DataFrame, path: str, keys: list[str] | str, mode: str = "errorifexists",
                      rebalance: bool = True) -> None:
    """One folder per key value; the key columns leave the data files.

    Rows are rebalanced on the keys first so each folder gets few files, while
    adaptive execution may still split a key that holds most of the rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if rebalance:
        df = df.hint("rebalance", *keys)
    df.write.mode(mode).partitionBy(*keys).parquet(path)


# --------------------------------------------------------------------- S4-S8, S12
def conjunction(filters: list[Column]) -> Column:
    """AND of a filter list; an empty list keeps every row."""
    return reduce(lambda a, b: a & b, filters) if filters else F.lit(True)


def in_list(df: DataFrame, col: str, values: list, max_literals: int = 10_000) -> DataFrame:
    """``col IN (values)``: a pushed-down literal list when short, a key table when long; the rows are the same."""
    if len(values) <= max_literals:
        return df.where(F.col(col).isin(list(values)))
    dtype = df.schema[col].dataType.simpleString()
    keys = df.sparkSession.createDataFrame([(v,) for v in values], f"{col} {dtype}")
    return semi_join_keys(df, keys, col)


def semi_join_keys(df: DataFrame, keys: DataFrame, on: str, key_col: str | None = None) -> DataFrame:
    """A large IN list as a key table: ``df`` rows whose ``on`` value is in ``keys``.

    A semi join needs no distinct keys; whether they are broadcast is decided
    by their measured bytes (adaptive execution), and the key side runs once.
    """
    return df.join(keys.select(F.col(key_col or on).alias(on)), on, "left_semi")


def write_with_bloom_filters(df: DataFrame, path: str, distinct: dict[str, int], mode: str = "errorifexists") -> None:
    """Parquet files with a Bloom filter of each column in ``distinct`` (column -> distinct values of a file expected).

    An ``=`` or ``IN`` on such a column then skips the row groups which do not
    hold its values, where minima and maxima cannot tell, as with unordered ids.
    """
    writer = df.write.mode(mode)
    for column, n in distinct.items():
        writer = (writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                  .option(f"parquet.bloom.filter.expected.ndv#{column}", str(int(n))))
    writer.parquet(path)


def allow_join_filters(spark: SparkSession, least_scan: str = "1g", largest_keys: str = "64m") -> None:
    """Let shuffled joins drop the rows that cannot match before they are shuffled.

    A setting of the session: Spark builds a Bloom filter of the smaller side
    and tests the larger side's rows in its scan stage.  It does so if the
    smaller side has a filter of its own and is estimated at ``largest_keys``
    at most (so what is sent to the tasks is bounded), and the larger side's
    scan at ``least_scan`` or more.  Plans change, rows do not.
    """
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", least_scan)
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", largest_keys)


# --------------------------------------------------------------------- S9 / S10
def create_file_view(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> None:
    """A temp view over a table folder that also accepts INSERT INTO."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} USING {fmt} OPTIONS (path {sql_str(path)})")


def sql_literal(value) -> str:
    """A Python value as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return sql_str(value)
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP {sql_str(value.isoformat(sep=' '))}"
    if isinstance(value, datetime.date):
        return f"DATE {sql_str(value.isoformat())}"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return f"{value:f}BD"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def insert_static_partition(spark: SparkSession, view: str, partition: dict, select_sql: str) -> None:
    """``INSERT INTO view PARTITION (k=v) SELECT ...``: columns bind by position, key from the clause."""
    spec = ", ".join(f"{ident(k)}={sql_literal(v)}" for k, v in partition.items())
    spark.sql(f"INSERT INTO {view} PARTITION ({spec}) {select_sql}")


def union_distinct_rewrite(spark: SparkSession, view: str, incoming: DataFrame, new_path: str,
                           partition_keys: list[str] | None = None) -> DataFrame:
    """Union a table with new rows, drop duplicates, write a fresh folder, re-point the view.

    The old folder is never written while it is being read.
    """
    current = spark.table(view)
    merged = current.unionByName(incoming.select(*current.columns)).distinct()
    if partition_keys:
        write_partitioned(merged, new_path, partition_keys)
    else:
        merged.write.mode("errorifexists").parquet(new_path)
    fresh = spark.read.parquet(new_path)
    fresh.createOrReplaceTempView(view)
    return fresh


# --------------------------------------------------------------------- S11
def scan_directory_tree(spark: SparkSession, root: str, data_schema: T.StructType | str,
                        partition_col: str, partition_type: str = "int",
                        read_columns: list[str] | None = None, filters: list[Column] | None = None,
                        fmt: str = "parquet") -> DataFrame:
    """Read ``root/<partition_col>=<v>/...`` with declared schemas.

    The partition value is the text after the last ``=`` of the folder name,
    cast strictly to ``partition_type`` (a bad folder name fails the scan).
    The read schema is ``read_columns`` plus the partition column; the
    filters are ANDed and applied to the scan.
    """
    if isinstance(data_schema, str):
        data_schema = parse_schema(data_schema)
    folder = F.regexp_extract(F.col("_metadata.file_path"), rf"/{re.escape(partition_col)}=([^/]*)/[^/]*$", 1)
    parsed = folder.try_cast(partition_type)
    value = F.when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit(f"bad {partition_col} folder: "), F.col("_metadata.file_path"))))
    df = (spark.read.schema(data_schema).option("recursiveFileLookup", "true").format(fmt).load(root)
          .withColumn(partition_col, value.cast(partition_type)))
    if filters:
        df = df.where(conjunction(filters))
    cols = (read_columns or [f.name for f in data_schema.fields]) + [partition_col]
    return df.select(*cols)


# --------------------------------------------------------------------- S13
def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, by: str,
                   sort_by: str | None = None) -> DataFrame:
    """Save ``df`` as an external bucketed table at ``path`` and return it.

    Two tables bucketed the same way on the join key join and aggregate with
    no shuffle.  The rows are dealt by bucket first, so each bucket is one
    file and keeps its sort order.
    """
    w = df.repartition(buckets, by).write.mode("errorifexists").option("path", path).bucketBy(buckets, by)
    if sort_by:
        w = w.sortBy(sort_by)
    w.format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def unique_table_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


# --------------------------------------------------------------------- S14
def observed(df: DataFrame, name: str = "scan"):
    """Attach row-count and value metrics to a scan; read them from the Observation after an action.

    Metrics are collected as the rows flow by (accumulated per task), so the
    scan is not run twice.
    """
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def scan_file_report(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, data files and their bytes per group of a file-backed scan, from ``_metadata``."""
    files = df.groupBy(*by, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).agg(
        F.count(F.lit(1)).alias("n"))
    return files.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"),
                                  F.sum("size").alias("n_bytes"), F.min("n").alias("min_file_rows"))
