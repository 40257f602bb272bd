"""Bucketed tables read by bucket (S13): bucket counts, file audit, bucket pruning, joins of unequal bucket counts.

Spark itself skips buckets for ``=`` and ``IN`` on the bucket column and joins
equal layouts without a shuffle; what it does not do is tell which files make
up a bucket, or whether they hold the rows their name promises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: Spark ends the name of a bucket's file in ``_<bucket id>``, before the extensions.
BUCKET_OF_FILE = r"_(\d+)(?:\.[^/]*)?$"

# Fixed value: without a shuffle one task joins a whole bucket, so this bounds its memory (README, Bucketed tables).
ROWS_PER_BUCKET = 1_000_000


def buckets_for(spark: SparkSession, rows: int, least: int = 1, finer: int = 1) -> int:
    """How many buckets keep ``rows`` rows at ``ROWS_PER_BUCKET`` a bucket on average: ``least`` or more.

    ``rows`` counts those of all tables that one task reads by bucket.  Spark
    allows a table ``spark.sql.sources.bucketing.maxBuckets``; if a table is to
    have ``finer`` times as many, that is the end, and buckets then grow.
    """
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")) // finer
    return max(least, min(-(-rows // ROWS_PER_BUCKET), most))


@dataclass(frozen=True)
class Layout:
    """How a table is bucketed and where its files lie."""

    buckets: int
    by: tuple[str, ...]
    location: str


def layout(spark: SparkSession, name: str) -> Layout:
    """The bucket layout of table ``name``; a table without buckets is an error."""
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    if "Num Buckets" not in said:
        raise ValueError(f"{name} is not bucketed")
    return Layout(int(said["Num Buckets"]), tuple(re.findall(r"`((?:[^`]|``)+)`", said["Bucket Columns"])), said["Location"])


def bucket_of(path: Column, buckets: int) -> Column:
    """The bucket id in a file's name; a name without one, or with one that the table lacks, is an error."""
    number = F.regexp_extract(path, BUCKET_OF_FILE, 1).try_cast("int")
    return F.when(number < buckets, number).otherwise(F.raise_error(F.concat(F.lit("no bucket file: "), path)))


def bucket_files(spark: SparkSession, name: str) -> DataFrame:
    """(bucket, n_files, n_bytes) for every bucket of the table, over all its folders.

    A bucket without a file is empty, with zeros.  The listing reads no file's
    content, and sees files without rows too.
    """
    lay = layout(spark, name)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(lay.location)
              .select(bucket_of(F.col("path"), lay.buckets).alias("bucket"), "length"))
    found = listed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    every = spark.range(lay.buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").na.fill(0, ["n_files", "n_bytes"])


def bucket_rows(spark: SparkSession, name: str) -> DataFrame:
    """The table's rows with ``bucket``, the bucket of their file; a row in another's file is an error.

    Joins and aggregates without a shuffle take it on trust that equal keys
    lie in equal buckets, so files added by hand must be checked first.  Rows
    are read as plain Parquet, with the hash that Spark deals them by.
    """
    lay = layout(spark, name)
    rows = spark.read.option("recursiveFileLookup", "false").parquet(lay.location)
    mine = bucket_of(F.col("_metadata.file_path"), lay.buckets)
    due = F.pmod(F.hash(*[rows[c] for c in lay.by]), F.lit(lay.buckets))
    lost = F.raise_error(F.concat(F.lit("row outside its bucket in "), F.col("_metadata.file_path")))
    return rows.select("*", F.when(mine == due, mine).otherwise(lost).alias("bucket"))


def audit(spark: SparkSession, name: str) -> DataFrame:
    """(bucket, n_files, n_bytes, n_rows, n_keys) for every bucket; bad file names and misplaced rows are errors.

    One file a bucket means that the bucket keeps its sort order.
    """
    lay = layout(spark, name)
    rows = bucket_rows(spark, name)
    keys = rows.groupBy("bucket", *lay.by).agg(F.count(F.lit(1)).alias("n"))
    counted = keys.groupBy("bucket").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    return bucket_files(spark, name).join(counted, "bucket", "left").na.fill(0, ["n_rows", "n_keys"])


def allow_coalesced_joins(spark: SparkSession, ratio: int = 8) -> None:
    """Let tables whose bucket counts differ by a factor of up to ``ratio`` join with no shuffle.

    A setting of the session: Spark then reads several buckets of the finer
    table as one of the coarser.  It changes plans only, and trades tasks for
    the shuffle, hence the bound on the factor.
    """
    spark.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", "true")
    spark.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.maxBucketRatio", str(ratio))
