"""Metrics of scans and stream batches as rows of a table.

A scan is measured while its rows flow by, so it is not run twice: Spark adds
up rows, and at the first row of each file the file and its bytes.  One row
per run or batch is then stored, where SQL can read it.
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rivulet.session import committed_values

SCHEMA = "scan string, run bigint, started timestamp, seconds double, n_rows bigint, n_files bigint, n_bytes bigint"
_HELP = ("_scan_at", "_scan_size")


def with_files(df: DataFrame) -> DataFrame:
    """A Parquet scan, batch or stream, with the helper columns that :func:`measured` reads and drops."""
    return df.select("*", F.col("_metadata.row_index").alias(_HELP[0]), F.col("_metadata.file_size").alias(_HELP[1]))


def measured(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows of :func:`with_files` and what is observed of them.

    Files without rows are not seen.  Filters on partition columns belong
    before ``with_files``, so they prune folders; other filters belong behind
    this, and are then not pushed into the measured scan.
    """
    seen = Observation()
    begins: Column = F.col(_HELP[0]) == 0
    out = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(begins).alias("n_files"),
                     F.coalesce(F.sum(F.when(begins, F.col(_HELP[1]))), F.lit(0)).alias("n_bytes"))
    return out.drop(*_HELP), seen


class ScanLog:
    """The metrics table at ``path``; runs of a scan are numbered, stream batches have their own numbers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(f"{self.path}/scan=*/run=*")

    def _folder(self, scan: str) -> str:
        if not scan or not all(c.isalnum() or c in "-_" for c in scan):
            raise ValueError(f"no name for a scan: {scan!r}")
        return f"{self.path}/scan={scan}"

    def _record(self, scan: str, run: int, df: DataFrame, action: Callable[[DataFrame], None]) -> None:
        out, seen = measured(df)
        started, clock = datetime.datetime.now(datetime.timezone.utc), time.monotonic()
        action(out)
        got = seen.get
        row = [(started, time.monotonic() - clock, got["n_rows"], got["n_files"], got["n_bytes"])]
        fields = SCHEMA.split(", ", 2)[2]
        # A replayed batch writes its row again.
        self.spark.createDataFrame(row, fields).coalesce(1).write.mode("overwrite").parquet(f"{self._folder(scan)}/run={run}")

    def run(self, scan: str, df: DataFrame, action: Callable[[DataFrame], None]) -> int:
        """Do ``action`` on the scan ``df``, which must read all rows once, and store the run's row; returns its number."""
        number = max(committed_values(self.spark, self._folder(scan), "run"), default=-1) + 1
        self._record(scan, number, with_files(df), action)
        return number

    def batches(self, scan: str, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function for a stream of :func:`with_files`: ``sink``, and the batch's row."""
        self._folder(scan)
        return lambda df, batch: self._record(scan, batch, df, lambda out: sink(out, batch))
