"""Scan metrics as rows, against the lists of files."""

import os

import pytest
from pyspark.sql import functions as F

from rivulet.session import work_dir
from rivulet.sources import scan_metrics as M


def _noop(df):
    df.write.format("noop").mode("overwrite").save()


def _files(path):
    return [os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]


def test_rows_files_and_bytes_of_runs(spark):
    path, log = work_dir(spark, "measured"), M.ScanLog(spark, work_dir(spark, "scan_log"))
    spark.range(0, 1000, 1, 5).selectExpr("id", "id % 2 AS key").write.partitionBy("key").parquet(path)
    df = spark.read.parquet(path)
    assert log.run("all", df, _noop) == 0
    assert log.run("all", df.select("id"), _noop) == 1
    assert log.run("one", df.where("key = 1"), _noop) == 0
    got = {(r["scan"], r["run"]): r for r in log.table().collect()}
    assert set(got) == {("all", 0), ("all", 1), ("one", 0)}
    for run in (0, 1):
        r = got["all", run]
        assert (r["n_rows"], r["n_files"], r["n_bytes"]) == (1000, len(_files(path)), sum(_files(path)))
    part = _files(os.path.join(path, "key=1"))
    assert (got["one", 0]["n_rows"], got["one", 0]["n_files"], got["one", 0]["n_bytes"]) == (500, len(part), sum(part))
    assert all(r["seconds"] > 0 and r["started"] is not None for r in got.values())


def test_split_files_count_once(spark):
    path, log = work_dir(spark, "split"), M.ScanLog(spark, work_dir(spark, "scan_log"))
    spark.range(0, 50_000, 1, 1).write.option("parquet.block.size", "65536").parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > 1
        log.run("split", df, _noop)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    r = log.table().first()
    assert (r["n_rows"], r["n_files"], r["n_bytes"]) == (50_000, 1, sum(_files(path)))


def test_an_empty_scan_and_bad_names(spark):
    path, log = work_dir(spark, "empty"), M.ScanLog(spark, work_dir(spark, "scan_log"))
    spark.range(0).write.parquet(path)
    log.run("empty", spark.read.parquet(path), _noop)
    r = log.table().first()
    assert (r["n_rows"], r["n_files"], r["n_bytes"]) == (0, 0, 0)
    with pytest.raises(ValueError):
        log.run("a/b", spark.read.parquet(path), _noop)


def test_one_row_a_stream_batch(spark):
    path, out, log = work_dir(spark, "stream_in"), work_dir(spark, "stream_out"), M.ScanLog(spark, work_dir(spark, "scan_log"))
    marks = work_dir(spark, "stream_marks")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10 + i).coalesce(1).write.mode("append").parquet(path)
    sink = log.batches("numbers", lambda df, b: df.write.mode("overwrite").parquet(f"{out}/b={b}"))

    def go():
        stream = M.with_files(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path))
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    go()
    spark.range(5).coalesce(1).write.mode("append").parquet(path)
    go()                                                      # a restarted stream goes on with the next batch
    rows = log.table().orderBy("run").collect()
    assert [r["run"] for r in rows] == [0, 1, 2, 3] and sorted(r["n_rows"] for r in rows) == [5, 10, 11, 12]
    assert all(r["n_files"] == 1 for r in rows) and sum(r["n_bytes"] for r in rows) == sum(_files(path))
    written = spark.read.parquet(out).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["b"]: r["n"] for r in written} == {r["run"]: r["n_rows"] for r in rows}
    assert spark.read.parquet(out).columns == ["id", "b"]
