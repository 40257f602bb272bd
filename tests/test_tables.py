"""Partitioned table writers and readers: failure cases and metrics."""

import pytest
from pyspark.sql import functions as F

from rivulet.session import work_dir
from rivulet.sources import tables, topics


def _kv(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key int, value string")


def test_partitioned_write_refuses_existing_target(spark):
    path = work_dir(spark, "kv_exists")
    tables.write_partitioned(_kv(spark), path, "key")
    with pytest.raises(Exception):
        tables.write_partitioned(_kv(spark), path, "key")
    # key left the files, and comes back from folder names
    back = tables.read_table(spark, path)
    assert back.columns == ["value", "key"]
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_insert_into_static_partition_binds_by_position(spark):
    path = work_dir(spark, "kv_insert")
    tables.write_partitioned(_kv(spark), path, "key")
    tables.create_file_view(spark, "kv_ins", path)
    spark.createDataFrame([(1, "x"), (2, "y")], "key int, value string").createOrReplaceTempView("kv_src")
    tables.insert_static_partition(spark, "kv_ins", {"key": 1}, "SELECT value FROM kv_src")
    got = sorted(tuple(r) for r in spark.table("kv_ins").where("key = 1").collect())
    assert got == [("a", 1), ("x", 1), ("y", 1)]


def test_directory_tree_scan_rejects_bad_folder(spark):
    path = work_dir(spark, "tree")
    spark.createDataFrame([("a",)], "value string").write.parquet(f"{path}/key=1")
    spark.createDataFrame([("b",)], "value string").write.parquet(f"{path}/key=notanint")
    with pytest.raises(Exception, match="bad key folder"):
        tables.scan_directory_tree(spark, path, "value string", "key").collect()


def test_conjunctive_filter_list_is_empty(spark):
    path = work_dir(spark, "tree2")
    tables.write_partitioned(_kv(spark), path, "key")
    df = tables.scan_directory_tree(spark, path, "value string", "key",
                                    filters=[F.col("value") == "a", F.col("value") == "b"])
    assert df.count() == 0
    only_a = tables.scan_directory_tree(spark, path, "value string", "key", filters=[F.col("value") == "a"])
    assert [tuple(r) for r in only_a.collect()] == [("a", 1)]


def test_union_distinct_rewrite_goes_to_new_folder(spark):
    old = work_dir(spark, "old")
    tables.write_partitioned(_kv(spark), old, "key")
    tables.register_view(tables.read_table(spark, old), "kv_up")
    new = work_dir(spark, "new")
    incoming = spark.createDataFrame([("a", 1), ("d", 4)], "value string, key int")
    fresh = tables.union_distinct_rewrite(spark, "kv_up", incoming, new, partition_keys=["key"])
    assert sorted(tuple(r) for r in fresh.collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert tables.read_table(spark, old).count() == 3      # the old folder is untouched


def test_observed_scan_counts_rows(spark):
    df, obs = tables.observed(spark.range(123))
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 123


def test_topic_save_modes_on_new_topic(spark):
    rows = spark.createDataFrame([(1, "a", 2)], "id int, name string, age int")
    for mode in ("append", "overwrite", "errorifexists", "ignore"):
        path = work_dir(spark, f"new_topic_{mode}")
        topics.write_topic(rows, path, mode=mode)      # an absent topic is created in every mode
        assert spark.read.text(path).count() == 1


def test_static_partition_literals():
    import datetime as dt
    import decimal
    lit = tables.sql_literal
    assert [lit(x) for x in (None, True, 3, "o'x\\", dt.date(2024, 1, 2), decimal.Decimal("1.50"))] == [
        "NULL", "true", "3", "'o\\'x\\\\'", "DATE '2024-01-02'", "1.50BD"]
    with pytest.raises(TypeError):
        lit([1])


def test_insert_into_a_text_partition_with_quotes(spark):
    path = work_dir(spark, "kv_text")
    tables.write_partitioned(spark.createDataFrame([("a", "x")], "value string, key string"), path, "key")
    tables.create_file_view(spark, "kv_text", path)
    tables.insert_static_partition(spark, "kv_text", {"key": "o'clock"}, "SELECT 'b'")
    assert sorted(tuple(r) for r in spark.table("kv_text").collect()) == [("a", "x"), ("b", "o'clock")]


def test_work_folders_need_a_shared_folder_off_local(monkeypatch):
    from rivulet import session

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.work_dir(Session, "x")
