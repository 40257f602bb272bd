"""Bucketed tables: which files and rows make up a bucket, pruning, and joins of unequal counts."""

import os

import pytest
from pyspark.sql import functions as F

from rivulet.session import work_dir
from rivulet.sources import buckets, tables


def _stored(spark, n=8, rows=1000):
    name, path = tables.unique_table_name("audited"), work_dir(spark, "audited")
    tables.write_bucketed(spark.range(rows).selectExpr("id AS k", "id * 2 AS v"), name, path, n, "k", "k")
    return name, path


def _plan(spark, df, **conf):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"} | conf
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_audit_counts_files_and_rows(spark):
    name, path = _stored(spark)
    assert buckets.layout(spark, name).by == ("k",)
    got = buckets.audit(spark, name).orderBy("bucket").collect()
    assert [r["bucket"] for r in got] == list(range(8)) and all(r["n_files"] == 1 for r in got)
    assert sum(r["n_rows"] for r in got) == sum(r["n_keys"] for r in got) == 1000
    sizes = {f: os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet")}
    assert sum(r["n_bytes"] for r in got) == sum(sizes.values())


def test_absent_buckets_are_empty(spark):
    name, _ = _stored(spark, n=8, rows=1)
    got = buckets.audit(spark, name).collect()
    assert len(got) == 8 and sorted(r["n_rows"] for r in got) == [0] * 7 + [1]
    assert [r for r in got if r["n_rows"] == 0][0]["n_keys"] == 0
    assert spark.table(name).count() == 1


@pytest.mark.parametrize("bad", ["extra.parquet", "part-0_00009.c000.parquet"])
def test_a_bad_file_name_is_an_error(spark, bad):
    name, path = _stored(spark)
    one = work_dir(spark, "one")
    spark.range(0).selectExpr("id AS k", "id AS v").coalesce(1).write.parquet(one)
    part = next(f for f in os.listdir(one) if f.startswith("part-"))
    with open(os.path.join(one, part), "rb") as src, open(os.path.join(path, bad), "wb") as to:
        to.write(src.read())
    with pytest.raises(Exception, match="no bucket file"):
        buckets.bucket_files(spark, name).collect()


def test_rows_in_the_file_of_another_bucket_are_an_error(spark):
    name, path = _stored(spark)
    one = work_dir(spark, "one")
    spark.range(50).selectExpr("id AS k", "id AS v").coalesce(1).write.parquet(one)
    part = next(f for f in os.listdir(one) if f.startswith("part-"))
    with open(os.path.join(one, part), "rb") as src, open(os.path.join(path, "part-x_00003.c000.parquet"), "wb") as to:
        to.write(src.read())
    with pytest.raises(Exception, match="row outside its bucket"):
        buckets.audit(spark, name).collect()


def test_tables_without_buckets_are_refused(spark):
    name = tables.unique_table_name("plain")
    spark.range(3).write.option("path", work_dir(spark, "plain")).saveAsTable(name)
    with pytest.raises(ValueError, match="not bucketed"):
        buckets.layout(spark, name)


def test_literals_open_only_their_buckets(spark):
    name, _ = _stored(spark)
    df = spark.table(name).where(F.col("k").isin(5, 6))
    wanted = {r[0] for r in spark.range(5, 7).select(F.pmod(F.hash("id"), F.lit(8))).collect()}
    assert f"SelectedBucketsCount: {len(wanted)} out of 8" in _plan(
        spark, df, **{"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"})
    assert sorted(r["v"] for r in df.collect()) == [10, 12]
    # a scan that needs no bucket layout skips the same files: rows are read from these buckets alone
    read = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    whole = {r["bucket"]: r["n_rows"] for r in buckets.audit(spark, name).collect()}
    assert read <= sum(whole[b] for b in wanted)


def test_twice_as_many_buckets_join_without_a_shuffle(spark, sf_dir):
    from rivulet.plans.q_tables import bucketed_join, bucketed_join_unequal
    df = bucketed_join_unequal(spark, sf_dir)
    plan = _plan(spark, df)
    assert "Exchange" not in plan and "(Coalesced to 4)" in plan
    assert sorted(map(tuple, bucketed_join(spark, sf_dir).collect())) == sorted(map(tuple, df.collect()))


def test_bucket_counts_follow_the_rows(spark):
    assert buckets.buckets_for(spark, 0, least=4) == buckets.buckets_for(spark, 4 * buckets.ROWS_PER_BUCKET, least=4) == 4
    assert buckets.buckets_for(spark, 4 * buckets.ROWS_PER_BUCKET + 1, least=4) == 5
    assert buckets.buckets_for(spark, 10**15, finer=2) == 50_000  # Spark's end: the finer table has 100,000


@pytest.mark.parametrize("times", [1, 3])
def test_larger_tables_get_more_buckets_not_larger_ones(spark, sf_dir, tmp_path, monkeypatch, times):
    from rivulet.plans import q_tables
    monkeypatch.setattr(buckets, "ROWS_PER_BUCKET", 500, raising=False)
    monkeypatch.setattr(q_tables, "_BUCKETED", {})
    rows = 0
    for t, key in ("orders", "o_orderkey"), ("lineitem", "l_orderkey"):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        many = df.crossJoin(spark.range(times).select(F.col("id").alias("_copy")))
        many.withColumn(key, F.col(key) + F.col("_copy") * 1_000_000).drop("_copy").write.parquet(f"{tmp_path}/{t}.parquet")
        rows += df.count() * times
    df = q_tables.bucketed_join_unequal(spark, str(tmp_path))
    names = q_tables._bucketed_names(spark, str(tmp_path), 4, finer=2)
    n = -(-rows // 500)
    assert [buckets.layout(spark, t).buckets for t in names] == [n, 2 * n]
    read = [buckets.audit(spark, t).collect() for t in names]
    assert all(r["n_files"] <= 1 for t in read for r in t) and sum(r["n_rows"] for t in read for r in t) == rows
    # one task reads bucket b of the orders and buckets b and b + n of the lines
    both = [sum(r["n_rows"] for t in read for r in t if r["bucket"] % n == b) for b in range(n)]
    assert max(both) < 2 * 500
    plan = _plan(spark, df)
    assert "Exchange" not in plan and f"(Coalesced to {n})" in plan
    for t in "orders", "lineitem":
        spark.read.parquet(f"{tmp_path}/{t}.parquet").createOrReplaceTempView(f"grown_{t}")
    sql = q_tables.ORACLES["bucketed_join_unequal"].replace("FROM orders", "FROM grown_orders").replace("JOIN lineitem", "JOIN grown_lineitem")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, spark.sql(sql).collect()))
