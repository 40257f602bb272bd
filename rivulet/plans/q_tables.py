"""Registered queries for partitioned Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.plans import fixtures as fx
from rivulet.plans.registry import make_registry
from rivulet.session import input_mark, is_committed, table, work_dir
from rivulet.sources import buckets, tables
from rivulet.sources.folders import FolderTable
from rivulet.sources.scan_metrics import ScanLog

QUERIES, ORACLES, register = make_registry()

_KV_SQL = """SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag AS value,
       l_linenumber AS key FROM lineitem"""
_KV_COLS = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "value", "key"]


_KV_WRITTEN: dict[tuple, str] = {}


def _kv_table(spark: SparkSession, sf_dir: str, fresh: bool = False) -> str:
    """Fixture A written with one folder per key; returns its path.

    Read-only queries share one written copy per application and input
    folder, as they would share a stored table; queries that modify the
    table ask for a fresh copy.
    """
    key = (spark.sparkContext.applicationId, sf_dir, input_mark(spark, f"{sf_dir}/lineitem.parquet"))
    path = None if fresh else _KV_WRITTEN.get(key)
    if path is not None and is_committed(spark, path):
        return path
    path = work_dir(spark, "kv")
    tables.write_partitioned(fx.kv_rows(spark, sf_dir), path, "key")
    if not fresh:
        _KV_WRITTEN[key] = path
    return path


@register("parquet_scan", _KV_SQL)
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footer schema plus the ``key`` column discovered from folder names."""
    return tables.read_table(spark, _kv_table(spark, sf_dir)).select(*_KV_COLS)


@register("partitioned_roundtrip", """
SELECT l_linenumber AS key, count(*) AS n_rows, count(DISTINCT l_returnflag) AS n_values,
       round(sum(l_quantity), 4) AS sum_qty
FROM lineitem GROUP BY l_linenumber""")
def partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write by key, read back, summarise each key folder."""
    t = tables.read_table(spark, _kv_table(spark, sf_dir, fresh=True))
    return t.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"),
                                F.count_distinct("value").alias("n_values"),
                                F.round(F.sum("l_quantity"), 4).alias("sum_qty"))


@register("partition_pruned_scan", _KV_SQL.replace("FROM lineitem", "FROM lineitem WHERE l_linenumber = 1"))
def partition_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate on the partition column selects folders (PartitionFilters)."""
    tables.register_view(tables.read_table(spark, _kv_table(spark, sf_dir)), "kv_s4")
    return spark.sql("SELECT * FROM kv_s4 WHERE key = 1").select(*_KV_COLS)


@register("in_filter_scan", _KV_SQL + " WHERE l_returnflag IN ('A', 'R')")
def in_filter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data-column IN list pushed to the Parquet reader (PushedFilters)."""
    t = tables.read_table(spark, _kv_table(spark, sf_dir))
    return t.where(F.col("value").isin("A", "R")).select(*_KV_COLS)


@register("residual_filter_scan", _KV_SQL +
          " WHERE l_linenumber = 2 OR (l_linenumber + length(l_returnflag) > 5 AND l_quantity > 45)")
def residual_filter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates mixing partition and data columns stay as a filter after the scan."""
    t = tables.read_table(spark, _kv_table(spark, sf_dir))
    cond = (F.col("key") == 2) | ((F.col("key") + F.length("value") > 5) & (F.col("l_quantity") > 45))
    return t.where(cond).select(*_KV_COLS)


@register("projection_scan", """
SELECT l_orderkey, l_linenumber AS key FROM lineitem WHERE l_returnflag = 'N'""")
def projection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only l_orderkey and value are read (ReadSchema); key comes from folders."""
    t = tables.read_table(spark, _kv_table(spark, sf_dir))
    return t.where(F.col("value") == "N").select("l_orderkey", "key")


@register("large_in_semi_join", """
SELECT c.* FROM customer c
WHERE c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)""")
def large_in_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large membership list held as a key table and semi-joined."""
    keys = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 250000).select("o_custkey")
    return tables.semi_join_keys(table(spark, sf_dir, "customer"), keys, on="c_custkey", key_col="o_custkey")


@register("bloom_semi_join", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)""")
def bloom_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the dearest orders; where the join is shuffled, a Bloom filter of the keys drops lines before it."""
    tables.allow_join_filters(spark)
    keys = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 400000).select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return tables.semi_join_keys(lines, keys, on="l_orderkey", key_col="o_orderkey")


@register("bloom_in_scan", """
SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_custkey IN (1, 10, 77, 100) GROUP BY o_custkey""")
def bloom_in_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An IN list on a column that is unordered in its files, which carry Bloom filters of it."""
    path = work_dir(spark, "orders_bloom")
    tables.write_with_bloom_filters(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), path, {"o_custkey": 1_000_000})
    return tables.read_table(spark, path).where(F.col("o_custkey").isin(1, 10, 77, 100)).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# Fixed value: the size of the reference's literal list.
LITERALS = 60_001


@register("large_in_list", f"""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < {3 * LITERALS}""")
def large_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of 60,001 literals."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tables.in_list(orders, "o_orderkey", list(range(0, 3 * LITERALS, 3)))


@register("insert_static_partition", _KV_SQL + """
UNION ALL
SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag AS value, 1 AS key
FROM lineitem WHERE l_linenumber = 7""")
def insert_static_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows selected from line 7 are appended into the static partition key=1."""
    path = _kv_table(spark, sf_dir, fresh=True)
    tables.create_file_view(spark, "kv_s9", path)
    fx.kv_rows(spark, sf_dir).where("key = 7").drop("key").createOrReplaceTempView("kv_s9_src")
    tables.insert_static_partition(
        spark, "kv_s9", {"key": 1},
        "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, value FROM kv_s9_src")
    return spark.table("kv_s9").select(*_KV_COLS)


@register("upsert_union_distinct", """
SELECT DISTINCT * FROM (
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag AS value, l_linenumber AS key
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'
  UNION ALL
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag AS value, l_linenumber AS key
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01')""")
def upsert_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping extracts merged without duplicates into a fresh folder."""
    li = table(spark, sf_dir, "lineitem")
    kv = lambda d: d.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
                            F.col("l_returnflag").alias("value"), F.col("l_linenumber").alias("key"))
    path = work_dir(spark, "kv_old")
    tables.write_partitioned(kv(li.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))),
                             path, "key")
    tables.register_view(tables.read_table(spark, path), "kv_s10")
    incoming = kv(li.where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")))
    fresh = tables.union_distinct_rewrite(spark, "kv_s10", incoming, work_dir(spark, "kv_new"),
                                          partition_keys=["key"])
    return fresh.select(*_KV_COLS)


@register("partition_rewrite", """
WITH old AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag AS value, l_linenumber AS key
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
new AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag AS value, l_linenumber AS key
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_linenumber <= 3)
SELECT DISTINCT *, key <= 3 AS rewritten FROM (SELECT * FROM old UNION ALL SELECT * FROM new)""")
def partition_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extract of some partitions merged without duplicates; ``rewritten`` are the rows whose folder is new."""
    li = table(spark, sf_dir, "lineitem")
    kv = lambda d: d.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
                            F.col("l_returnflag").alias("value"), F.col("l_linenumber").alias("key"))
    kept = FolderTable.create(kv(li.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))).distinct(), work_dir(spark, "kv_folders"), ["key"])
    kept.union_distinct(kept.read(0))  # every partition is known to have no repeats
    before = {(p, w) for p, w, _ in kept.manifest()}
    late = (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_linenumber") <= 3)
    kept.union_distinct(kv(li.where(late)))
    new = [p.split("=")[1] for p, w, _ in kept.manifest() if (p, w) not in before]
    return kept.read().select(*_KV_COLS, F.col("key").cast("string").isin(new).alias("rewritten"))


@register("directory_tree_scan", """
SELECT l_returnflag AS value, l_quantity, l_linenumber AS key FROM lineitem WHERE l_linenumber <= 3""")
def directory_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared data/partition/read schemas over a key=<int> folder tree."""
    path = _kv_table(spark, sf_dir)
    data_schema = "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, value string"
    return tables.scan_directory_tree(spark, path, data_schema, "key", "int",
                                      read_columns=["value", "l_quantity"], filters=[F.col("key") <= 3])


@register("conjunctive_filters", """
SELECT 'none' AS filters, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_returnflag = 'R'
UNION ALL SELECT 'both', count(*) FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 25
UNION ALL SELECT 'no filter', count(*) FROM lineitem""")
def conjunctive_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter list is ANDed: value='A' and value='R' leaves nothing; an empty list leaves all."""
    path = _kv_table(spark, sf_dir)
    lists = {"none": [F.col("value") == "A", F.col("value") == "R"],
             "both": [F.col("value") == "A", F.col("l_quantity") > 25], "no filter": []}
    counts = [tables.scan_directory_tree(spark, path, "l_quantity double, value string", "key", filters=f)
              .agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("filters"), "n") for k, f in lists.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_BUCKETED: dict[tuple, tuple[str, str]] = {}


def _bucketed_pair(spark: SparkSession, sf_dir: str, n: int, finer: int = 1) -> tuple[DataFrame, DataFrame]:
    """orders in ``n`` buckets or more, as its rows and their lines ask for, and lineitem in ``finer`` times as many,
    on the order key (written once per application)."""
    return tuple(spark.table(t) for t in _bucketed_names(spark, sf_dir, n, finer))


def _bucketed_names(spark: SparkSession, sf_dir: str, n: int, finer: int = 1) -> tuple[str, str]:
    marks = [input_mark(spark, f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")]
    key = (spark.sparkContext.applicationId, sf_dir, n, finer, *marks)
    names = _BUCKETED.get(key)
    if names and all(spark.catalog.tableExists(t) for t in names):
        return names
    o_name, l_name = tables.unique_table_name("orders_b"), tables.unique_table_name("lineitem_b")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    n = buckets.buckets_for(spark, orders.count() + lines.count(), least=n, finer=finer)
    tables.write_bucketed(orders, o_name, work_dir(spark, "orders_b"), n, "o_orderkey", "o_orderkey")
    tables.write_bucketed(lines, l_name, work_dir(spark, "lineitem_b"), n * finer, "l_orderkey", "l_orderkey")
    _BUCKETED[key] = (o_name, l_name)
    return o_name, l_name


@register("bucketed_join", """
SELECT o.o_orderkey, o.o_orderstatus, count(*) AS n_lines, round(sum(l.l_quantity), 4) AS sum_qty
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_orderkey, o.o_orderstatus""")
def bucketed_join(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> DataFrame:
    """Orders and lineitem bucketed on the order key join and aggregate without an Exchange.

    ``buckets`` are the fewest; larger tables get more.
    """
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    o, li = _bucketed_pair(spark, sf_dir, n)
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    return j.groupBy("o_orderkey", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"))


@register("bucketed_join_unequal", """
SELECT o.o_orderkey, o.o_orderstatus, count(*) AS n_lines, round(sum(l.l_quantity), 4) AS sum_qty
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_orderkey, o.o_orderstatus""")
def bucketed_join_unequal(spark: SparkSession, sf_dir: str, buckets_of_orders: int = 4) -> DataFrame:
    """Lineitem in twice as many buckets as orders; two of its buckets are read as one, without an Exchange.

    ``buckets_of_orders`` are the fewest; larger tables get more, as one task reads a whole bucket of both.
    """
    buckets.allow_coalesced_joins(spark)
    o, li = _bucketed_pair(spark, sf_dir, buckets_of_orders, finer=2)
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderkey", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"))


@register("bucket_pruned_scan", """
SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 4) AS sum_qty FROM lineitem
WHERE l_orderkey IN (1, 7, 33) GROUP BY l_orderkey""")
def bucket_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An IN list on the bucket column opens only the buckets of its values."""
    _, li = _bucketed_pair(spark, sf_dir, 4, finer=2)
    return li.where(F.col("l_orderkey").isin(1, 7, 33)).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"))


@register("bucket_audit", """
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys FROM lineitem""")
def bucket_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and keys added up over the audited buckets; a key in two buckets would count twice."""
    _, name = _bucketed_names(spark, sf_dir, 4, finer=2)
    return buckets.audit(spark, name).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_keys").alias("n_keys"))


@register("scan_metrics", """
SELECT 'key-' || l_linenumber AS scan, CAST(0 AS BIGINT) AS run, count(*) AS n_rows FROM lineitem GROUP BY l_linenumber""")
def scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key folder scanned once; its rows as counted in the scan and read back from the metrics table."""
    t = tables.read_table(spark, _kv_table(spark, sf_dir))
    log = ScanLog(spark, work_dir(spark, "scan-log"))
    for key in sorted(r["key"] for r in t.select("key").distinct().collect()):
        log.run(f"key-{key}", t.where(F.col("key") == key), lambda df: df.write.format("noop").mode("overwrite").save())
    return log.table().select("scan", "run", "n_rows")


@register("scan_file_report", """
SELECT l_linenumber AS key, count(*) AS n_rows, true AS has_files, true AS has_bytes, true AS no_empty_file
FROM lineitem GROUP BY l_linenumber""")
def scan_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, files and bytes per key folder from file metadata (counts vary by run: their invariants are shown)."""
    t = tables.read_table(spark, _kv_table(spark, sf_dir))
    rep = tables.scan_file_report(t, ["key"])
    return rep.select("key", "n_rows", F.col("n_files").between(1, F.col("n_rows")).alias("has_files"),
                      (F.col("n_bytes") > F.col("n_rows")).alias("has_bytes"), (F.col("min_file_rows") >= 1).alias("no_empty_file"))
