"""Registered queries for topics-as-tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.lines import sql_str

from rivulet.plans import fixtures as fx
from rivulet.plans.registry import make_registry
from rivulet.session import table, work_dir
from rivulet.sources import topics
from rivulet.sources.topic_source import Topic, register_topic_source

QUERIES, ORACLES, register = make_registry()


# Fixed value: offsets in a folder of the fixture's stored log.
LOG_BLOCK = 10_000


# Split point of the two-append fixtures: ids below it arrive first.
def _split_point(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "part").agg(((F.max("p_partkey") + 1).cast("bigint") / 2).cast("bigint")
                                           .alias("split"))


_SPLIT_SQL = "(SELECT CAST((max(p_partkey) + 1) // 2 AS BIGINT) FROM part)"


def _write_part_topic(spark: SparkSession, sf_dir: str, where: str | None = None) -> str:
    path = work_dir(spark, "topic")
    rows = fx.part_rows(spark, sf_dir)
    if where:
        rows = rows.where(where)
    topics.write_topic(rows, path, mode="errorifexists")
    return path


@register("topic_encode", """
SELECT p_partkey AS id,
       concat_ws(chr(9), CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type,
                 CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)) AS value
FROM part""")
def topic_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cols = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    return p.select(F.col("p_partkey").alias("id"),
                    topics.line_column(cols, text_columns=topics.text_columns(p, cols)).alias("value"))


@register("topic_decode", """
SELECT CAST(event_id % 3 AS INTEGER) AS partition, event_id // 3 AS "offset",
       event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, value, props
FROM events""")
def topic_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the stored event topic log decoded strictly by its declared schema."""
    log = fx.stored_event_log(spark, sf_dir)
    return topics.decode(log, fx.EVENT_TOPIC_SCHEMA, keep=["partition", "offset"])


# user_id declared as a byte: ids above 127 cannot be parsed and are rejected.
_REJECT_SCHEMA = "event_id bigint, ts string, user_id byte, event_type string, value double, props string"


@register("topic_decode_rejects", """
SELECT CAST(event_id % 3 AS INTEGER) AS partition, event_id // 3 AS "offset",
       'bad tinyint in field user_id' AS reason
FROM events WHERE user_id > 127 OR user_id < -128""")
def topic_decode_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 lenient: lines of the stored event log that do not fit a narrower schema, with the reason."""
    log = fx.stored_event_log(spark, sf_dir)
    _good, bad = topics.decode_lenient(log, _REJECT_SCHEMA, keep=["partition", "offset"])
    return bad.select("partition", "offset", "reason")


@register("topic_view_sql", """
SELECT p_partkey AS id, p_name AS name, p_size AS age FROM part WHERE p_size = 25""")
def topic_view_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: topic lines -> declared SQL view -> standing filter, as batch."""
    path = _write_part_topic(spark, sf_dir)
    topics.create_topic_view(spark, "test", fx.PART_TOPIC_SCHEMA, path)
    return spark.sql("SELECT * FROM test WHERE age = 25")


_PART_LOG_SQL = """
SELECT CAST(p_partkey % 3 AS INTEGER) AS partition, p_partkey // 3 AS "offset",
       p_partkey AS id, p_name AS name, p_size AS age
FROM part"""


@register("topic_scan", _PART_LOG_SQL)
def topic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.part_log(spark, sf_dir).drop("id")
    return topics.scan(log, fx.PART_TOPIC_SCHEMA)


def _two_appends(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Write fixture C as two appends to a log table: ids below the split, then the rest."""
    path = work_dir(spark, "topiclog")
    # the split is a scalar subquery over part, planned once as its own tiny aggregate
    tagged = fx.part_log(spark, sf_dir).withColumn("split", _split_point(spark, sf_dir).scalar())
    topics.write_log(tagged.where(F.col("id") < F.col("split")), path, "errorifexists", LOG_BLOCK)
    return path, tagged


@register("topic_incremental_scan", f"""
SELECT CASE WHEN p_partkey < {_SPLIT_SQL} THEN 1 ELSE 2 END AS scan_no,
       CAST(p_partkey % 3 AS INTEGER) AS partition, p_partkey // 3 AS "offset",
       p_partkey AS id, p_name AS name, p_size AS age
FROM part""")
def topic_incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tagged = _two_appends(spark, sf_dir)
    positions = topics.TopicPositions(spark, work_dir(spark, "positions"))
    out = work_dir(spark, "scans")
    # first scan: everything present so far, from the earliest offsets
    rows, ranges = topics.scan_incremental(topics.read_log(spark, path), positions, LOG_BLOCK)
    topics.decode(rows, fx.PART_TOPIC_SCHEMA, keep=["partition", "offset"]) \
        .withColumn("scan_no", F.lit(1)).write.mode("errorifexists").parquet(f"{out}/scan=1")
    positions.commit(ranges)
    # the rest of the topic arrives
    topics.write_log(tagged.where(F.col("id") >= F.col("split")), path, "append", LOG_BLOCK)
    # second scan: only what arrived after the committed positions
    rows, ranges = topics.scan_incremental(topics.read_log(spark, path), positions, LOG_BLOCK)
    topics.decode(rows, fx.PART_TOPIC_SCHEMA, keep=["partition", "offset"]) \
        .withColumn("scan_no", F.lit(2)).write.mode("errorifexists").parquet(f"{out}/scan=2")
    positions.commit(ranges)
    return spark.read.parquet(f"{out}/scan=1", f"{out}/scan=2").select(
        "scan_no", "partition", "offset", "id", "name", "age")


@register("topic_offset_ranges", f"""
SELECT CAST(p_partkey % 3 AS INTEGER) AS partition,
       max(CASE WHEN p_partkey < {_SPLIT_SQL} THEN p_partkey // 3 END) + 1 AS from_offset,
       max(p_partkey // 3) + 1 AS until_offset
FROM part GROUP BY 1""")
def topic_offset_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tagged = _two_appends(spark, sf_dir)
    positions = topics.TopicPositions(spark, work_dir(spark, "positions"))
    _rows, ranges = topics.scan_incremental(topics.read_log(spark, path), positions, LOG_BLOCK)
    positions.commit(ranges)
    topics.write_log(tagged.where(F.col("id") >= F.col("split")), path, "append", LOG_BLOCK)
    return topics.offset_ranges(topics.read_log(spark, path), positions.current(), LOG_BLOCK)


@register("topic_exactly_once", f"""
SELECT CASE WHEN p_partkey < {_SPLIT_SQL} THEN 1 ELSE 2 END AS commit_no,
       CASE WHEN p_partkey < {_SPLIT_SQL} THEN 0 ELSE 1 END AS conflicts,
       CAST(p_partkey % 3 AS INTEGER) AS partition, p_partkey // 3 AS "offset",
       p_partkey AS id, p_name AS name, p_size AS age
FROM part""")
def topic_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: two consumers share a position.  Both scan the first half; one commits, the other is refused and
    reads on from there, once the rest has arrived.  ``conflicts`` counts the refusals before a row's commit."""
    path, tagged = _two_appends(spark, sf_dir)
    shared = work_dir(spark, "positions")
    one, other = topics.TopicPositions(spark, shared), topics.TopicPositions(spark, shared)
    rows = lambda lines: topics.decode(lines, fx.PART_TOPIC_SCHEMA, keep=["partition", "offset"])
    scans = [(p, *topics.scan_incremental(topics.read_log(spark, path), p, LOG_BLOCK)) for p in (one, other)]
    refused = []
    for positions, lines, ranges in scans:
        try:
            positions.commit_rows(rows(lines), ranges)
        except topics.PositionConflict:
            refused.append(positions)
    topics.write_log(tagged.where(F.col("id") >= F.col("split")), path, "append", LOG_BLOCK)
    for positions in refused:
        topics.consume(lambda: topics.read_log(spark, path), positions, rows, LOG_BLOCK)
    out = one.rows(f"partition int, offset bigint, {fx.PART_TOPIC_SCHEMA}")
    conflicts = F.when(F.col("commit_no") > 1, F.lit(len(refused))).otherwise(F.lit(0))
    return out.select("commit_no", conflicts.alias("conflicts"), "partition", "offset", "id", "name", "age")


@register("topic_using_source", """
SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_size % 7 = 0 THEN 'null' ELSE p_name END AS name, p_size AS age,
       CASE WHEN p_size <= 25 THEN 'first' ELSE 'second' END AS seen
FROM part""")
def topic_using_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3/K5/K7: a topic by name in DDL, filled by two INSERTs; the second is read from the offsets that the first
    reached.  The text ``null`` stays a text."""
    register_topic_source(spark)
    path = work_dir(spark, "topic_source")
    rows = fx.part_rows(spark, sf_dir).withColumn("name", F.when(F.col("age") % 7 == 0, "null").otherwise(F.col("name")))
    rows.createOrReplaceTempView("topic_using_rows")

    def view(name: str, options: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} ({fx.PART_TOPIC_SCHEMA}) USING topic OPTIONS (path {sql_str(path)}, {options})")

    view("topic_using", "partitions '3'")
    spark.sql("INSERT INTO topic_using SELECT id, name, age FROM topic_using_rows WHERE age <= 25")
    reached = json.dumps(Topic(path).latest())
    view("topic_using_old", f"endingOffsets {sql_str(reached)}")
    view("topic_using_new", f"startingOffsets {sql_str(reached)}")
    spark.sql("INSERT INTO topic_using SELECT id, name, age FROM topic_using_rows WHERE age > 25")
    return spark.sql("SELECT *, 'first' AS seen FROM topic_using_old UNION ALL SELECT *, 'second' AS seen FROM topic_using_new")


@register("topic_insert_append", """
SELECT p_partkey AS id, p_name AS name, p_size AS age FROM part""")
def topic_insert_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _write_part_topic(spark, sf_dir, where="age <= 25")
    topics.create_topic_view(spark, "topic_k7", fx.PART_TOPIC_SCHEMA, path)
    fx.part_rows(spark, sf_dir).where("age > 25").createOrReplaceTempView("topic_k7_src")
    spark.sql("INSERT INTO TABLE topic_k7 SELECT id, name, age FROM topic_k7_src")
    return spark.sql("SELECT * FROM topic_k7")


@register("topic_save_modes", """
WITH n AS (SELECT count(*) FILTER (WHERE p_size <= 25) AS old_rows, count(*) AS new_rows FROM part)
SELECT 'append' AS mode, 'written' AS outcome, old_rows + new_rows AS row_count FROM n
UNION ALL SELECT 'overwrite', 'written', new_rows FROM n
UNION ALL SELECT 'errorifexists', 'error', old_rows FROM n
UNION ALL SELECT 'ignore', 'skipped', old_rows FROM n""")
def topic_save_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: each save mode applied to its own copy of a topic holding the ages <= 25."""
    rows = fx.part_rows(spark, sf_dir)
    results = []
    for mode in ("append", "overwrite", "errorifexists", "ignore"):
        path = _write_part_topic(spark, sf_dir, where="age <= 25")
        try:
            outcome = "skipped" if mode == "ignore" else "written"
            topics.write_topic(rows, path, mode=mode)
        except Exception as exc:  # the mode refused the write
            if "already exists" not in str(exc).lower() and "PATH_ALREADY_EXISTS" not in str(exc):
                raise
            outcome = "error"
        n = spark.read.text(path).agg(F.count(F.lit(1)).alias("row_count"))
        results.append(n.select(F.lit(mode).alias("mode"), F.lit(outcome).alias("outcome"), "row_count"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


@register("rate_limited_offsets", f"""
WITH r AS (
  SELECT CAST(p_partkey % 3 AS INTEGER) AS partition,
         max(CASE WHEN p_partkey < {_SPLIT_SQL} THEN p_partkey // 3 END) + 1 AS cur,
         max(p_partkey // 3) + 1 AS latest
  FROM part GROUP BY 1),
l AS (SELECT *, greatest(latest - cur, 0) AS lag FROM r),
b AS (SELECT *, CAST(least(floor(coalesce(lag::DOUBLE / nullif(sum(lag) OVER (), 0), 0.0) * 500.0 + 0.5),
                           150) AS BIGINT) AS "limit" FROM l)
SELECT partition, cur, latest, "limit",
       CAST(CASE WHEN sum("limit") OVER () > 0 THEN least(cur + floor(2.0 * "limit"), latest)
                 ELSE latest END AS BIGINT) AS until_offset
FROM b""")
def rate_limited_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: next ranges after the first committed scan, rate 500/s estimate, cap 150/s, 2 s batches."""
    log = fx.part_log(spark, sf_dir).withColumn("split", _split_point(spark, sf_dir).scalar())
    cur = (log.groupBy("partition")
           .agg((F.max(F.when(F.col("id") < F.col("split"), F.col("offset"))) + 1).alias("cur"),
                (F.max("offset") + 1).alias("latest")))
    return topics.rate_limited_ranges(cur, secs=2.0, max_rate=150, rate=500.0)


@register("frequency_expand", """
SELECT concat_ws(chr(9), CAST(p_partkey AS VARCHAR), p_name, CAST(p_size AS VARCHAR)) AS message,
       CAST(g.copy_no AS BIGINT) AS copy_no
FROM part, generate_series(1, p_size) AS g(copy_no)""")
def frequency_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's topic line repeated p_size times."""
    lines = fx.part_lines(spark, sf_dir, keep=("age",))
    return topics.frequency_expand(lines, "value", "age")
