"""Registered queries for standing SQL and micro-batches (M1-M6, K5 as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.plans import fixtures as fx
from rivulet.plans.registry import make_registry
from rivulet.session import table, work_dir
from rivulet.sources import topics
from rivulet.sources.topic_source import register_topic_source
from rivulet.streaming import microbatch as mb

QUERIES, ORACLES, register = make_registry()

# Fixed value: fixture E splits the topic into this many files, added one by one.
STREAM_FILES = 3


def _add_file(spark: SparkSession, sf_dir: str, topic_dir: str, k: int) -> None:
    """Fixture E: the part topic lines with id % 3 = k arrive as one new file group."""
    rows = fx.part_rows(spark, sf_dir).where((F.col("id") % STREAM_FILES) == k)
    topics.write_topic(rows, f"{topic_dir}/g={k}", mode="errorifexists")


def _each_file(spark, sf_dir, start_query):
    """Add the fixture files one at a time, running the stream to the end after each."""
    topic_dir = work_dir(spark, "stream_topic")
    batches = []
    for k in range(STREAM_FILES):
        _add_file(spark, sf_dir, topic_dir, k)
        batches.append(mb.run_to_end(start_query(topic_dir)))
    return batches


@register("standing_query_filter", """
SELECT p_partkey AS id, p_name AS name, p_size AS age FROM part WHERE p_size = 25""")
def standing_query_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: ``select * from test where age = 25`` kept running over the topic as files arrive."""
    sink, ckpt = work_dir(spark, "m1_sink"), work_dir(spark, "m1_ckpt")
    _each_file(spark, sf_dir, lambda d: mb.standing_query(
        mb.topic_stream(spark, d, fx.PART_TOPIC_SCHEMA), "age = 25", sink, ckpt))
    return spark.read.parquet(sink).select("id", "name", "age")


# user_id declared as a byte: lines with ids above 127 are bad.
_NARROW_SCHEMA = "event_id bigint, ts string, user_id byte, event_type string, value double, props string"


@register("stream_dead_letters", """
SELECT event_id, user_id > 127 OR user_id < -128 AS rejected, CAST(event_id % 3 AS BIGINT) AS batch_id,
       CASE WHEN user_id BETWEEN -128 AND 127 THEN value END AS value,
       CASE WHEN user_id > 127 OR user_id < -128 THEN 'bad tinyint in field user_id' END AS reason
FROM events WHERE user_id > 127 OR user_id < -128 OR value > 10""")
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2/M1: a standing filter over the event topic whose lines don't all fit the declared schema.

    The topic arrives as three files, a micro-batch each; bad lines are kept
    with their reason and batch beside the good rows that pass the filter.
    """
    topic_dir, ckpt = work_dir(spark, "dl_topic"), work_dir(spark, "dl_ckpt")
    letters = mb.DeadLetterTopic(spark, work_dir(spark, "dl_out"), _NARROW_SCHEMA, "value > 10")
    log = fx.stored_event_log(spark, sf_dir)
    for k in range(STREAM_FILES):
        log.where(F.col("partition") == k).select("value").write.text(f"{topic_dir}/g={k}")
        mb.run_to_end(letters.start(spark.readStream.format("text").load(topic_dir), ckpt))
    good = letters.rows().select("event_id", F.lit(False).alias("rejected"), "batch_id", "value", F.lit(None).cast("string").alias("reason"))
    bad = letters.rejects().select(F.split("value", "\t")[0].cast("bigint").alias("event_id"), F.lit(True).alias("rejected"),
                                   "batch_id", F.lit(None).cast("double").alias("value"), "reason")
    return good.unionByName(bad)


@register("topic_source_stream", """
SELECT p_partkey AS id, p_name AS name, p_size AS age, CAST(p_partkey % 3 AS BIGINT) AS batch_id FROM part WHERE p_size = 25""")
def topic_source_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1/K5: the standing filter over a topic by name; each run goes on from the offsets of the run before."""
    register_topic_source(spark)
    path, out, ckpt = work_dir(spark, "ts_topic"), work_dir(spark, "ts_out"), work_dir(spark, "ts_ckpt")
    buf = mb.ResultBuffer(spark, out)
    for k in range(STREAM_FILES):
        rows = fx.part_rows(spark, sf_dir).where(F.col("id") % STREAM_FILES == k)
        rows.write.format("topic").mode("append").option("path", path).save()
        stream = spark.readStream.format("topic").schema(fx.PART_TOPIC_SCHEMA).option("path", path).load()
        mb.run_to_end(buf.start(stream.where("age = 25"), ckpt))
    return spark.read.parquet(f"{out}/rows").select("id", "name", "age", F.col("batch_id").cast("bigint"))


@register("topic_incremental_stream", """
SELECT CAST(p_partkey % 3 AS BIGINT) AS batch_id, p_partkey AS id, p_name AS name, p_size AS age FROM part""")
def topic_incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 as a stream: each run reads only lines added since the checkpointed position."""
    out, ckpt = work_dir(spark, "k5_sink"), work_dir(spark, "k5_ckpt")
    buf = mb.ResultBuffer(spark, out)
    _each_file(spark, sf_dir, lambda d: buf.start(mb.topic_stream(spark, d, fx.PART_TOPIC_SCHEMA), ckpt))
    return spark.read.parquet(f"{out}/rows").select(F.col("batch_id").cast("bigint"), "id", "name", "age")


@register("topic_view_incremental_sql", """
SELECT CAST(p_partkey % 3 AS INTEGER) + 1 AS run_no, p_size AS age, count(*) AS n FROM part GROUP BY 1, 2""")
def topic_view_incremental_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3/K5: one SELECT submitted again and again on a topic view; each run sees only the rows since the last."""
    topic_dir, out = work_dir(spark, "k5v_topic"), work_dir(spark, "k5v_out")
    view = mb.IncrementalTopicScan(spark, topic_dir, fx.PART_TOPIC_SCHEMA, work_dir(spark, "k5v_state"))
    for k in range(STREAM_FILES):
        _add_file(spark, sf_dir, topic_dir, k)
        result, token = view.sql("test_incremental", "SELECT age, count(*) AS n FROM test_incremental GROUP BY age")
        result.write.parquet(f"{out}/run_no={k + 1}")
        view.commit(token)
    return spark.read.parquet(out).select("run_no", "age", "n")


_UNION_CONDS = ["age < 10", "age BETWEEN 10 AND 30", "age > 40"]


@register("microbatch_union", " UNION ALL ".join(
    f"SELECT {i} AS query_no, p_partkey AS id, p_name AS name, p_size AS age FROM part "
    f"WHERE {c.replace('age', 'p_size')}" for i, c in enumerate(_UNION_CONDS)))
def microbatch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: three SQL texts queued on the topic; each micro-batch runs them all and stores their UNION ALL."""
    out, ckpt = work_dir(spark, "m2_out"), work_dir(spark, "m2_ckpt")
    standing = mb.StandingSql("test", out)
    for cond in _UNION_CONDS:
        standing.submit(f"SELECT * FROM test WHERE {cond}")
    _each_file(spark, sf_dir, lambda d: standing.start(mb.topic_stream(spark, d, fx.PART_TOPIC_SCHEMA), ckpt))
    return spark.read.parquet(out).select("query_no", "id", "name", "age")


def _purchase_value(term, row):
    return F.when(row["event_type"] == term, row["value"])


def _big_value(term, row):
    return F.when(row["value"] > term, row["value"])


@register("task_filter", """
SELECT event_id, event_type, value, value AS result FROM events WHERE event_type = 'purchase'""")
def task_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3/M6: a Single task over projected factors; rows the task rejects are dropped."""
    task = mb.Single("purchase", _purchase_value, "result")
    return mb.run_task(table(spark, sf_dir, "events"), ["event_id", "event_type", "value"], task)


@register("multi_task_map", """
SELECT event_id, event_type, value,
       CASE WHEN event_type = 'purchase' THEN value END AS purchase_value,
       CASE WHEN value > 50.0 THEN value END AS big_value
FROM events WHERE event_type = 'purchase' OR value > 50.0""")
def multi_task_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: a MultiTask is a list of tasks evaluated on the same projected row."""
    task = mb.MultiTask((mb.Single("purchase", _purchase_value, "purchase_value"),
                         mb.Single(50.0, _big_value, "big_value")))
    return mb.run_task(table(spark, sf_dir, "events"), ["event_id", "event_type", "value"], task)


@register("stream_append_sink", """
SELECT '[' || CAST(p_partkey AS VARCHAR) || ',' || p_name || ',' || CAST(p_size AS VARCHAR) || ']' AS value
FROM part""")
def stream_append_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: row text appended to a text sink, one append per micro-batch."""
    sink, ckpt = work_dir(spark, "m4_sink"), work_dir(spark, "m4_ckpt")
    _each_file(spark, sf_dir, lambda d: mb.append_text_sink(
        mb.topic_stream(spark, d, fx.PART_TOPIC_SCHEMA), ["id", "name", "age"], sink, ckpt))
    return spark.read.text(sink)


@register("result_drain", """
SELECT CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS drain_no, CAST(p_partkey % 3 AS INTEGER) AS batch_id,
       p_partkey AS id, p_name AS name, p_size AS age
FROM part""")
def result_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: results buffered per batch; a drain returns what is new since the last drain.

    Drain 1 follows the first file, drain 2 the other two, drain 3 finds nothing.
    """
    buf = mb.ResultBuffer(spark, work_dir(spark, "m5_buf"))
    ckpt, topic_dir = work_dir(spark, "m5_ckpt"), work_dir(spark, "m5_topic")
    keep = work_dir(spark, "m5_drained")

    def run():
        mb.run_to_end(buf.start(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ckpt))

    def drain():
        rows, token = buf.drain()
        rows.write.mode("append").parquet(keep)
        buf.commit(token)

    _add_file(spark, sf_dir, topic_dir, 0)
    run()
    drain()
    for k in range(1, STREAM_FILES):
        _add_file(spark, sf_dir, topic_dir, k)
        run()
    drain()
    drain()
    return spark.read.parquet(keep).select("drain_no", F.col("batch_id").cast("int"), "id", "name", "age")
