"""Standing queries: reruns see only new files; batches union to the batch answer."""

import os

import pytest
from pyspark.sql import functions as F

from rivulet.plans import fixtures as fx
from rivulet.session import work_dir
from rivulet.sources import topics
from rivulet.streaming import microbatch as mb


def _add(spark, sf_dir, topic_dir, k):
    rows = fx.part_rows(spark, sf_dir).where(F.col("id") % 3 == k)
    topics.write_topic(rows, f"{topic_dir}/g={k}", mode="errorifexists")


def test_rerun_without_new_files_commits_nothing(spark, sf_dir):
    topic_dir, sink, ckpt = (work_dir(spark, x) for x in ("t", "sink", "ckpt"))
    start = lambda: mb.standing_query(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA),
                                      "age >= 0", sink, ckpt)
    _add(spark, sf_dir, topic_dir, 0)
    assert mb.run_to_end(start()) == 0
    n0 = spark.read.parquet(sink).count()
    assert mb.run_to_end(start()) is None          # nothing new: no batch
    assert spark.read.parquet(sink).count() == n0
    _add(spark, sf_dir, topic_dir, 1)
    assert mb.run_to_end(start()) == 1              # only the new file
    got = spark.read.parquet(sink)
    expected = fx.part_rows(spark, sf_dir).where(F.col("id") % 3 < 2)
    assert got.count() == expected.count()
    assert got.select("id", "name", "age").exceptAll(expected).count() == 0


def test_result_buffer_drains_once(spark, sf_dir):
    topic_dir, ckpt = work_dir(spark, "t"), work_dir(spark, "ckpt")
    buf = mb.ResultBuffer(spark, work_dir(spark, "buf"))
    assert buf.drain()[0] is None
    _add(spark, sf_dir, topic_dir, 0)
    mb.run_to_end(buf.start(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ckpt))
    want = fx.part_rows(spark, sf_dir).where(F.col("id") % 3 == 0).count()
    assert buf.drain()[0].count() == want
    rows, token = buf.drain()              # the consumer of the first drain failed: nothing is lost
    assert rows.count() == want
    buf.commit(token)
    assert buf.drain()[0].count() == 0


def test_result_queue_union_and_empty(spark, sf_dir):
    fx.part_rows(spark, sf_dir).createOrReplaceTempView("test_q")
    q = mb.ResultQueue(spark, fx.PART_TOPIC_SCHEMA)
    assert q.next_batch().count() == 0
    q.submit("SELECT * FROM test_q WHERE age = 25")
    q.submit("SELECT * FROM test_q WHERE age = 25")
    b = q.next_batch()
    assert b.count() == 2 * fx.part_rows(spark, sf_dir).where("age = 25").count()
    assert q.next_batch().count() == 0


def test_multi_task_keeps_row_if_any_task_does(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 60.0), (3, "c", 2.0)], "id long, t string, v double")
    task = mb.MultiTask((mb.Single("a", lambda term, r: F.when(r["t"] == term, r["v"]), "x"),
                         mb.Single(50.0, lambda term, r: F.when(r["v"] > term, r["v"]), "y")))
    assert sorted(r["id"] for r in mb.run_task(df, ["id", "t", "v"], task).collect()) == [1, 2]


def test_result_buffer_mark_survives_restart(spark, sf_dir):
    topic_dir, ckpt, path = work_dir(spark, "t"), work_dir(spark, "ckpt"), work_dir(spark, "buf")
    buf = mb.ResultBuffer(spark, path)
    _add(spark, sf_dir, topic_dir, 0)
    mb.run_to_end(buf.start(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ckpt))
    rows, token = buf.drain()
    assert rows.count() > 0
    assert mb.ResultBuffer(spark, path).drain()[0].count() == rows.count()
    buf.commit(token)
    again = mb.ResultBuffer(spark, path)
    assert (again.drains, again.mark) == (1, 0)
    assert again.drain()[0].count() == 0


def test_live_trigger_processes_available(spark, sf_dir):
    topic_dir, sink, ckpt = (work_dir(spark, x) for x in ("t", "sink", "ckpt"))
    _add(spark, sf_dir, topic_dir, 0)
    q = mb.standing_query(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), "age = 25", sink, ckpt,
                          available_now=False)
    try:
        q.processAllAvailable()
        _add(spark, sf_dir, topic_dir, 1)
        q.processAllAvailable()
    finally:
        q.stop()
    want = fx.part_rows(spark, sf_dir).where((F.col("id") % 3 < 2) & (F.col("age") == 25)).count()
    assert spark.read.parquet(sink).count() == want


def test_decode_stream_from_any_value_source(spark):
    """A broker-like source: any stream with a ``value`` column decodes the same way."""
    src = spark.readStream.format("rate").option("rowsPerSecond", 50).load() \
        .select(F.concat_ws("\t", F.col("value").cast("string"), F.lit("x")).alias("value"))
    q = mb.decode_stream(src, "n long, tag string").writeStream.format("memory").queryName("rate_decoded") \
        .option("checkpointLocation", work_dir(spark, "rate_ckpt")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.table("rate_decoded").collect()
    assert all(r["tag"] == "x" for r in rows)


def test_incremental_topic_scan_returns_only_new_rows(spark, sf_dir):
    topic_dir, state = work_dir(spark, "t"), work_dir(spark, "state")
    inc = mb.IncrementalTopicScan(spark, topic_dir, fx.PART_TOPIC_SCHEMA, state)
    _add(spark, sf_dir, topic_dir, 0)
    inc.scan()                                 # a scan whose rows are never used
    first, token = mb.IncrementalTopicScan(spark, topic_dir, fx.PART_TOPIC_SCHEMA, state).scan()
    assert first.count() == fx.part_rows(spark, sf_dir).where(F.col("id") % 3 == 0).count()
    inc.commit(token)
    assert inc.scan()[0].count() == 0
    _add(spark, sf_dir, topic_dir, 1)
    again = mb.IncrementalTopicScan(spark, topic_dir, fx.PART_TOPIC_SCHEMA, state)   # a restarted reader
    got, _ = again.scan()
    assert got.count() == fx.part_rows(spark, sf_dir).where(F.col("id") % 3 == 1).count()
    assert got.where(F.col("id") % 3 != 1).count() == 0


def test_task_with_pandas_function(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 60.0)], "id long, v double")

    def keep_big(term, pdf):
        return pdf[pdf["v"] > term]

    out = mb.run_task_pandas(df, ["id", "v"], keep_big, 50.0, "id long, v double")
    assert [tuple(r) for r in out.collect()] == [(2, 60.0)]


def test_standing_sql_texts_apply_from_next_batch(spark, sf_dir):
    topic_dir, out, ckpt = work_dir(spark, "t"), work_dir(spark, "out"), work_dir(spark, "ckpt")
    standing = mb.StandingSql("stu", out)
    standing.submit("SELECT id, age FROM stu WHERE age = 25")
    _add(spark, sf_dir, topic_dir, 0)
    mb.run_to_end(standing.start(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ckpt))
    standing.submit("SELECT id, age FROM stu WHERE age = 1")       # a text submitted later
    _add(spark, sf_dir, topic_dir, 1)
    mb.run_to_end(standing.start(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ckpt))
    got = spark.read.parquet(out)
    rows = fx.part_rows(spark, sf_dir)
    assert got.where("batch_id = 0 AND query_no = 1").count() == 0
    assert got.where("batch_id = 1 AND query_no = 1").count() == rows.where("id % 3 = 1 AND age = 1").count()
    assert got.where("query_no = 0").count() == rows.where("id % 3 < 2 AND age = 25").count()


def test_union_standing_conditions(spark, sf_dir):
    topic_dir, sink, ckpt = work_dir(spark, "t"), work_dir(spark, "sink"), work_dir(spark, "ckpt")
    _add(spark, sf_dir, topic_dir, 2)
    s = mb.union_standing(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ["age < 5", "age > 45"])
    mb.run_to_end(s.writeStream.format("parquet").option("checkpointLocation", ckpt)
                  .trigger(availableNow=True).start(sink))
    rows = fx.part_rows(spark, sf_dir).where("id % 3 = 2")
    assert spark.read.parquet(sink).count() == rows.where("age < 5 OR age > 45").count()


def test_first_text_sees_rows_that_came_before_it(spark, sf_dir):
    topic_dir, out, ckpt = work_dir(spark, "t"), work_dir(spark, "out"), work_dir(spark, "ckpt")
    standing = mb.StandingSql("late", out)
    run = lambda: mb.run_to_end(standing.start(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ckpt))
    _add(spark, sf_dir, topic_dir, 0)
    run()                                      # no text yet
    standing.submit("SELECT id FROM late")
    _add(spark, sf_dir, topic_dir, 1)
    run()
    got = sorted(r["id"] for r in standing.results(spark).collect())
    assert got == sorted(r["id"] for r in fx.part_rows(spark, sf_dir).where("id % 3 < 2").collect())


def test_waiting_rows_need_no_new_file(spark, sf_dir):
    topic_dir, out, ckpt = work_dir(spark, "t"), work_dir(spark, "out"), work_dir(spark, "ckpt")
    standing = mb.StandingSql("late2", out)
    run = lambda: mb.run_to_end(standing.start(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ckpt))
    _add(spark, sf_dir, topic_dir, 0)
    run()
    standing.submit("SELECT id FROM late2")
    run()
    run()
    assert standing.results(spark).count() == fx.part_rows(spark, sf_dir).where("id % 3 = 0").count()


def test_results_of_different_columns_unite(spark, sf_dir):
    fx.part_rows(spark, sf_dir).createOrReplaceTempView("test_mix")
    q = mb.ResultQueue(spark, fx.PART_TOPIC_SCHEMA)
    q.submit("SELECT id FROM test_mix WHERE age = 25")
    q.submit("SELECT id, name AS b FROM test_mix WHERE age = 25")
    q.submit("SELECT 'text' AS id")
    b = q.next_batch()
    n = fx.part_rows(spark, sf_dir).where("age = 25").count()
    assert b.count() == 2 * n + 1 and dict(b.dtypes)["id"] == "string"
    assert b.where("query_no = 0 AND b IS NULL").count() == n == b.where("query_no = 1 AND b IS NOT NULL").count()

    topic_dir, out, ckpt = work_dir(spark, "t"), work_dir(spark, "out"), work_dir(spark, "ckpt")
    standing = mb.StandingSql("mix", out)
    standing.submit("SELECT id FROM mix")
    standing.submit("SELECT age, count(*) AS n FROM mix GROUP BY age")
    _add(spark, sf_dir, topic_dir, 0)
    mb.run_to_end(standing.start(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ckpt))
    got = standing.results(spark)
    rows = fx.part_rows(spark, sf_dir).where("id % 3 = 0")
    assert got.where("query_no = 0").count() == rows.count() == got.agg(F.sum("n")).first()[0]


# --------------------------------------------------------------------- dead letters
DL_SCHEMA = "id int, value double, reason string"
LINES = [["1\t2.5\tok", "x\t1\tbad id", "2\t7.5\tgood", ""], ["3\t1.0", "4\t9.5\ta\textra", "\t\t", "5\tnan?\tz"], ["99999999999\t1\tbig", "6\t8.0\tlast"]]


def _letters(spark, out, topic_dir, ckpt, condition=None):
    letters = mb.DeadLetterTopic(spark, out, DL_SCHEMA, condition)
    return letters, lambda: mb.run_to_end(letters.start(spark.readStream.format("text").load(topic_dir), ckpt))


def test_bad_lines_do_not_stop_a_stream(spark):
    topic_dir, out, ckpt = (work_dir(spark, x) for x in ("t", "dl", "ckpt"))
    letters, run = _letters(spark, out, topic_dir, ckpt)
    assert letters.rows().collect() == letters.rejects().collect() == []
    for k, lines in enumerate(LINES):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{topic_dir}/g={k}")
        assert run() == k
    good = sorted((r["id"], r["value"], r["batch_id"]) for r in letters.rows().collect())
    assert good == [(1, 2.5, 0), (2, 7.5, 0), (4, 9.5, 1), (6, 8.0, 2)]
    bad = {r["value"]: (r["reason"], r["batch_id"]) for r in letters.rejects().collect()}
    assert bad["x\t1\tbad id"] == ("bad int in field id", 0) and bad["3\t1.0"] == ("missing field reason", 1)
    assert bad["5\tnan?\tz"][0] == "bad double in field value" and bad["99999999999\t1\tbig"][0] == "bad int in field id"
    assert len(good) + len(bad) == sum(map(len, LINES))


def test_a_replayed_batch_doubles_nothing(spark):
    """The run is lost after a batch's rows were written, before the stream noted it."""
    topic_dir, out, ckpt = (work_dir(spark, x) for x in ("t", "dl", "ckpt"))
    letters, run = _letters(spark, out, topic_dir, ckpt, "value > 5")
    for k, lines in enumerate(LINES):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{topic_dir}/g={k}")
        run()
    before = [sorted(map(str, t.collect())) for t in (letters.rows(), letters.rejects())]
    assert [r["id"] for r in letters.rows().orderBy("id").collect()] == [2, 4, 6] and letters.rejects().count() == 6
    for name in ("2", ".2.crc"):
        os.unlink(f"{ckpt.removeprefix('file:')}/commits/{name}")
    letters, run = _letters(spark, out, topic_dir, ckpt, "value > 5")
    assert run() == 2
    assert [sorted(map(str, t.collect())) for t in (letters.rows(), letters.rejects())] == before
    # a batch whose write never ended is not there at all
    os.unlink(f"{out.removeprefix('file:')}/batch_id=1/_SUCCESS")
    assert {r["batch_id"] for r in letters.rejects().collect()} == {0, 2}


def test_two_readers_of_one_buffer(spark, sf_dir):
    topic_dir, ckpt, path = (work_dir(spark, x) for x in ("t", "ckpt", "buf"))
    one = mb.ResultBuffer(spark, path)
    _add(spark, sf_dir, topic_dir, 0)
    mb.run_to_end(one.start(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ckpt))
    other = mb.ResultBuffer(spark, path)
    tokens = [b.drain()[1] for b in (one, other)]
    one.commit(tokens[0])
    with pytest.raises(mb.PositionConflict):
        other.commit(tokens[1])
    other.refresh()
    assert other.mark == one.mark and other.drain()[0].count() == 0
    with pytest.raises(ValueError, match="move back"):
        other.commit(-1)


# --------------------------------------------------------------------- texts that outlive the driver
def test_a_restarted_driver_finds_texts_and_waiting_rows(spark, sf_dir):
    topic_dir, out, ckpt = work_dir(spark, "t"), work_dir(spark, "out"), work_dir(spark, "ckpt")
    run = lambda s: mb.run_to_end(s.start(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ckpt))
    _add(spark, sf_dir, topic_dir, 0)
    run(mb.StandingSql("reg", out, spark))              # rows without a text
    mb.StandingSql("reg", out, spark).submit("SELECT id FROM reg WHERE age > 25")
    _add(spark, sf_dir, topic_dir, 1)
    run(mb.StandingSql("reg", out, spark))              # another driver: the text and the rows are still there
    assert mb.StandingSql("reg", out, spark).submit("SELECT id FROM reg WHERE age <= 25") == 1
    _add(spark, sf_dir, topic_dir, 2)
    last = mb.StandingSql("reg", out, spark)
    run(last)
    got = sorted((r["batch_id"], r["query_no"], r["id"]) for r in last.results(spark).collect())
    want = [(r["id"] % 3, 0 if r["age"] > 25 else 1, r["id"]) for r in fx.part_rows(spark, sf_dir).collect() if r["age"] > 25 or r["id"] % 3 == 2]
    assert got == sorted(want)
    assert not [f for f in os.listdir(f"{out.removeprefix('file:')}-waiting") if f.startswith("batch_id")]


def test_a_replayed_batch_runs_the_texts_it_ran_before(spark, sf_dir):
    topic_dir, out, ckpt = work_dir(spark, "t"), work_dir(spark, "out"), work_dir(spark, "ckpt")
    run = lambda s: mb.run_to_end(s.start(mb.topic_stream(spark, topic_dir, fx.PART_TOPIC_SCHEMA), ckpt))
    one = mb.StandingSql("rep", out, spark)
    one.submit("SELECT id FROM rep")
    for k in (0, 1):
        _add(spark, sf_dir, topic_dir, k)
        run(one)
        if not k:
            one.submit("SELECT -id AS id FROM rep")
    before = sorted(map(str, one.results(spark).collect()))
    for name in ("1", ".1.crc"):
        os.unlink(f"{ckpt.removeprefix('file:')}/commits/{name}")
    run(mb.StandingSql("rep", out, spark))
    assert sorted(map(str, one.results(spark).collect())) == before
    assert one.results(spark).where("batch_id = 0 AND query_no = 1").count() == 0


def test_texts_submitted_at_once_all_count(spark):
    from concurrent.futures import ThreadPoolExecutor
    out = work_dir(spark, "out")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: mb.StandingSql("many", out, spark).submit(f"SELECT {k} AS k"), range(8)))
    assert sorted(numbers) == list(range(8))
    assert sorted(t for _, t in mb.StandingSql("many", out, spark)._texts(0)) == [f"SELECT {k} AS k" for k in range(8)]
