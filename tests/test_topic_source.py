"""Topics by name: DDL, SELECT, INSERT, offset ranges, streams, failed and competing writers."""

import json
import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.sources import topics
from rivulet.sources.topic_source import Topic, decoded, number_text, register_topic_source
from rivulet.streaming import microbatch as mb

FIELDS = "id int, name string, age int"


@pytest.fixture
def topic(spark, tmp_path):
    register_topic_source(spark)
    return str(tmp_path / "t")


def _view(spark, name, path, fields=FIELDS, **options):
    given = ", ".join(f"{k} '{v}'" for k, v in {"path": path, **options}.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} ({fields}) USING topic OPTIONS ({given})")


def test_view_insert_and_select(spark, topic):
    _view(spark, "tv", topic)
    assert spark.sql("SELECT * FROM tv").collect() == []
    spark.sql("INSERT INTO tv VALUES (1, 'amy', 25), (2, '', 30), (3, 'null', 25), (4, 'zoë', 7)")
    spark.sql("INSERT INTO tv SELECT id + 10, name, age FROM tv WHERE age = 25")
    got = sorted(map(tuple, spark.sql("SELECT * FROM tv").collect()))
    assert got == [(1, "amy", 25), (2, "", 30), (3, "null", 25), (4, "zoë", 7), (11, "amy", 25), (13, "null", 25)]
    raw = spark.read.format("topic").option("path", topic).load()
    assert sorted(r["value"] for r in raw.collect())[:2] == ["1\tamy\t25", "11\tamy\t25"]
    # offsets are dense in each partition
    for p, rows in {p: [r["offset"] for r in raw.collect() if r["partition"] == p] for p in range(3)}.items():
        assert sorted(rows) == list(range(len(rows)))
    spark.sql("INSERT OVERWRITE tv VALUES (9, 'new', 1)")
    assert [tuple(r) for r in spark.sql("SELECT * FROM tv").collect()] == [(9, "new", 1)]


def test_reads_what_the_line_decoder_reads(spark, topic):
    """Every type, signs, specials and odd texts: the same rows as decode() gives for the same lines."""
    fields = "a byte, b short, c int, d bigint, e float, f double, g boolean, h string"
    rows = [(1, -2, 3, 2**62, 1.5, 0.1, True, "x"), (-128, 32767, 0, -1, 1e10, 1e-5, False, ""), (0, 0, 0, 0, 3.4e38, 1.7e308, True, "null"),
            (7, 7, 7, 7, float("inf"), float("-inf"), False, " pad "), (8, 8, 8, 8, 123456.78, 12345678.9, True, "é "), (9, 9, 9, 9, 0.0, -0.0, True, "1.0E7")]
    df = spark.createDataFrame(rows, fields)
    df.write.format("topic").mode("append").option("path", topic).save()
    raw = spark.read.format("topic").option("path", topic).load()
    assert sorted(r["value"] for r in raw.collect()) == sorted(r["value"] for r in topics.encode(df).collect())
    # the last field of one row is empty, so its line ends in a TAB and is short, for both
    with pytest.raises(Exception, match="missing field 7"):
        spark.read.format("topic").schema(fields).option("path", topic).load().collect()
    want = topics.decode(raw.where("NOT endswith(value, '\t')"), fields).collect()
    part = topic + "-good"
    df.where("h != ''").write.format("topic").mode("append").option("path", part).save()
    got = spark.read.format("topic").schema(fields).option("path", part).load().collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 5


@pytest.mark.parametrize("line", ["1\tamy", "x\tamy\t25", "1\tamy\t2.5", "99999999999\tw\t1", "\t\t", "1\tw\t", " 1\tw\t2", ""])
def test_bad_lines_fail(spark, line):
    with pytest.raises(ValueError):
        decoded(pa.array(["5\tok\t5", line]), [("id", "int"), ("name", "string"), ("age", "int")])
    with pytest.raises(Exception):
        topics.decode(spark.createDataFrame([(line,)], "value string"), FIELDS).collect()


def test_decoding_edges():
    assert decoded(pa.array(["+5\ta\t-0\textra", "007\t\t3"]), [("id", "int"), ("n", "string"), ("k", "bigint")])[0].to_pylist() == [5, 7]
    assert decoded(pa.array([""]), [("s", "string")])[0].to_pylist() == [""]
    assert [c.to_pylist() for c in decoded(pa.array([], pa.string()), [("s", "string"), ("i", "int")])] == [[], []]
    assert decoded(pa.array(["1d", " 2.5F ", ".5", "1e3"]), [("x", "double")])[0].to_pylist() == [1.0, 2.5, 0.5, 1000.0]
    with pytest.raises(ValueError, match="bad double"):
        decoded(pa.array(["1_000"]), [("x", "double")])
    assert [number_text(x, False) for x in (1.0, 1e7, 0.001, 1e-4, 123.25)] == ["1.0", "1.0E7", "0.001", "1.0E-4", "123.25"]


def test_offset_ranges_open_only_their_segments(spark, topic):
    for k in range(4):
        spark.range(k * 100, k * 100 + 100).selectExpr("CAST(id AS INT) id", "'n' name", "1 age").coalesce(1).write.format("topic").mode("append").option("path", topic).option("partitions", 1).save()
    assert Topic(topic).latest() == {0: 400}
    _view(spark, "part_of", topic, f"{FIELDS}, _offset bigint", startingOffsets='{"0": 150}', endingOffsets='{"0": 320}', maxOffsetsPerTask=50, tasksPerPartition=2)
    rows = spark.sql("SELECT id, _offset FROM part_of").collect()
    assert sorted(r["id"] for r in rows) == [r["_offset"] for r in sorted(rows, key=lambda r: r["_offset"])] == list(range(150, 320))
    first, last = (next(s for s in Topic(topic).segments() if s[1] == at) for at in (0, 300))
    os.unlink(f"{topic}/data/{first[3]}")  # never opened
    assert spark.sql("SELECT count(*) FROM part_of").first()[0] == 170
    assert Topic(topic).segments({0: 300}) == [last]


def test_stream_restarts_from_its_offsets(spark, topic, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    _view(spark, "sv", topic)
    spark.sql("INSERT INTO sv VALUES (1, 'a', 25), (2, 'b', 1), (3, 'c', 25)")
    start = lambda: mb.standing_query(spark.readStream.format("topic").schema(FIELDS).option("path", topic).load(), "age = 25", out, ckpt)
    assert mb.run_to_end(start()) is not None
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 3]
    spark.sql("INSERT INTO sv VALUES (4, 'd', 25)")
    spark.sql("INSERT INTO sv VALUES (5, 'e', 2)")
    mb.run_to_end(start())
    mb.run_to_end(start())
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 3, 4]


def test_a_failed_insert_leaves_nothing(spark, topic):
    _view(spark, "fv", topic)
    spark.sql("INSERT INTO fv VALUES (1, 'a', 1)")
    bad = spark.range(50).select(F.col("id").cast("int"), F.when(F.col("id") == 49, F.lit("a\tb")).otherwise(F.lit("x")).alias("name"), F.lit(1).alias("age"))
    with pytest.raises(Exception, match="TAB"):
        bad.repartition(4).write.format("topic").mode("append").option("path", topic).save()
    assert spark.sql("SELECT * FROM fv").count() == 1 and sum(Topic(topic).latest().values()) == 1


def test_competing_writers_share_the_offsets(spark, tmp_path):
    path = str(tmp_path / "w")

    def write(k):
        t = Topic(path)
        t.files.create_dir(f"{t.root}/data")
        for i in range(10):
            with t.files.open_output_stream(f"{t.root}/data/{k}-{i}.txt") as f:
                f.write(f"{k}\t{i}\n".encode())
            t.publish([(f"{k}-{i}.txt", 1)], 2, False)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    segments = Topic(path).segments()
    for p in (0, 1):
        places = [s[1:3] for s in segments if s[0] == p]
        assert [lo for lo, _ in places] == list(range(len(places)))
    assert len({s[3] for s in segments}) == 40 and sum(Topic(path).latest().values()) == 40
    assert json.loads(open(f"{path}/log/{1:020d}.json").read())["before"] == {}


def test_refused_types(spark, topic):
    with pytest.raises(Exception, match="topic field 'd' has type date"):
        spark.read.format("topic").schema("d date").option("path", topic).load().collect()


def test_workers_need_no_copy(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from rivulet.session import get_session\n"
            "from rivulet.sources.topic_source import register_topic_source\n"
            "s = get_session('local[2]', 2)\n"
            "register_topic_source(s)\n"
            f"s.sql(\"CREATE TEMPORARY VIEW t (id int, name string) USING topic OPTIONS (path '{tmp_path}/x')\")\n"
            "s.sql(\"INSERT INTO t VALUES (1, 'a'), (2, 'b')\")\n"
            "print('GOT', s.sql('SELECT sum(id) FROM t').first()[0])\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GOT 3" in out.stdout, out.stderr[-2000:]
