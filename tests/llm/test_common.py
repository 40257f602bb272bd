import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rivulet.llm.common import byte_blocks, with_row


def test_rows_keep_their_numbers_however_files_are_split(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = {r["_row"]: r["doc_id"] for r in with_row(docs.select("doc_id")).collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        again = {r["_row"]: r["doc_id"] for r in with_row(docs).select("_row", "doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert first == again and len(first) == docs.count()


def test_rows_of_many_files_and_of_no_file(spark, store):
    table = store([(i % 3, None) for i in range(40)], "doc_id long, text string")
    assert with_row(table).select("_row").distinct().count() == 40
    assert with_row(table.where("false")).count() == 0
    frame = with_row(spark.range(30).withColumn("_row_index", F.lit(1)).withColumn("_file", F.lit(2)), "n")
    assert frame.columns == ["id", "_row_index", "_file", "n"]
    assert sorted(map(tuple, frame.select("n", "id").collect())) == sorted(map(tuple, frame.select("n", "id").collect()))


def test_byte_blocks_hold_whole_rows():
    texts = pa.chunked_array([pa.array(["ab", None, "", "é" * 5]), pa.array(["x" * 50, "y"])])
    got = []
    for first, offsets, data in byte_blocks(texts, 8):
        assert first == len(got) and len(data) == offsets[-1] and offsets[0] == 0
        got += [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == ["ab", "", "", "é" * 5, "x" * 50, "y"]
    assert list(byte_blocks(pa.array([], pa.string()))) == []
    sliced = pa.array(["a", "bb", "ccc"]).slice(1)
    assert [d.tobytes() for _, _, d in byte_blocks(sliced)] == [b"bbccc"] and np.array_equal(next(byte_blocks(sliced))[1], [0, 2, 5])
