"""Helpers shared by the operators: tables, row ids, shared work folders, byte blocks."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.session import work_dir

#: The six characters of ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a row number that is the same on every scan of its table.

    Rows with equal or null ids stay apart by it.  For Parquet files it is the
    file's place in the order of paths and the row's place in the file, so it
    depends neither on how files are split into tasks nor on which executors
    are there.  The table that numbers the files is broadcast: it has a row a
    file, as the file listing that the driver holds anyway.  Any other input
    is first written to the shared folder with its numbers.
    """
    path, at, file = (fresh(df, c) for c in ("_path", "_row_index", "_file"))
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
        files = df.select(F.col("_metadata.file_path").alias(path)).distinct()
    except AnalysisException:
        return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    files = files.withColumn(file, F.row_number().over(Window.orderBy(path)).cast("long"))
    placed = placed.join(F.broadcast(files), path)
    return placed.select(*df.columns, F.shiftleft(file, 32).bitwiseOR(F.col(at)).alias(name))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: lineage ends here."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of ``value`` as a function that gives it back on a worker.

    Spark pickles what it broadcasts by reference, so a worker would have to
    import the classes of this package.  Here the value travels as bytes that
    hold its classes and functions too; a task unpacks them once.
    """
    held, unpacked = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> object:
        if not unpacked:
            unpacked.append(pickle.loads(held.value))
        return unpacked[0]

    return get


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def byte_blocks(texts: pa.Array | pa.ChunkedArray, most: int = 1 << 21):
    """Rows of a text column as blocks ``(first row, offsets, bytes)`` of about ``most`` bytes.

    A row is never cut: a longer text is a block by itself.  Null is empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


#: DuckDB: the byte table of crc32 as ``crc_table(t)``, for a recursive WITH.
CRC_SQL = """crc_steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc_steps WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned crc32 of an ASCII text, beside ``crc_table``."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: ascii(substr({text}, k, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"
