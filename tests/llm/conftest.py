import duckdb
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(sf_dir):
    """Rows of the small documents table, read without Spark."""
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf_dir}/documents.parquet'").fetchall()


@pytest.fixture(scope="session")
def store(spark, tmp_path_factory):
    """Rows as a stored table, as the operators ask for."""

    def make(rows, schema):
        path = str(tmp_path_factory.mktemp("table") / "t")
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
        return spark.read.parquet(path)

    return make


LONG = "lorem ipsum dolor " * 40_000

ODD_ROWS = [
    (1, "same words here in this text now", "x"),
    (1, "same words here in this text now", "x"),
    (2, "same words here in this text now", None),
    (None, "same words here in this text now", "y"),
    (3, None, "x"),
    (4, "", "x"),
    (5, " \t\n", None),
    (6, "!!! 123 ???", "x"),
    (7, LONG, "x"),
    (8, "zażółć gęślą jaźń \U0001f600 日本語 текст", "x"),
]


@pytest.fixture(scope="session")
def odd(store):
    """Nulls, repeated rows and ids, ties, empty and very long texts, and columns that clash with the operators' own."""
    docs = store(ODD_ROWS, "doc_id long, text string, lang string")
    for name in ("_row", "salt", "score", "kept", "fp", "spans", "items", "n_words", "matches", "lang_pred", "n_chars", "h1", "key"):
        docs = docs.withColumn(name, F.lit("mine"))
    return docs


@pytest.fixture(scope="session")
def none(store):
    return store([], "doc_id long, text string, lang string")
