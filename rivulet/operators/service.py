"""The SQL service as data (V1-V2): run any SQL text, render results as JSON.

No HTTP here: a request is a function call, a response is a DataFrame of
JSON documents.  Results are rendered per chunk -- a bounded slice of rows
-- never gathered into one document on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.indexing import index_within_groups
from rivulet.functions.lines import row_text

# Result codes and success texts of the response envelope.
SUCCESS, ERROR = 0, -1
RESULT_TEXT, ACCEPTED_TEXT = "get result succeed", "succeed"


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """V1: any SQL text over the registered views."""
    return spark.sql(text)


def result_columns(spark: SparkSession, text: str) -> list[str]:
    """Column names of a query's result (analysis only, nothing runs)."""
    return spark.sql(text).columns


def _envelope(msg: Column, code: int) -> Column:
    return F.struct(msg.alias("msg"), F.lit(code).alias("resultCode"))


def json_chunks(df: DataFrame, order: list[str], msg: str = RESULT_TEXT, chunk_rows: int = 1000) -> DataFrame:
    """V2: ``{"response":{msg,resultCode:0},"data":[row text...]}`` per chunk of ``chunk_rows`` rows.

    Rows are numbered in ``order`` (range partitioned, no task holds the whole
    result), cut into chunks, and each chunk becomes one JSON document.  A
    result without rows is one document ``{msg,resultCode}``.
    """
    texts = df.select(*order, row_text(*df.columns).alias("_text"))
    numbered = index_within_groups(texts, [], order, name="_i").select(
        F.expr(f"_i div {int(chunk_rows)}").alias("chunk_no"), F.struct("_i", "_text").alias("_row"))
    # one row that carries no text, so that there is a first chunk even without rows
    first = df.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("chunk_no"), F.lit(None).cast(numbered.schema["_row"].dataType).alias("_row"))
    chunks = (numbered.unionByName(first).groupBy("chunk_no")
              .agg(F.transform(F.array_sort(F.collect_list("_row")), lambda s: s["_text"]).alias("data")))
    doc = F.when(F.size("data") > 0, F.to_json(F.struct(_envelope(F.lit(msg), SUCCESS).alias("response"), F.col("data")))) \
        .otherwise(F.to_json(_envelope(F.lit(msg), SUCCESS)))
    return chunks.select("chunk_no", doc.alias("json"))


def json_message(spark: SparkSession, msg: str, code: int = SUCCESS) -> DataFrame:
    """A response without data: ``{"msg":...,"resultCode":...}``."""
    return spark.range(1).select(F.to_json(_envelope(F.lit(msg), code)).alias("json"))


def try_sql(spark: SparkSession, text: str) -> tuple[DataFrame | None, DataFrame]:
    """Analyse a SQL text; returns (result or None, response envelope)."""
    try:
        df = spark.sql(text)
        return df, json_message(spark, ACCEPTED_TEXT, SUCCESS)
    except Exception as exc:  # noqa: BLE001 -- every analysis error becomes an error response
        return None, json_message(spark, str(exc), ERROR)
