"""Topics as tables.

A *topic* here is a folder of text files, one TAB-separated message per line
(``format="text"``); a real broker source can be swapped in by passing a
different reader.  Next to it we keep a *topic log*: a Parquet table
``(partition, offset, value)`` whose offsets are dense per partition, so
that ranges ``[from, until)`` and saved positions are plain columns.

All operators take and return DataFrames.  Positions are persisted as small
Parquet tables and only advance after the scan that used them has been
written out, so a failed job re-reads the same range.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.session import last_committed, publish, remove_folder
from rivulet.functions.lines import (
    check_topic_schema, decode_columns, encode_line, line_is_clean, parse_schema, reject_reason, split_line,
    sql_str,
)

LOG_SCHEMA = "partition int, offset bigint, value string"
# Offsets in one folder of a stored log; a scan from a position opens only the folders at or past it.
LOG_BLOCK = 1_000_000


def _schema(schema: T.StructType | str) -> T.StructType:
    if isinstance(schema, str):
        schema = parse_schema(schema)
    check_topic_schema(schema)
    return schema


# --------------------------------------------------------------------- K1 / K2
def line_column(columns: list[str], check: bool = True, text_columns: list[str] | None = None) -> Column:
    """The topic line of ``columns``: fields in order, TAB-joined, nulls as ``null``.

    With ``check`` a text field containing TAB or a line break fails the job
    instead of silently producing a corrupt message.  ``text_columns`` names
    the fields that can hold one (default: all of them).
    """
    line = encode_line(*columns)
    if check:
        line = F.when(line_is_clean(*(columns if text_columns is None else text_columns)), line).otherwise(
            F.raise_error(F.lit("topic field contains TAB or line break")))
    return line


def text_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The string-typed columns among ``columns``."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return [c for c in columns if isinstance(types[c], T.StringType)]


def encode(df: DataFrame, columns: list[str] | None = None, check: bool = True) -> DataFrame:
    """K1: one ``value`` line per row."""
    columns = columns or df.columns
    return df.select(line_column(columns, check, text_columns(df, columns)).alias("value"))


def decode(lines: DataFrame, schema: T.StructType | str, value_col: str = "value",
           keep: list[str] | None = None) -> DataFrame:
    """Strict decode: a bad number, bad boolean or short line fails the job.

    Each line is split once into an array column that the field expressions read.
    """
    schema = _schema(schema)
    keep = keep or []
    split = lines.select(*keep, split_line(value_col).alias("_parts"))
    return split.select(*keep, *decode_columns("_parts", schema, strict=True, presplit=True))


def decode_lenient(lines: DataFrame, schema: T.StructType | str, value_col: str = "value",
                   keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects).  Rejects keep ``keep`` columns, the line and a reason."""
    schema = _schema(schema)
    keep = keep or []
    split = lines.select(*keep, F.col(value_col).alias("_line"), split_line(value_col).alias("_parts"))
    tagged = split.withColumn("_reason", reject_reason("_parts", schema, presplit=True))
    good = tagged.where(F.col("_reason").isNull()).select(
        *keep, *decode_columns("_parts", schema, strict=False, presplit=True))
    bad = tagged.where(F.col("_reason").isNotNull()).select(
        *keep, F.col("_line").alias("value"), F.col("_reason").alias("reason"))
    return good, bad


# --------------------------------------------------------------------- K3 / K7 / K8
def write_topic(df: DataFrame, path: str, mode: str = "append", columns: list[str] | None = None) -> None:
    """Write rows as topic lines.  ``mode``: append, overwrite, error/errorifexists, ignore."""
    encode(df, columns).write.mode(mode).text(path)


def create_topic_view(spark: SparkSession, name: str, schema: str, path: str, replace: bool = True) -> None:
    """Declare a topic as a SQL view that supports SELECT and INSERT INTO.

    Backed by Spark's CSV source with TAB separator and quoting off, so it
    reads and writes exactly the line form of :func:`encode`.  Deviation:
    the text ``null`` and empty fields read back as NULL.
    """
    _schema(schema)
    head = "CREATE OR REPLACE TEMPORARY VIEW" if replace else "CREATE TEMPORARY VIEW"
    spark.sql(
        f"""{head} {name} ({schema})
        USING csv
        OPTIONS (path {sql_str(path)}, sep '\\t', quote '', escape '', nullValue 'null', emptyValue '',
                 mode 'FAILFAST', header 'false')"""
    )


def read_topic(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Batch read of a topic folder with strict decoding."""
    return decode(spark.read.text(path), schema)


# --------------------------------------------------------------------- topic log
def build_log(lines: DataFrame, partition: Column, offset: Column) -> DataFrame:
    """Attach (partition, offset) to topic lines; offsets must be dense per partition."""
    return lines.select(partition.cast("int").alias("partition"), offset.cast("bigint").alias("offset"),
                        F.col("value"))


def write_log(log: DataFrame, path: str, mode: str = "append", block: int = LOG_BLOCK) -> None:
    """Store (partition, offset, value) in folders by topic partition and block of offsets."""
    rows = log.select("partition", "offset", "value", (F.col("offset") - F.pmod("offset", F.lit(block))).alias("block"))
    rows.hint("rebalance", "partition", "block").write.mode(mode).partitionBy("partition", "block").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stored log with its folder columns, which prune scans."""
    return spark.read.schema("partition int, block bigint, offset bigint, value string").parquet(path)


def _from_offset(log: DataFrame, partition: int, offset: int, block: int) -> Column:
    """Rows of one topic partition at or past an offset, with the folder they can be in."""
    cond = (F.col("partition") == partition) & (F.col("offset") >= offset)
    return cond & (F.col("block") > offset - block) if "block" in log.columns else cond


def offset_ranges(log: DataFrame, positions: DataFrame | None = None, block: int = LOG_BLOCK) -> DataFrame:
    """K6: per partition the half-open range still to read.

    ``from_offset`` is the saved position, or the earliest offset for a
    partition never read; ``until_offset`` is one past the latest offset.
    Only what lies past the positions is read to find it: the positions, one
    row per topic partition, become literal predicates on folders and offsets.
    """
    if positions is None:
        return log.groupBy("partition").agg(
            F.min("offset").alias("from_offset"), (F.max("offset") + 1).alias("until_offset"))
    known = [(r["partition"], r["offset"]) for r in positions.select("partition", "offset").collect()]
    rest = ~F.col("partition").isin([p for p, _ in known])
    for p, o in known:
        rest = rest | _from_offset(log, p, o, block)
    bounds = log.where(rest).groupBy("partition").agg(
        F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("latest"))
    saved = positions.select("partition", F.col("offset").alias("saved"))
    return bounds.join(saved, "partition", "full").select(
        "partition", F.coalesce("saved", "earliest").alias("from_offset"), F.coalesce("latest", "saved").alias("until_offset"))


def scan_ranges(log: DataFrame, ranges: DataFrame, block: int = LOG_BLOCK) -> DataFrame:
    """Rows of the log inside each partition's [from, until) range.

    ``ranges`` has one row per topic partition; they become literal
    predicates, so folders and row groups outside them are not opened.
    """
    inside = F.lit(False)
    for r in ranges.where("from_offset < until_offset").collect():
        part = _from_offset(log, r["partition"], r["from_offset"], block) & (F.col("offset") < r["until_offset"])
        inside = inside | (part & (F.col("block") < r["until_offset"]) if "block" in log.columns else part)
    return log.where(inside).select("partition", "offset", "value")


def scan(log: DataFrame, schema: T.StructType | str, positions: DataFrame | None = None) -> DataFrame:
    """K4: full (or from-position) scan of a topic log, decoded; a full scan reads the log once."""
    rows = log if positions is None else scan_ranges(log, offset_ranges(log, positions))
    return decode(rows, schema, keep=["partition", "offset"])


def create_log_view(spark: SparkSession, name: str, log_path: str, schema: T.StructType | str) -> DataFrame:
    """A SQL view over a stored topic log: (partition, offset, declared fields), decoded strictly."""
    view = scan(spark.read.parquet(log_path), schema)
    view.createOrReplaceTempView(name)
    return view


class PositionConflict(RuntimeError):
    """Another consumer has moved the position since the scan was planned; scan again."""


class TopicPositions:
    """Saved read positions of a topic log, shared by all consumers of one path (K5, batch form).

    The position is a log of numbered versions, each a small table of
    ``(partition, from_offset, offset, rows)``.  A version is written aside
    and then published under its number by a rename that fails if the number
    is taken, so of several consumers that scanned from the same version one
    commits; the others get :class:`PositionConflict`, and scan again from
    the new position.  Positions of partitions that a scan did not see stay,
    and none moves back.

    ``rows`` names the folder in which the rows of the scan were stored by
    :meth:`commit_rows`: rows and position become visible in one step, and
    rows whose commit failed are in no version.  What a scan reads is written
    down before it reads; if it fails before its commit, nothing has moved.
    """

    SCHEMA = "partition int, from_offset bigint, offset bigint, rows string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.refresh()

    def refresh(self) -> int:
        """Take up the last version that any consumer published."""
        self.version = last_committed(self.spark, self.path, "v") or 0
        return self.version

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/v={version}")

    def current(self) -> DataFrame | None:
        """(partition, offset) at this object's version, None at the start."""
        return self._manifest(self.version).select("partition", "offset") if self.version else None

    def _aside(self, label: str) -> str:
        return f"{self.path}/{label}/{uuid.uuid4().hex}"

    def fixed(self, ranges: DataFrame) -> DataFrame:
        """``ranges`` as they are now, stored with the version they start from: later reads see the same numbers."""
        path = self._aside("planned")
        ranges.withColumn("base", F.lit(self.version)).write.parquet(path)
        return self.spark.read.schema("partition int, from_offset bigint, until_offset bigint, base int").parquet(path)

    def commit(self, ranges: DataFrame, rows: str | None = None) -> int:
        """Publish the end of ``ranges`` as the next version; returns its number.

        Ranges of :meth:`fixed` know the version they were planned at; others
        count as planned at this object's version.
        """
        held = ranges.select("partition", "from_offset", "until_offset", *(["base"] if "base" in ranges.columns else [])).collect()
        base = max((r["base"] for r in held), default=self.version) if "base" in ranges.columns else self.version
        if base != self.version:
            raise PositionConflict(f"{self.path}: the scan was planned at version {base}, the position is at {self.version}")
        saved = {r["partition"]: r["offset"] for r in self.current().collect()} if base else {}
        for r in held:
            if r["until_offset"] < r["from_offset"] or r["until_offset"] < saved.get(r["partition"], r["until_offset"]):
                raise ValueError(f"{self.path}: partition {r['partition']} would move back to {r['until_offset']}")
            if saved.get(r["partition"], r["from_offset"]) != r["from_offset"]:
                raise ValueError(f"{self.path}: partition {r['partition']} is at {saved[r['partition']]}, the scan starts at {r['from_offset']}")
        seen = {r["partition"] for r in held}
        # One row per topic partition.
        entries = [(r["partition"], r["from_offset"], r["until_offset"], rows) for r in held]
        entries += [(p, o, o, None) for p, o in saved.items() if p not in seen]
        staged = self._aside("staged")
        self.spark.createDataFrame(entries, self.SCHEMA).coalesce(1).write.parquet(staged)
        if not publish(self.spark, staged, f"{self.path}/v={base + 1}"):
            remove_folder(self.spark, staged)
            raise PositionConflict(f"{self.path}: version {base + 1} is another consumer's")
        self.version = base + 1
        return self.version

    def commit_rows(self, rows: DataFrame, ranges: DataFrame) -> int:
        """Store ``rows`` and publish them together with the end of ``ranges``; on a conflict they are removed again."""
        path = self._aside("rows")
        rows.write.parquet(path)
        try:
            return self.commit(ranges, path.rsplit("/", 1)[1])
        except Exception:
            remove_folder(self.spark, path)
            raise

    def rows(self, schema: T.StructType | str, upto: int | None = None) -> DataFrame:
        """All rows committed with their positions up to a version (the last one), with its number as ``commit_no``."""
        upto = self.refresh() if upto is None else upto
        if not upto:
            return self.spark.createDataFrame([], _with_commit_no(schema))
        manifests = self.spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(*[f"{self.path}/v={v}" for v in range(1, upto + 1)])
        # A row for each commit.
        named = manifests.where("rows IS NOT NULL").select("v", "rows").distinct().orderBy("v").collect()
        if not named:
            return self.spark.createDataFrame([], _with_commit_no(schema))
        folder = F.regexp_extract(F.col("_metadata.file_path"), "/rows/([0-9a-f]+)/", 1)
        number = F.create_map(*[F.lit(x) for r in named for x in (r["rows"], int(r["v"]))])
        found = self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/{r['rows']}" for r in named])
        return found.select("*", F.element_at(number, folder).alias("commit_no"))


def _with_commit_no(schema: T.StructType | str) -> T.StructType:
    schema = parse_schema(schema) if isinstance(schema, str) else schema
    return T.StructType([*schema.fields, T.StructField("commit_no", T.IntegerType())])


def consume(log: Callable[[], DataFrame], positions: TopicPositions, decoded: Callable[[DataFrame], DataFrame], block: int = LOG_BLOCK,
            tries: int = 20) -> int | None:
    """Read what is new, store it and move the position in one step; returns the version, None if nothing was new.

    ``log`` gives the topic log as it is now, ``decoded`` the rows to store of
    the lines read.  If another consumer was faster, its rows are left to it
    and the scan starts again from its position.
    """
    for _ in range(tries):
        positions.refresh()
        lines, ranges = scan_incremental(log(), positions, block)
        if ranges.where("from_offset < until_offset").isEmpty():
            return None
        try:
            return positions.commit_rows(decoded(lines), ranges)
        except PositionConflict:
            continue
    raise PositionConflict(f"{positions.path}: {tries} scans were overtaken")


def scan_incremental(log: DataFrame, positions: TopicPositions, block: int = LOG_BLOCK) -> tuple[DataFrame, DataFrame]:
    """K5: rows after the saved position, and the (stored) ranges to commit once the rows are."""
    ranges = positions.fixed(offset_ranges(log, positions.current(), block))
    return scan_ranges(log, ranges, block), ranges


# --------------------------------------------------------------------- K9 / K10
def rate_limited_ranges(ranges: DataFrame, secs: float, max_rate: int = 0, rate: float | None = None) -> DataFrame:
    """K9: cap each partition's next range by a rate estimate and a hard cap.

    ``ranges`` has (partition, cur, latest), one row per topic partition, so
    the whole-table window below sees at most the topic's partition count.
    """
    whole = Window.partitionBy()
    lag = F.greatest(F.col("latest") - F.col("cur"), F.lit(0))
    df = ranges.withColumn("lag", lag).withColumn("total_lag", F.sum("lag").over(whole))
    if rate is not None and rate > 0:
        share = F.try_divide(F.col("lag").cast("double"), F.col("total_lag").cast("double"))
        bp = F.floor(F.coalesce(share, F.lit(0.0)) * F.lit(float(rate)) + F.lit(0.5))
        limit = F.least(bp, F.lit(max_rate)) if max_rate > 0 else bp
    else:
        limit = F.lit(max_rate)
    df = df.withColumn("limit", limit.cast("bigint")).withColumn("total_limit", F.sum("limit").over(whole))
    until = F.when(F.col("total_limit") > 0,
                   F.least(F.col("cur") + F.floor(F.lit(float(secs)) * F.col("limit")), F.col("latest"))
                   ).otherwise(F.col("latest"))
    return df.select("partition", "cur", "latest", "limit", until.cast("bigint").alias("until_offset"))


def frequency_expand(df: DataFrame, message: str, count: str, piece: int = 1_000_000) -> DataFrame:
    """A (message, n) row becomes n copies of the message, numbered 1..n; none for a null or n below 1.

    Counts are cut into pieces of at most ``piece`` copies, and the pieces are
    spread over tasks before they are expanded, so one message asking for a
    third of all copies does not fall on one task.
    """
    n = F.col(count).cast("bigint")
    starts = F.when(n >= 1, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(piece).cast("bigint")))
    pieces = (df.select(F.col(message).alias("message"), n.alias("_n"), F.explode(starts).alias("_start"))
              .repartition("message", "_start"))
    upto = F.least(F.col("_start") + F.lit(piece), F.col("_n"))
    return pieces.select("message", F.explode(F.sequence(F.col("_start") + 1, upto)).alias("copy_no"))
