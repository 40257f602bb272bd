"""Standing SQL over a topic as Structured Streaming micro-batches (M1-M6).

A standing query is ``readStream`` over the topic folder, the strict TAB
decode, the query's filter/projection, and a sink with a checkpoint.  The
checkpoint is the consumer position: a rerun with nothing new commits no
batch, and a new file yields only its rows.  Live use triggers every second;
tests and the registered queries use ``availableNow`` so each call processes
what is there and stops.

Sinks are idempotent per batch id (file sink commit log, or a per-batch
partition overwritten on retry), so a lost executor or a replayed batch
never duplicates results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rivulet.functions.lines import decode_columns, ident, reject_reason, row_text, split_line
from rivulet.session import committed_values, is_committed, last_committed, publish, remove_folder
from rivulet.sources.topics import PositionConflict, _schema

# Fixed value: the reference's micro-batch interval.  Its standing query was
# re-submitted every 500 ms; one streaming query replaces that loop here.
BATCH_INTERVAL = "1 second"


# --------------------------------------------------------------------- sources
def topic_stream(spark: SparkSession, topic_dir: str, schema: T.StructType | str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming rows of a topic folder, decoded strictly by ``schema``."""
    schema = _schema(schema)
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    parts = reader.load(topic_dir).select(split_line("value").alias("_parts"))
    return parts.select(*decode_columns("_parts", schema, strict=True, presplit=True))


def decode_stream(stream: DataFrame, schema: T.StructType | str, value_col: str = "value") -> DataFrame:
    """Decode any stream with a text or binary ``value`` column, e.g. ``readStream.format("kafka")``.

    A broker source plugs in here in place of the folder source:
    ``decode_stream(spark.readStream.format("kafka").option("subscribe", t)...load(), schema)``.
    """
    schema = _schema(schema)
    lines = stream.select(F.col(value_col).cast("string").alias("value"))
    parts = lines.select(split_line("value").alias("_parts"))
    return parts.select(*decode_columns("_parts", schema, strict=True, presplit=True))


def decode_tagged(stream: DataFrame, schema: T.StructType | str, value_col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Every line of a stream (or table): ``keep`` columns, ``value``, ``reason`` and ``row``, the decoded struct.

    ``reason`` is null for a good line; ``row`` is null for a bad one, also
    for a null value.  Nothing fails, whatever the line holds.
    """
    schema = _schema(schema)
    lines = stream.select(*(keep or []), F.col(value_col).cast("string").alias("value"))
    parts = lines.withColumn("_parts", split_line("value"))
    reason = F.when(F.col("value").isNull(), F.lit("null value")).otherwise(reject_reason("_parts", schema, presplit=True))
    row = F.struct(*decode_columns("_parts", schema, strict=False, presplit=True))
    return parts.withColumn("reason", reason).select(*(keep or []), "value", "reason", F.when(F.col("reason").isNull(), row).alias("row"))


def _trigger(writer, available_now: bool, interval: str = BATCH_INTERVAL):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


# --------------------------------------------------------------------- M1
def standing_query(stream: DataFrame, condition: Column | str, sink_path: str, checkpoint: str,
                   available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    """Run a filter over every new row of ``stream`` and append matches to a file sink."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    w = (stream.where(cond).writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint))
    return _trigger(w, available_now).start(sink_path)


def run_to_end(q: StreamingQuery) -> int | None:
    """Wait for an availableNow query; returns the last batch id (None if no batch ran)."""
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    ran = [p["batchId"] for p in q.recentProgress if p.get("numInputRows", 0) > 0]
    return max(ran) if ran else None


class DeadLetterTopic:
    """A topic's stream in which bad lines are kept aside instead of stopping it (K2 on a stream).

    Each micro-batch is decoded once and written in one job: good rows under
    ``rejected=false``, bad lines with the first problem found under
    ``rejected=true``, both inside the folder of the batch id.  The folder
    becomes visible as a whole when its write has ended and is replaced when
    the batch is replayed, so good rows and rejects always add up to the
    lines read, and none is there twice.

    ``condition`` is a standing filter on the good rows; what it drops is in
    neither table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, condition: Column | str | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = _schema(schema)
        self.condition = F.expr(condition) if isinstance(condition, str) else condition

    def _stored_schema(self) -> T.StructType:
        text = [T.StructField(c, T.StringType()) for c in ("value", "reason")]
        return T.StructType([T.StructField("row", self.schema), *text, T.StructField("rejected", T.BooleanType()), T.StructField("batch_id", T.LongType())])

    def _on_batch(self, lines: DataFrame, batch_id: int) -> None:
        tagged = decode_tagged(lines, self.schema)
        bad = F.col("reason").isNotNull()
        out = tagged.select("row", F.when(bad, F.col("value")).alias("value"), "reason", bad.alias("rejected"))
        if self.condition is not None:
            # The condition sees the declared fields only; the rest goes along as one struct.
            kept = out.select(F.struct("*").alias("_all"), "row.*").where(F.col("_all.rejected") | self.condition)
            out = kept.select("_all.*")
        out.write.mode("overwrite").partitionBy("rejected").parquet(f"{self.path}/batch_id={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """``stream`` has the topic's lines in a ``value`` column, as the text and broker sources give them."""
        w = stream.select(F.col("value").cast("string").alias("value")).writeStream.foreachBatch(self._on_batch)
        return _trigger(w.option("checkpointLocation", checkpoint), available_now).start()

    def _stored(self) -> DataFrame:
        done = committed_values(self.spark, self.path, "batch_id")
        if not done:
            return self.spark.createDataFrame([], self._stored_schema())
        reader = self.spark.read.schema(self._stored_schema()).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/batch_id={b}" for b in done])

    def rows(self) -> DataFrame:
        """The good rows of all finished batches, with ``batch_id``."""
        return self._stored().where(~F.col("rejected")).select("row.*", "batch_id")

    def rejects(self) -> DataFrame:
        """``value, reason, batch_id`` of the bad lines of all finished batches."""
        return self._stored().where("rejected").select("value", "reason", "batch_id")


# --------------------------------------------------------------------- M2
def union_results(frames: list[DataFrame], schema: T.StructType | str | None = None,
                  spark: SparkSession | None = None) -> DataFrame:
    """UNION ALL of queued results; no input gives an empty frame of ``schema``.

    Results may have any columns: they unite by name, a column that a result
    lacks is null in its rows, and one whose type differs between results is
    text.  Union keeps each input's partitions as they are: no shuffle.
    """
    if not frames:
        if schema is None or spark is None:
            raise ValueError("an empty queue needs a schema and a session")
        return spark.createDataFrame([], schema)
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for field_ in f.schema.fields:
            kinds.setdefault(field_.name, set()).add(field_.dataType.simpleString())
    mixed = {c for c, k in kinds.items() if len(k) > 1}
    alike = [f.select(*[F.col(ident(c)).cast("string").alias(c) if c in mixed else F.col(ident(c)) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alike)


@dataclass
class ResultQueue:
    """SQL texts submitted at any time; each drain runs and unions all of them."""

    spark: SparkSession
    schema: T.StructType | str
    pending: list[str] = field(default_factory=list)

    def submit(self, sql_text: str) -> None:
        self.pending.append(sql_text)

    def next_batch(self) -> DataFrame:
        batch, self.pending = self.pending, []
        frames = [self.spark.sql(q).withColumn("query_no", F.lit(i)) for i, q in enumerate(batch)]
        if not frames:
            schema = _schema(self.schema) if isinstance(self.schema, str) else self.schema
            schema = T.StructType(schema.fields + [T.StructField("query_no", T.IntegerType(), False)])
            return self.spark.createDataFrame([], schema)
        return union_results(frames)


def union_standing(stream: DataFrame, conditions: list[Column | str]) -> DataFrame:
    """Several standing filters over one stream, unioned into one micro-batch output."""
    parts = []
    for i, c in enumerate(conditions):
        cond = F.expr(c) if isinstance(c, str) else c
        parts.append(stream.where(cond).withColumn("query_no", F.lit(i)))
    return union_results(parts)


class StandingSql:
    """SQL texts, submitted at any time, run over every micro-batch of new topic rows.

    Each batch's new rows are the view ``view``; every submitted SQL text runs
    on them and the results are unioned (with ``query_no``) and stored under
    the batch id, overwriting on replay.  The texts are a numbered registry
    beside the results: any session may submit one, and a restarted driver
    finds them all.  The first batch that sees a text is noted as its start,
    so a batch that is replayed runs the same texts again.  Rows that arrive
    while there is no text are kept and handed to the first ones, under their
    own batch ids; they are removed when their results are stored.
    """

    def __init__(self, view: str, out_path: str, spark: SparkSession | None = None):
        self.view = view
        self.out = out_path.rstrip("/")
        self.waiting = f"{self.out}-waiting"
        self.registry = f"{self.out}-texts"
        self.spark = spark or SparkSession.active()
        self.known: list[tuple[str, int | None]] = []  # texts read so far, with their start

    def _publish(self, value, kind: str, path: str) -> bool:
        staged = f"{self.registry}/staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(value,)], f"x {kind}").coalesce(1).write.parquet(staged)
        if publish(self.spark, staged, path):
            return True
        remove_folder(self.spark, staged)
        return False

    def submit(self, sql_text: str) -> int:
        """Register a text; returns its ``query_no``."""
        n = (last_committed(self.spark, f"{self.registry}/texts", "n") or 0) + 1
        while not self._publish(sql_text, "string", f"{self.registry}/texts/n={n}"):
            n += 1
        return n - 1

    def _texts(self, batch_id: int) -> list[tuple[int, str]]:
        """(query_no, text) of the texts for a batch; those that no batch has seen yet start with it."""
        read = lambda path: self.spark.read.parquet(path).first()["x"]
        for n in committed_values(self.spark, f"{self.registry}/texts", "n", above=len(self.known)):
            path = f"{self.registry}/starts/n={n}"
            if not is_committed(self.spark, path):
                self._publish(batch_id, "bigint", path)
            self.known.append((read(f"{self.registry}/texts/n={n}"), read(path)))
        return [(i, text) for i, (text, start) in enumerate(self.known) if start <= batch_id]

    def _run(self, batch: DataFrame, batch_id: int, texts: list[tuple[int, str]]) -> None:
        # every text reads the batch: decode it once
        batch.persist()
        try:
            batch.createOrReplaceTempView(self.view)
            session = batch.sparkSession
            frames = [session.sql(t).withColumn("query_no", F.lit(i)) for i, t in texts]
            union_results(frames).write.mode("overwrite").parquet(f"{self.out}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    def _run_waiting(self, spark: SparkSession) -> None:
        waiting = committed_values(spark, self.waiting, "batch_id")
        if not waiting or not self._texts(waiting[0]):
            return
        for i in waiting:
            if not is_committed(spark, f"{self.out}/batch_id={i}"):
                self._run(spark.read.parquet(f"{self.waiting}/batch_id={i}"), i, self._texts(i))
            remove_folder(spark, f"{self.waiting}/batch_id={i}")

    def _on_batch(self, batch: DataFrame, batch_id: int) -> None:
        self._run_waiting(batch.sparkSession)
        if texts := self._texts(batch_id):
            self._run(batch, batch_id, texts)
        else:
            batch.write.mode("overwrite").parquet(f"{self.waiting}/batch_id={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        self._run_waiting(stream.sparkSession)
        w = stream.writeStream.foreachBatch(self._on_batch).option("checkpointLocation", checkpoint)
        return _trigger(w, available_now).start()

    def results(self, spark: SparkSession) -> DataFrame:
        """All stored results; batches whose texts gave other columns unite by name."""
        return spark.read.option("mergeSchema", "true").parquet(self.out)


# --------------------------------------------------------------------- M3 / M6
@dataclass(frozen=True)
class Single:
    """One task: ``fn(term, row)`` returns a value for the row, or null to drop it."""

    term: object
    fn: Callable[[Column, Column], Column]
    name: str = "result"


@dataclass(frozen=True)
class MultiTask:
    """Several tasks over the same projected row; a row survives if any task keeps it."""

    tasks: tuple


def run_task(df: DataFrame, factors: list[str], task: Single | MultiTask) -> DataFrame:
    """``select <factors> from df`` then apply the task(s); all-null rows are dropped (M3)."""
    projected = df.select(*factors)
    row = F.struct(*[F.col(c) for c in factors])
    tasks = task.tasks if isinstance(task, MultiTask) else (task,)
    outs = [t.fn(F.lit(t.term), row).alias(t.name) for t in tasks]
    keep = reduce(lambda a, b: a | b, [F.col(t.name).isNotNull() for t in tasks])
    return projected.select(*factors, *outs).where(keep)


def run_task_pandas(df: DataFrame, factors: list[str], fn, term, out_schema: str) -> DataFrame:
    """Task with a Python function over Arrow batches: ``fn(term, pdf) -> pdf`` (rows with no match dropped)."""
    projected = df.select(*factors)

    def apply(batches):
        for pdf in batches:
            out = fn(term, pdf)
            if out is not None and len(out):
                yield out

    return projected.mapInPandas(apply, out_schema)


# --------------------------------------------------------------------- M4
def append_text_sink(stream: DataFrame, columns: list[str], sink_path: str, checkpoint: str,
                     available_now: bool = True) -> StreamingQuery:
    """Each output row's text ``[a,b,c]`` appended to a text sink per batch."""
    out = stream.select(row_text(*columns).alias("value"))
    w = out.writeStream.format("text").outputMode("append").option("checkpointLocation", checkpoint)
    return _trigger(w, available_now).start(sink_path)


# --------------------------------------------------------------------- M5
class ResultBuffer:
    """Per-batch results kept in a table; a drain returns what is new, its commit advances a mark.

    ``sink`` is a ``foreachBatch`` function.  It overwrites the folder of its
    batch id, so a replayed batch replaces rather than duplicates its rows.
    The drain mark is a small table of (drain_no, mark) rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.refresh()

    def refresh(self) -> None:
        """Resume after the last drain that any reader committed."""
        self.drains = last_committed(self.spark, f"{self.path}/marks", "drain_no") or 0
        self.mark = -1
        if self.drains:
            self.mark = int(self.spark.read.parquet(f"{self.path}/marks/drain_no={self.drains}").first()["mark"])

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/batch_id={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        w = stream.writeStream.foreachBatch(self.sink).option("checkpointLocation", checkpoint)
        return _trigger(w, available_now).start()

    def drain(self) -> tuple[DataFrame | None, int]:
        """(rows, token): rows of finished batches past the mark, tagged with the number of this drain.

        Rows are None if no batch has ever finished.  Until ``commit(token)``
        the next drain returns the same rows again, so a consumer that fails
        between the two loses nothing.
        """
        new = committed_values(self.spark, f"{self.path}/rows", "batch_id", above=self.mark)
        last = new[-1] if new else last_committed(self.spark, f"{self.path}/rows", "batch_id")
        if last is None:
            return None, self.mark
        reader = self.spark.read.option("basePath", f"{self.path}/rows")
        rows = reader.parquet(*[f"{self.path}/rows/batch_id={b}" for b in new or [last]])
        rows = rows if new else rows.where(F.lit(False))
        return rows.withColumn("drain_no", F.lit(self.drains + 1)), max(self.mark, last)

    def commit(self, token: int) -> None:
        """Advance the mark to a drain's token, after its rows have been used.

        Of several readers of one buffer that drained from the same mark, one
        commits; the others get :class:`PositionConflict` and drain again
        (:meth:`refresh`).  The mark never moves back.
        """
        if token < self.mark:
            raise ValueError(f"{self.path}: the mark would move back from {self.mark} to {token}")
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(token,)], "mark int").coalesce(1).write.parquet(staged)
        if not publish(self.spark, staged, f"{self.path}/marks/drain_no={self.drains + 1}"):
            remove_folder(self.spark, staged)
            raise PositionConflict(f"{self.path}: drain {self.drains + 1} was committed by another reader")
        self.drains += 1
        self.mark = token


# --------------------------------------------------------------------- K5 on a topic folder
class IncrementalTopicScan:
    """Each committed :meth:`scan` moves on; the next one returns the topic rows added since.

    The consumer position is a streaming checkpoint and a drain mark: a scan
    runs the topic stream once with ``availableNow`` into a per-batch result
    buffer and drains what is past the mark.  A new object on the same
    ``state_dir`` resumes where the last one stopped; a scan that is not
    committed is returned again.
    """

    def __init__(self, spark: SparkSession, topic_dir: str, schema: T.StructType | str, state_dir: str):
        self.spark = spark
        self.topic_dir = topic_dir
        self.schema = _schema(schema)
        self.state = state_dir.rstrip("/")
        self.buffer = ResultBuffer(spark, f"{self.state}/results")

    def scan(self) -> tuple[DataFrame, int]:
        """(rows since the last commit, token for :meth:`commit`)."""
        stream = topic_stream(self.spark, self.topic_dir, self.schema)
        run_to_end(self.buffer.start(stream, f"{self.state}/checkpoint"))
        drained, token = self.buffer.drain()
        if drained is None:
            return self.spark.createDataFrame([], self.schema), token
        return drained.select(*self.schema.fieldNames()), token

    def sql(self, view: str, text: str) -> tuple[DataFrame, int]:
        """(result, token) of a SQL text in which ``view`` holds the topic's rows since the last commit.

        The same SELECT, submitted again after a commit, sees only what has arrived since.
        """
        rows, token = self.scan()
        rows.createOrReplaceTempView(view)
        return self.spark.sql(text), token

    def commit(self, token: int) -> None:
        self.buffer.commit(token)
