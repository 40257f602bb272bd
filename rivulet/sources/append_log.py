"""An append-only table whose batches are merged as they age.

The folder has segments ``data/segment=<id>`` and numbered versions ``v=<n>``:
small tables ``(first, last, segment, n_rows)`` that name the segments which
make up the log and the batches each holds.  Appends and merges write a new
segment beside the others and publish a version that names it, by a rename
that one of several writers wins.  A reader has the segments of one version,
so it sees every row once, also while segments are merged.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.session import _hadoop_path, committed_values, last_committed, publish, remove_folder

_MANIFEST = "first bigint, last bigint, segment string, n_rows bigint"


class Segment(NamedTuple):
    """Batches ``first`` to ``last`` in one folder."""

    first: int
    last: int
    segment: str
    n_rows: int


class AppendLog:
    """A log at ``root``; batches are numbered from 0, and come in order.

    ``fanout`` neighbouring segments that cover the same number of batches are
    merged into one, as digits carry: after n batches the log has fewer than
    ``fanout`` segments for each power of ``fanout`` up to n, and a row was
    written again once for each of these powers.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, fanout: int = 8):
        if fanout < 2:
            raise ValueError("segments are merged two at a time at least")
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self.schema = spark.createDataFrame([], schema).schema

    # ------------------------------------------------------------------ reading
    def version(self) -> int:
        return last_committed(self.spark, self.root, "v") or 0

    def manifest(self, version: int | None = None) -> list[Segment]:
        """The segments of a version (the last one), in order; their number grows with the logarithm of the batches."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/v={version}").collect()
        return sorted(Segment(*r) for r in rows)

    def _rows(self, segments: list[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(s.segment) for s in segments])

    def _folder(self, segment: str) -> str:
        return f"{self.root}/data/segment={segment}"

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def count(self, version: int | None = None) -> int:
        """Rows of the log, from its manifest alone."""
        return sum(s.n_rows for s in self.manifest(version))

    # ------------------------------------------------------------------ changing
    def _write(self, rows: DataFrame, first: int, last: int) -> Segment:
        """Rows in a new segment that no version names yet; they are counted as they are written."""
        segment, seen = uuid.uuid4().hex, Observation()
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows.select(*columns).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(self._folder(segment))
        return Segment(first, last, segment, seen.get["n"])

    def _publish(self, base: int, segments: list[Segment]) -> bool:
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame(segments, _MANIFEST).coalesce(1).write.parquet(staged)
        if publish(self.spark, staged, f"{self.root}/v={base + 1}"):
            return True
        remove_folder(self.spark, staged)
        return False

    def append(self, rows: DataFrame, batch: int, tries: int = 50) -> int:
        """Add batch ``batch`` and merge what has become due; returns the number of rows in the log.

        A batch that the log has is left out, so a replayed append doubles
        nothing; one that is not the next is an error.
        """
        new = None
        for _ in range(tries):
            base = self.version()
            before = self.manifest(base)
            due = before[-1].last + 1 if before else 0
            if batch < due:
                break
            if batch > due:
                raise ValueError(f"batch {batch} before batch {due}")
            new = new or self._write(rows, batch, batch)
            if self._publish(base, [*before, new]):
                break
        else:
            raise RuntimeError(f"{self.root}: {tries} appends were overtaken")
        self.compact()
        return self.count()

    def _due(self, segments: list[Segment]) -> list[Segment]:
        """The first ``fanout`` neighbours that cover equally many batches."""
        for i in range(len(segments) - self.fanout + 1):
            run = segments[i : i + self.fanout]
            if len({s.last - s.first for s in run}) == 1:
                return run
        return []

    def compact(self) -> int:
        """Merge segments until none is due; returns the number of merges.

        A merge that another writer overtakes is published on the version that
        won if all its segments are still there, and dropped otherwise.
        """
        merges = 0
        while run := self._due(self.manifest()):
            merged = self._write(self._rows(run).hint("rebalance"), run[0].first, run[-1].last)
            while set(run) <= set(now := self.manifest(base := self.version())):
                if self._publish(base, sorted([s for s in now if s not in run] + [merged])):
                    merges += 1
                    break
        return merges

    def clean(self, keep: int = 1) -> int:
        """Delete versions before the last ``keep``, and segments that none of these names; returns the number of segments.

        For a time without writers: a change that is not published yet has a
        segment that no version names.  Readers of older versions lose theirs.
        """
        versions = committed_values(self.spark, self.root, "v")
        named = {s.segment for v in versions[-keep:] for s in self.manifest(v)}
        for v in versions[:-keep]:
            remove_folder(self.spark, f"{self.root}/v={v}")
        fs, pattern = _hadoop_path(self.spark, f"{self.root}/data/segment=*")
        gone = [s.getPath() for s in fs.globStatus(pattern) or [] if s.getPath().getName().removeprefix("segment=") not in named]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
