"""Partitioned tables that change partition by partition, in one step.

The table's folder has the data under ``data/<key>=<value>/written=<id>`` and
numbered versions ``v=<n>``: small tables ``(part, written, no_repeats)`` that
name the folders which make up the table.  A change writes new folders beside
the old ones and publishes a version that names them, by a rename that one of
several writers wins; the others do their change again on the version that
won.  Readers, in this or any other session, read the folders of one version,
so they see a change as a whole or not at all, and folders that no version
names, left by a lost writer, are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.session import _hadoop_path, last_committed, publish, remove_folder
from rivulet.sources.tables import write_partitioned

WRITTEN = "written"
_MANIFEST = f"part string, {WRITTEN} string, no_repeats boolean"


class FolderTable:
    """A table at ``root``; :meth:`create` makes one, later objects find its keys and schema there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        stored = spark.read.parquet(f"{self.root}/schema").schema
        self.keys = [f.name for f in stored.fields if f.metadata.get("key")]
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in stored.fields])

    @classmethod
    def create(cls, rows: DataFrame, root: str, keys: list[str]) -> FolderTable:
        """A new table of ``rows`` in folders by ``keys``; a table that is there already is an error."""
        if WRITTEN in rows.columns:
            raise ValueError(f"{WRITTEN!r} is the name of the table's own folders")
        fields = [T.StructField(f.name, f.dataType, True, {"key": f.name in keys}) for f in rows.schema.fields]
        rows.sparkSession.createDataFrame([], T.StructType(fields)).write.mode("errorifexists").parquet(f"{root.rstrip('/')}/schema")
        table = cls(rows.sparkSession, root)
        table.insert(rows)
        return table

    # ------------------------------------------------------------------ reading
    def version(self) -> int:
        return last_committed(self.spark, self.root, "v") or 0

    def manifest(self, version: int | None = None) -> list[tuple[str, str, bool]]:
        """``(partition, write, no_repeats)`` of a version: as many rows as the table has folders."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/v={version}").collect()
        return sorted((r["part"], r[WRITTEN], r["no_repeats"]) for r in rows)

    def _folders(self, entries: list[tuple[str, str]]) -> DataFrame:
        columns = [f.name for f in self.schema.fields]
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        data = [f for f in self.schema.fields if f.name not in self.keys]
        parts = [f for k in self.keys for f in self.schema.fields if f.name == k]
        schema = T.StructType([*data, *parts, T.StructField(WRITTEN, T.StringType())])
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/data")
        return reader.parquet(*[f"{self.root}/data/{part}/{WRITTEN}={w}" for part, w in entries]).select(*columns)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (the last one); filters on the keys prune folders."""
        return self._folders([(p, w) for p, w, _ in self.manifest(version)])

    # ------------------------------------------------------------------ changing
    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Rows in new folders that no version names yet: the write's id, and the partitions it has."""
        written = uuid.uuid4().hex
        rows = rows.select(*[f.name for f in self.schema.fields])
        # Each write has an output folder of its own: Spark's committer clears what is unfinished in one.
        aside = f"{self.root}/staged/{written}"
        write_partitioned(rows.withColumn(WRITTEN, F.lit(written)), aside, [*self.keys, WRITTEN])
        fs, pattern = _hadoop_path(self.spark, "/".join([aside, *["*"] * len(self.keys), f"{WRITTEN}={written}"]))
        parts = []
        for status in fs.globStatus(pattern) or []:
            path = status.getPath().toString()
            parts.append("/".join(path.split("/")[-1 - len(self.keys) : -1]))
            publish(self.spark, path, f"{self.root}/data/{parts[-1]}/{WRITTEN}={written}")
        remove_folder(self.spark, aside)
        return written, sorted(parts)

    def _publish(self, base: int, entries: list[tuple[str, str, bool]]) -> bool:
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.parquet(staged)
        if publish(self.spark, staged, f"{self.root}/v={base + 1}"):
            return True
        remove_folder(self.spark, staged)
        return False

    def insert(self, rows: DataFrame, tries: int = 50) -> int:
        """Append rows, whatever their partitions; returns the version that has them."""
        written, parts = self._write(rows)
        for _ in range(tries):
            base = self.version()
            if self._publish(base, [*self.manifest(base), *[(p, written, False) for p in parts]]):
                return base + 1
        raise RuntimeError(f"{self.root}: {tries} changes were overtaken")

    def insert_partition(self, partition: dict, rows: DataFrame) -> int:
        """Append rows to one partition (S9): ``partition`` names all keys, the columns bind by position."""
        if set(partition) != set(self.keys):
            raise ValueError(f"the partition must name {', '.join(self.keys)}")
        names = [f.name for f in self.schema.fields if f.name not in self.keys]
        if len(names) != len(rows.columns):
            raise ValueError(f"{len(rows.columns)} columns for {len(names)}")
        rows = rows.toDF(*names)
        return self.insert(rows.select(*[F.lit(partition[f.name]).cast(f.dataType).alias(f.name) if f.name in partition else F.col(f.name).cast(f.dataType) for f in self.schema.fields]))

    def union_distinct(self, rows: DataFrame, tries: int = 50) -> int:
        """Union with ``rows`` and drop repeated rows (S10); returns the version that has the result.

        Only partitions that get rows, or that an insert may have left with
        repeats, are read and written; the others keep their folders.  Nothing
        to do is no new version.
        """
        incoming, new_parts = self._write(rows)
        for _ in range(tries):
            base = self.version()
            before = self.manifest(base)
            folders: dict[str, list[tuple[str, bool]]] = {}
            for part, written, single in before:
                folders.setdefault(part, []).append((written, single))
            touched = set(new_parts) | {p for p, ws in folders.items() if len(ws) > 1 or not ws[0][1]}
            if not touched:
                return base
            old = [(p, w) for p, w, _ in before if p in touched]
            written, parts = self._write(self._folders(old + [(p, incoming) for p in new_parts]).distinct())
            entries = [x for x in before if x[0] not in touched] + [(p, written, True) for p in parts]
            if self._publish(base, entries):
                return base + 1
        raise RuntimeError(f"{self.root}: {tries} changes were overtaken")

    def clean(self, keep: int = 1) -> int:
        """Delete the folders that none of the last ``keep`` versions names; returns their number.

        For a time without writers: a change that is not published yet has
        folders that no version names.  Readers of older versions lose them.
        """
        last = self.version()
        named = {(p, w) for v in range(max(1, last - keep + 1), last + 1) for p, w, _ in self.manifest(v)}
        fs, pattern = _hadoop_path(self.spark, "/".join([f"{self.root}/data", *["*"] * len(self.keys), f"{WRITTEN}=*"]))
        gone = 0
        for status in fs.globStatus(pattern) or []:
            *_, folder = (path := status.getPath().toString()).split("/")
            part = "/".join(path.split("/")[-1 - len(self.keys) : -1])
            if (part, folder.removeprefix(f"{WRITTEN}=")) not in named:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone
