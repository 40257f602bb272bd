"""Topics by name: ``CREATE TEMPORARY VIEW t (...) USING topic OPTIONS (path '...')`` (K3, K5-K8).

A Spark data source in Python.  A topic is a folder: ``data`` holds segments,
files of TAB-separated lines, and ``log`` the numbered commits that place each
segment at offsets ``[from, until)`` of a topic partition.  An insert writes
its segments in the tasks and places all of them with one commit, published
under the next number only if no other writer has taken it; an insert that
fails leaves nothing.  Readers plan from the commits alone: a range of offsets
opens only the segments that overlap it.  A batch has an input partition per
topic partition, or ``tasksPerPartition`` of them, which take turns every
``maxOffsetsPerTask`` offsets; it reads what is there when its tasks start,
as Spark plans a view only once (give ``endingOffsets`` for a fixed end).  A
stream has one per topic partition and ``maxOffsetsPerTask`` offsets.

Options: ``path``; the two above; ``partitions`` of a new topic (3); ``startingOffsets`` and
``endingOffsets``, JSON objects from topic partition to offset; the declared
fields are decoded as strictly as :func:`rivulet.sources.topics.decode` does,
so an empty field and the text ``null`` come back as they are.  Declared
fields ``_partition int`` and ``_offset bigint`` give a line's place and are
not part of it.  Without declared fields the columns are ``partition, offset,
value``.  Files are opened by pyarrow's file systems (local or shared folders,
HDFS, object stores).  The module is pickled by value: workers need no copy.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Separator, text of a null field, and the arrow types of the fields a topic carries.
SEPARATOR, NULL_TEXT = "\t", "null"
ARROW_TYPES = {
    "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(),
    "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
}
RAW_SCHEMA = "partition int, offset bigint, value string"
PLACE = {"_partition": "int", "_offset": "bigint"}
READ_BYTES, BATCH_LINES, WHOLE_EVERY = 1 << 22, 1 << 16, 50


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.rstrip("/"))


class Topic:
    """The segments and commits of a topic folder."""

    def __init__(self, path: str):
        self.path = path
        self.files, self.root = _open(path)

    def versions(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def _commit_file(self, version: int) -> str:
        return f"{self.root}/log/{version:020d}.json"

    def entry(self, version: int) -> dict:
        with self.files.open_input_stream(self._commit_file(version)) as f:
            return json.loads(f.read())

    def latest(self) -> dict[int, int]:
        """One past the last offset of each topic partition."""
        versions = self.versions()
        return {int(p): o for p, o in self.entry(versions[-1])["next"].items()} if versions else {}

    def segments(self, start: dict[int, int] | None = None) -> list[tuple[int, int, int, str]]:
        """Segments ``(partition, from, until, file)`` that reach past ``start``; commits before it are not read."""
        found = []
        for version in reversed(self.versions()):
            entry = self.entry(version)
            found += [tuple(s) for s in entry["segments"]]
            if entry["whole"] is not None:
                found += [tuple(s) for s in entry["whole"]]
                break
            if entry["reset"] or start is not None and all(start.get(int(p), 0) >= o for p, o in entry["before"].items()):
                break
        return sorted(s for s in found if start is None or s[2] > start.get(s[0], 0))

    def publish(self, new: list[tuple[str, int]], partitions: int, reset: bool, tries: int = 100) -> None:
        """Place segments ``(file, lines)`` behind the last offsets, all or none; another writer's commit goes first."""
        self.files.create_dir(f"{self.root}/log")
        for _ in range(tries):
            versions = self.versions()
            before = {int(p): o for p, o in self.entry(versions[-1])["next"].items()} if versions else {}
            count = len(before) or partitions
            after = {p: before.get(p, 0) for p in range(count)}
            placed = []
            for file, lines in new:
                p = min(after, key=lambda q: (after[q], q))
                placed.append([p, after[p], after[p] + lines, file])
                after[p] += lines
            version = (versions or [0])[-1] + 1
            # Now and then a commit lists what is before it, so that a reader opens a bounded number of commits.
            whole = None if version % WHOLE_EVERY else [] if reset else self.segments()
            body = {"reset": reset, "before": before, "next": after, "segments": placed, "whole": whole}
            staged = f"{self.root}/log/{uuid.uuid4().hex}.staged"
            with self.files.open_output_stream(staged) as f:
                f.write(json.dumps(body).encode())
            if self._rename(staged, self._commit_file(version)):
                return
            self.files.delete_file(staged)
        raise RuntimeError(f"{self.path}: {tries} commits were overtaken by other writers")

    def _rename(self, staged: str, final: str) -> bool:
        """Give a file its final name if that is free."""
        if isinstance(self.files, fs.LocalFileSystem):
            try:
                os.link(staged, final)
            except FileExistsError:
                return False
            os.unlink(staged)
            return True
        if self.files.get_file_info(final).type != fs.FileType.NotFound:
            return False
        try:
            self.files.move(staged, final)  # HDFS refuses to replace a file
        except OSError:
            if self.files.get_file_info(final).type == fs.FileType.NotFound:
                raise
            return False
        return True

    def lines(self, file: str, skip: int, count: int) -> Iterator[pa.Array]:
        """Lines ``skip .. skip + count`` of a segment as string arrays."""
        rest, at, out = b"", 0, []
        with self.files.open_input_stream(f"{self.root}/data/{file}") as f:
            while at < skip + count and (block := f.read(READ_BYTES)):
                *whole, rest = (rest + block).split(b"\n")
                out += whole[max(0, skip - at) : max(0, skip + count - at)]
                at += len(whole)
                if len(out) >= BATCH_LINES:
                    yield pa.array(out, pa.binary()).cast(pa.string())
                    out = []
        if out:
            yield pa.array(out, pa.binary()).cast(pa.string())


# --------------------------------------------------------------------- lines and fields
def decoded(lines: pa.Array, fields: list[tuple[str, str]]) -> list[pa.Array]:
    """The fields ``(name, type)`` of TAB-separated lines; a short line or a bad value raises ValueError."""
    # As a JVM split: trailing empty fields are dropped, and a line of TABs alone has no field.
    trimmed = pc.utf8_rtrim(lines, characters=SEPARATOR)
    parts = pc.split_pattern(trimmed, SEPARATOR)
    n = pc.if_else(pc.and_(pc.equal(trimmed, ""), pc.not_equal(lines, "")), 0, pc.list_value_length(parts))
    least = pc.min(n).as_py()
    if len(lines) and least < len(fields):
        raise ValueError(f"topic line is missing field {least} ({fields[least][0]})")
    out = []
    for i, (name, kind) in enumerate(fields):
        text = pc.list_element(parts, i) if len(lines) else pa.array([], pa.string())
        good, clean = None, text
        if kind == "boolean":
            clean = pc.utf8_lower(text)
            good = pc.is_in(clean, pa.array(["true", "false"]))
        elif kind in ("float", "double"):
            clean = pc.utf8_lower(pc.utf8_trim_whitespace(text))
            good = pc.match_substring_regex(clean, r"^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?[df]?|nan|inf(inity)?)$")
            clean = pc.replace_substring_regex(pc.replace_substring_regex(clean, r"^\+", ""), r"(\d|\.)[df]$", r"\1")
        elif kind != "string":
            good = pc.match_substring_regex(text, r"^[+-]?[0-9]+$")
            clean = pc.replace_substring_regex(text, r"^\+", "")
        if good is not None and not pc.all(good).as_py() and len(lines):
            bad = text.filter(pc.invert(good))[0].as_py()
            raise ValueError(f"bad {kind} in field {name}: {bad}")
        try:
            out.append(clean if kind == "string" else pc.equal(clean, "true") if kind == "boolean" else clean.cast(ARROW_TYPES[kind]))
        except pa.ArrowInvalid as wrong:
            raise ValueError(f"bad {kind} in field {name}: {wrong}") from None
    return out


def number_text(value: float, single: bool) -> str:
    """A floating number as the JVM prints it: the shortest digits, with an exponent below 10^-3 and from 10^7."""
    import numpy as np

    x = np.float32(value) if single else np.float64(value)
    if not np.isfinite(x):
        return "NaN" if np.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return np.format_float_positional(x, unique=True, trim="0")
    mantissa, exponent = np.format_float_scientific(x, unique=True, trim="0").split("e")
    return f"{mantissa}E{int(exponent)}"


def line_of(values, kinds: list[str]) -> str:
    """The topic line of a row (K1): fields by TAB, null as ``null``; a TAB or line break in a text is an error."""
    out = []
    for v, kind in zip(values, kinds):
        if v is None:
            out.append(NULL_TEXT)
        elif kind == "string":
            if any(c in v for c in "\t\n\r"):
                raise ValueError("topic field contains TAB or line break")
            out.append(v)
        else:
            out.append(("true" if v else "false") if kind == "boolean" else number_text(v, kind == "float") if kind in ("float", "double") else str(v))
    return SEPARATOR.join(out)


# --------------------------------------------------------------------- the source
class Piece(InputPartition):
    """Offsets ``[start, end)`` of a topic partition, and the segments they are in."""

    def __init__(self, partition: int, start: int, end: int, segments: list):
        self.partition, self.start, self.end, self.segments = partition, start, end, segments


class Share(InputPartition):
    """Share ``number`` of ``of`` of whatever the topic holds when it is read."""

    def __init__(self, number: int, of: int, slots: int):
        self.number, self.of, self.slots = number, of, slots


class _Reading:
    """What batch and stream readers share: planning offset ranges, and reading them."""

    def __init__(self, options, schema: T.StructType):
        self.path, self.most = options["path"], int(options.get("maxOffsetsPerTask", 1_000_000))
        self.of, self.slots = int(options.get("partitions", 3)), int(options.get("tasksPerPartition", 1))
        self.limits = [{int(p): o for p, o in json.loads(options.get(k, "{}")).items()} for k in ("startingOffsets", "endingOffsets")]
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.raw = self.fields == [(f.split()[0], f.split()[1]) for f in RAW_SCHEMA.split(", ")]
        for name, kind in self.fields:
            if kind not in ARROW_TYPES or PLACE.get(name, kind) != kind:
                raise TypeError(f"topic field {name!r} has type {kind}; topics carry int, long, byte, short, double, float, boolean or string")

    def plan(self, start: dict[int, int], end: dict[int, int]) -> list[Piece]:
        """Pieces of at most ``maxOffsetsPerTask`` offsets, cut at its multiples."""
        by_partition: dict[int, list] = {}
        for p, lo, hi, file in Topic(self.path).segments(start):
            by_partition.setdefault(p, []).append((lo, hi, file))
        pieces = []
        for p, segments in sorted(by_partition.items()):
            at, last = max(start.get(p, 0), segments[0][0]), min(end.get(p, segments[-1][1]), segments[-1][1])
            while at < last:
                upto = min(last, (at // self.most + 1) * self.most)
                pieces.append(Piece(p, at, upto, [s for s in segments if s[0] < upto and s[1] > at]))
                at = upto
        return pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        topic = Topic(self.path)
        for lo, hi, file in piece.segments:
            offset, until = max(lo, piece.start), min(hi, piece.end)
            for lines in topic.lines(file, offset - lo, until - offset):
                place = {"_partition": pa.array([piece.partition] * len(lines), pa.int32()), "_offset": pa.array(range(offset, offset + len(lines)), pa.int64())}
                if self.raw:
                    columns = [*place.values(), lines]
                else:
                    values = iter(decoded(lines, [f for f in self.fields if f[0] not in PLACE]))
                    columns = [place[name] if name in place else next(values) for name, _ in self.fields]
                yield pa.RecordBatch.from_arrays(columns, [name for name, _ in self.fields])
                offset += len(lines)


class TopicReader(_Reading, DataSourceReader):
    """Spark plans a view once and keeps the plan, so the shares are fixed and each task looks up what is there now."""

    def partitions(self) -> list[Share]:
        of = len(Topic(self.path).latest()) or self.of
        return [Share(i, of, self.slots) for i in range(of * self.slots)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        for piece in self.plan(*self.limits):
            if piece.partition % share.of == share.number % share.of and piece.start // self.most % share.slots == share.number // share.of:
                yield from super().read(piece)


class TopicStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {str(p): o for p, o in self.limits[0].items()}

    def latestOffset(self) -> dict:
        return {str(p): o for p, o in Topic(self.path).latest().items()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.plan(*({int(p): o for p, o in x.items()} for x in (start, end)))

    def commit(self, end: dict) -> None:
        """Nothing to release: the stream's checkpoint holds its position."""


class Written(WriterCommitMessage):
    def __init__(self, file: str, lines: int):
        self.file, self.lines = file, lines


class TopicWriter(DataSourceWriter):
    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.path, self.partitions, self.overwrite = options["path"], int(options.get("partitions", 3)), overwrite
        fields = [(i, f.dataType.simpleString()) for i, f in enumerate(schema.fields) if f.name not in PLACE]
        for _, kind in fields:
            if kind not in ARROW_TYPES:
                raise TypeError(f"a topic cannot carry a field of type {kind}")
        self.at, self.kinds = [i for i, _ in fields], [kind for _, kind in fields]

    def write(self, rows: Iterator) -> Written:
        topic, file, lines = Topic(self.path), f"{uuid.uuid4().hex}.txt", 0
        topic.files.create_dir(f"{topic.root}/data")
        with topic.files.open_output_stream(f"{topic.root}/data/{file}") as out:
            for row in rows:
                out.write((line_of([row[i] for i in self.at], self.kinds) + "\n").encode())
                lines += 1
        return Written(file, lines)

    def commit(self, messages: list[Written | None]) -> None:
        new = sorted(((m.file, m.lines) for m in messages if m and m.lines), key=lambda x: (-x[1], x[0]))
        if new or self.overwrite:
            Topic(self.path).publish(new, self.partitions, self.overwrite)
        self._remove([m for m in messages if m and not m.lines])

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([m for m in messages if m])

    def _remove(self, messages: list[Written]) -> None:
        topic = Topic(self.path)
        for m in messages:
            topic.files.delete_file(f"{topic.root}/data/{m.file}")


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return RAW_SCHEMA

    def reader(self, schema: T.StructType) -> TopicReader:
        return TopicReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> TopicStreamReader:
        return TopicStreamReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> TopicWriter:
        return TopicWriter(self.options, schema, overwrite)


def register_topic_source(spark: SparkSession) -> None:
    """Make ``topic`` known as a format to this session's SQL and readers."""
    spark.dataSource.register(TopicSource)
