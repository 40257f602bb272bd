"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint is embedded as the vector of the bit counts of its segments.
The Manhattan distance of two such vectors never exceeds the Hamming distance
of the fingerprints, so pairs within ``max_bits`` are found among pairs of
near vectors:

* The segments form some groups.  Of two vectors within Manhattan distance
  ``max_bits`` all groups but ``max_bits`` are equal, so the grid join puts
  every fingerprint into one cell for each choice of that many groups, named
  by their counts.  More groups make more but finer cells; their number
  follows from the number of points, so that a point meets some thousands of
  others at most on average, whatever the size of the input.
* Inside a cell the counts of four coarse segments are compared first, as a
  Manhattan lower bound, then the exact bit distance.

Large cells are cut into blocks, and a task compares one pair of blocks, so no
task grows with a cell.  A task hands back a spanning forest of its links,
never all pairs of a group of near copies.  Equal fingerprints are one point.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rivulet.llm.common import read_table, stored, with_row
from rivulet.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCK = 8192


def fingerprint_of(text: str | None, words: int = SHINGLE) -> int:
    """SimHash of a text: a bit is 1 if it is set in over half of the shingle hashes; no words: 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest, ends, starts = xxhash.xxh64_intdigest, ends[k - 1 :].tolist(), starts[: len(parts) - k + 1].tolist()
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(text, words: int = SHINGLE):
    """The fingerprint column of a text column, as a signed 64-bit number."""

    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t.as_py(), words) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _segments(groups: int, width: int) -> list[list[tuple[int, int]]]:
    """``groups`` lists of ``(first bit, bits)`` segments of at most ``width`` bits, covering 64 bits."""
    cuts = np.linspace(0, 64, groups + 1).astype(int)
    return [[(at, min(width, hi - at)) for at in range(lo, hi, width)] for lo, hi in zip(cuts[:-1], cuts[1:])]


def group_count(points: int, max_bits: int, width: int) -> int:
    """The number of groups with the least work a point: 200 for each of its cells and 1 for each point it meets there."""

    def work(groups: int) -> float:
        choices = math.comb(groups, max_bits)
        # Chance that a segment of two random fingerprints has equal counts, over the segments of a choice.
        equal = sum(math.log2(math.comb(2 * b, b)) - 2 * b for part in _segments(groups, width) for _, b in part)
        return choices * (200 + points * 2 ** (equal * (groups - max_bits) / groups))

    return min(range(max_bits + 1, max_bits + 9), key=work)


def _cells(groups: int, max_bits: int, width: int):
    """For each choice of all groups but ``max_bits``, the mixed-radix number of their counts (no two vectors have one)."""
    numbers = []
    for segments in _segments(groups, width):
        number, radix = F.lit(0).cast("long"), 1
        for at, bits in segments:
            number = number * (bits + 1) + F.bit_count(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1)))
            radix *= bits + 1
        numbers.append((number.cast("long"), radix))
    out = []
    for choice in itertools.combinations(range(groups), groups - max_bits):
        cell = F.lit(0).cast("long")
        for g in choice:
            cell = cell * numbers[g][1] + F.col("counts")[g]
        out.append(cell)
    return F.array(*[n for n, _ in numbers]).alias("counts"), F.array(*out)


def _quarters(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the four 16-bit quarters, one row each: the coarse embedding."""
    return np.ascontiguousarray(np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).T.astype(np.int8))


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the least known member for each node) after adding the links a-b."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def _forest(fp: np.ndarray, side: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least-root spanning links of the points of one pair of blocks: side 0 against side 1, or against itself if there is no side 1."""
    order = np.argsort(fp, kind="stable")
    fp, side = fp[order], side[order]
    u, coarse = fp.view(np.uint64), _quarters(fp)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    root, there = np.arange(len(fp)), coarse[:, right]
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        apart = np.zeros((len(rows), len(right)), np.int8)
        for mine, theirs in zip(coarse[:, rows], there):
            apart += np.abs(mine[:, None] - theirs[None, :])
        i, j = np.nonzero(apart <= max_bits)
        near = np.bitwise_count(u[rows[i]] ^ u[right[j]]) <= max_bits
        root = _unite(root, rows[i[near]], right[j[near]])
    at = np.flatnonzero(root != np.arange(len(fp)))
    return fp[at], fp[root[at]]


def _links_within(max_bits: int):
    """Over rows in the order of (g, cell, i, j): the links of whole groups, some at a time."""

    def linked(rows: pa.Table) -> pa.RecordBatch:
        keys = np.stack([rows[c].to_numpy() for c in ("g", "cell", "i", "j")])
        fp, side = rows["fp"].to_numpy(), rows["side"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(fp)]])
        found = [_forest(fp[x:y], side[x:y], max_bits) for x, y in zip(cuts[:-1], cuts[1:]) if y - x > 1]
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found] or none)) for k in (0, 1)], ["a", "b"])

    def links(batches):
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            keys = np.stack([batch[c].to_numpy() for c in ("g", "cell", "i", "j")])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
            if len(change):
                # The last group may go on in the next batch.
                cut = int(change[-1]) + 1
                whole = pa.concat_tables([*held[:-1], held[-1].slice(0, cut)])
                held = [held[-1].slice(cut)]
                yield linked(whole)
        if held:
            yield linked(pa.concat_tables(held))

    return links


def near_links(points: DataFrame, max_bits: int = MAX_BITS, width: int = 2, block: int = BLOCK, groups: int | None = None) -> DataFrame:
    """Links ``a, b`` between distinct 64-bit ``fp`` that join exactly the points connected at ``max_bits`` or fewer bits."""
    groups = groups or group_count(points.count(), max_bits, width)
    counts, cells = _cells(groups, max_bits, width)
    cells = points.select("fp", counts).select("fp", F.posexplode(cells).alias("g", "cell"))
    large = cells.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1")
    cells = cells.join(large, ["g", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        "g", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).cast("int").alias("side"), "fp",
    )
    key = ["g", "cell", "i", "j"]
    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(_links_within(max_bits), "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, max_bits: int = MAX_BITS, width: int = 2) -> DataFrame:
    """One row per input row: ``_row, doc_id, fingerprint, component_id, kept``.

    ``component_id`` is the least doc_id of the documents reachable over
    fingerprints that differ in ``max_bits`` or fewer bits (null only if all of
    them are null); ``kept`` marks the one row that stays, the first with that
    id.  Null, empty and wordless texts have fingerprint zero and link like
    any other.  An empty table gives an empty result.  Other columns of
    ``docs`` are not read.
    """
    rows = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    rows = stored(rows.select("_row", "doc_id", fingerprints(F.col("text"), words).alias("fp")), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_row"))
    points = stored(rows.groupBy("fp").agg(first.alias("first")), "simhash-points")
    roots = components(near_links(points.select("fp"), max_bits, width)).withColumnRenamed("node", "fp")
    classes = points.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = classes.groupBy("root").agg(F.min("first").alias("least"))
    named = stored(classes.select("fp", "root").join(least, "root").select("fp", "least"), "simhash-classes")
    return rows.join(named, "fp").select(
        "_row", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"), (F.col("least._row") == F.col("_row")).alias("kept"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read_table(spark, sf_dir, "documents")).drop("_row", "kept")
