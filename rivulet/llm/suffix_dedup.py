"""Repeated byte strings by prefix-free parsing.

Every byte that lies in a ``length``-byte string which also starts anywhere
else goes.  The strings ("windows") are named by rolling-hash triggers:

1. Parsing.  Positions whose ``TRIGGER`` bytes hash low are triggers; they cut
   a text into phrases.  A window belongs to its first trigger, the anchor,
   that leaves ``ANCHOR`` bytes inside it; where coarse triggers leave a long
   gap the finer ones of the same hash take over, level by level, and a window
   without any is its own anchor.  Triggers depend on their own bytes only, so
   equal windows have equal anchors at equal places.  A phrase with the right
   context that its windows reach is a segment.
2. Dictionary.  Segments are joined by the hash of their anchor's bytes, i.e.
   the parse suffix that starts there, and inside that by the hash of the whole
   segment.  An anchor that occurs once holds no repeated window.  A segment
   that occurs twice is repeated with all its windows.  Of an anchor only counts
   are gathered, so no task holds all its contexts.
3. Merging.  What is left are the ends of repeats: segments whose anchor
   recurs in another context.  They and one representative of each repeated
   segment are put in two orders: that of their parse suffixes (the text from
   the anchor on) and that of the dictionary's phrase suffixes (the text before
   the anchor, read backward), each with the common prefixes of neighbours.  A
   window is a phrase suffix of some length with the rest of the parse suffix,
   so it recurs if another segment is in its class of both orders.

Step 2 takes segments with 128 equal bits of hash as equal, step 3 compares
bytes.  They send hashes and short contexts; the text itself is sent twice, to
meet its segments and its spans.  Equal segments of one batch of rows meet there first, so a
hot string costs one row a batch.  A group of step 3 with more than
``GROUP`` rows is dealt over blocks, whose windows meet by their hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm.common import byte_blocks, read_table, stored, with_row

LENGTH = 200
TRIGGER, ANCHOR = 12, 80
#: One position in so many is a trigger of each level.
LEVELS = (64, 16, 4)
#: Bytes of a block of texts, and of a piece of a longer one.
PIECE = 1 << 21
#: Members of one block of a large group in step 3.
GROUP = 4096
#: Parts of an anchor's contexts, by their hash: the bits of a long.
SALTS = 64
_ODD = 0x9E3779B97F4A7C15


class Rolling:
    """Hashes of any substring of a block, from prefix sums of a polynomial modulo 2^64."""

    _power = _inverse = np.ones(1, np.uint64)
    _mix = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64)

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        cls, n = type(self), len(data)
        if len(cls._power) < n + 1:
            steps = np.full(max(n + 1, 1 << 20), _ODD, np.uint64)
            steps[0] = 1
            cls._power = np.cumprod(steps)
            steps[1:] = pow(_ODD, -1, 1 << 64)
            cls._inverse = np.cumprod(steps)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(cls._mix[which][data] * cls._power[:n])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self._inverse[start]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)

    def every(self, width: int) -> np.ndarray:
        """Hashes of all substrings of ``width`` bytes, in order, well mixed in their upper bits."""
        n = max(0, len(self.sums) - width)
        h = (self.sums[width : width + n] - self.sums[:n]) * self._inverse[:n]
        return (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def segments(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH):
    """Segments of a block's rows: ``row, anchor, first, last, key, context`` arrays.

    A segment is the windows that start from ``first`` to ``last`` in the block
    and have the anchor in common; ``key`` hashes the anchor's bytes and
    ``context`` all bytes of the windows with the anchor's place in them.
    """
    reach, big = length - ANCHOR, np.iinfo(np.int64).max // 4
    starts, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    rolling = Rolling(data)
    mixed = rolling.every(TRIGGER)
    at = np.flatnonzero(mixed < np.uint64((1 << 64) // LEVELS[-1]))
    row = np.searchsorted(offsets, at, "right") - 1
    fits = at + ANCHOR <= ends[row]
    at, row = at[fits], row[fits]
    strength = mixed[at]

    def before(at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The trigger before each one in its row, or the place before the row."""
        first = np.concatenate([[True], of[1:] != of[:-1]])[: len(at)]
        return np.where(first, starts[of] - 1, np.concatenate([[-1], at[:-1]])[: len(at)])

    parts, coarser, c_row = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for level in LEVELS:
        mine = strength < np.uint64((1 << 64) // level)
        t, t_row = at[mine], row[mine]
        low, high = np.maximum(before(t, t_row) + 1, t - reach), np.minimum(t, ends[t_row] - length)
        if len(coarser):
            # Windows that reach a coarser trigger belong to it.
            k = np.searchsorted(coarser, t, "right")
            inside = (k < len(coarser)) & (c_row[np.minimum(k, len(coarser) - 1)] == t_row)
            high = np.minimum(high, np.where(inside, coarser[np.minimum(k, len(coarser) - 1)] - reach - 1, big))
            new = ~np.isin(t, coarser, assume_unique=True)
            parts.append((t_row[new], t[new], low[new], high[new]))
        else:
            parts.append((t_row, t, low, high))
        coarser, c_row = t, t_row
    # Windows with no trigger in reach: in the gaps between the finest ones, and behind the last one of a row.
    all_rows = np.arange(len(starts))
    at_end = np.searchsorted(row, all_rows, "right")
    last = np.where((at_end > 0) & (row[np.maximum(at_end - 1, 0)] == all_rows), at[np.maximum(at_end - 1, 0)], starts - 1) if len(at) else starts - 1
    g_row = np.concatenate([row, all_rows])
    low = np.concatenate([before(at, row), last]) + 1
    high = np.minimum(np.concatenate([at - reach - 1, ends]), ends[g_row] - length)
    n = np.maximum(0, high - low + 1)
    x = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    parts.append((np.repeat(g_row, n), x, x, x))

    row, anchor, first, last = (np.concatenate([p[i] for p in parts]) for i in range(4))
    some = first <= last
    row, anchor, first, last = row[some], anchor[some], first[some], last[some]
    context = rolling.of(first, last + length) + (anchor - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (last - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return row, anchor, first, last, rolling.of(anchor, anchor + ANCHOR), context


#: ``place`` packs the anchor's position (32 bits), its distances to the first and the last window (14 each), and 2 bits of count.
_SEGMENT = "_row long, key long, context long, place long"


def _segment_rows(length: int):
    def rows(batches):
        for batch in batches:
            ids = batch["_row"].to_numpy()
            got = []
            for first, offsets, data in byte_blocks(batch["text"], PIECE):
                # A longer text is read in pieces: each has the windows that start in it.
                for at in range(0, max(1, len(data)), PIECE) if len(offsets) == 2 else (0,):
                    piece, bounds = (data, offsets) if len(data) <= PIECE else (data[at : at + PIECE + length - 1], None)
                    bounds = np.array([0, len(piece)]) if bounds is None else bounds
                    row, anchor, lo, hi, key, context = segments(bounds, piece, length)
                    got.append((ids[first + row], at + anchor - bounds[row], anchor - lo, anchor - hi, key, context))
            if not got:
                continue
            row, anchor, lo, hi, key, context = (np.concatenate([g[i] for g in got]) for i in range(6))
            # Equal segments of the batch: the first stands for all, the others already know that they recur.
            order = np.lexsort((context, key))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (context[order][1:] != context[order][:-1])
            group = np.cumsum(new) - 1
            n = np.bincount(group, minlength=1)[group] if len(order) else group
            count, other = np.empty(len(order), np.int64), np.empty(len(order), bool)
            count[order], other[order] = np.minimum(n, 2), ~new
            # They ask nobody, so they go anywhere.
            spread = row.astype(np.uint64) * np.uint64(_ODD) + anchor.astype(np.uint64)
            key, context = np.where(other, spread, key), np.where(other, spread, context)
            place = anchor << 30 | lo << 16 | hi << 2 | count
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(place)], ["_row", "key", "context", "place"])

    return rows


def _open_segments(length: int):
    """Contexts of the segments that step 3 has to compare, in two classes by the distance to the anchor."""

    def rows(batches):
        half, known = (length - ANCHOR) // 2, length - (length - ANCHOR) // 2
        for batch in batches:
            out: list[tuple] = []
            for row, text, found in zip(batch["_row"].to_pylist(), batch["text"], batch["open"].to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for s in found:
                    at, low, high = s["at"], s["low"], s["high"]
                    for x, y, start in ((max(low, at - half), high, at), (low, min(high, at - half - 1), at - half)):
                        if x <= y:
                            name = hashlib.blake2b(data[start : start + known], digest_size=8, salt=b"far" if start < at else b"near").digest()
                            out.append((int.from_bytes(name, "little", signed=True), row, x, y, start - x, s["asks"], data[x : y + length]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))],
                ["suffix", "_row", "low", "high", "before", "asks", "bytes"],
            )

    return rows


_REPEAT = "_row long, low int, high int, h1 long, h2 long, asks boolean, sure boolean"


def _ordered(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the rows of a byte matrix, and the common prefix of each with the one before it in that order."""
    n, width = strings.shape
    order = np.argsort(np.ascontiguousarray(strings).view(f"S{width}").ravel(), kind="stable") if width else np.arange(n)
    other = strings[order[1:]] != strings[order[:-1]]
    common = np.where(other.any(axis=1), other.argmax(axis=1), width) if width else np.zeros(max(0, n - 1), np.int64)
    return order, np.concatenate([[-1], common])


def _classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Of each row the number of its class, if rows with ``length`` bytes in common are one."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length)
    return out


def _repeats(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Repeated windows of whole groups, and of groups with more blocks the windows that have to meet the other blocks'."""
    _, offsets, data = next(byte_blocks(rows["bytes"], 1 << 62))
    ids, asks = rows["_row"].to_numpy(), rows["asks"].to_numpy(zero_copy_only=False)
    low, high, before = (rows[c].to_numpy().astype(np.int64) for c in ("low", "high", "before"))
    parted, n, half = rows["blocks"].to_numpy() > 1, rows.num_rows, int(before.max())

    def matrix(at: np.ndarray, step: int, width: int, valid: np.ndarray) -> np.ndarray:
        """``width`` bytes from ``at`` on, forward or backward; 0 beyond the ``valid`` ones."""
        i = np.arange(width)
        return np.where(i < valid[:, None], data[np.clip(at[:, None] + step * i, 0, max(0, len(data) - 1))], 0).astype(np.uint8)

    anchor = offsets[:-1] + before
    parse = _ordered(matrix(anchor, 1, length, offsets[1:] - anchor))
    phrase = _ordered(matrix(anchor - 1, -1, half, before))
    # again[row, k]: the window that starts k bytes before the anchor recurs; first: it is the first of its class.
    again, first = np.zeros((n, half + 1), bool), np.zeros((n, half + 1), bool)
    nearest = before - (high - low)
    for k in range(half + 1):
        has = np.flatnonzero((nearest <= k) & (k <= before))
        if not len(has):
            continue
        both = _classes(*parse, length - k)[has] * (n + 1) + _classes(*phrase, k)[has]
        _, at, group, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
        again[has, k] = count[group] > 1
        first[has[at], k] = True
    # Windows in the order of their starts: the farthest from the anchor first.
    hit = (again & asks[:, None])[:, ::-1]
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    anchor_at = low + before
    # One row for each window of a parted group that this block knows.
    has = (nearest[:, None] <= np.arange(half + 1)) & (np.arange(half + 1) <= before[:, None])
    t_row, k = np.nonzero(has & parted[:, None] & (first | ~again))
    at = anchor[t_row] - k
    h1, h2 = (Rolling(data, which).of(at, at + length).view(np.int64) for which in (0, 1)) if len(at) else (at, at)
    zeros = np.zeros(len(row), np.int64)
    columns = (
        np.concatenate([ids[row], ids[t_row]]),
        np.concatenate([anchor_at[row] - half + begin, anchor_at[t_row] - k]).astype(np.int32),
        np.concatenate([anchor_at[row] - half + end - 1, anchor_at[t_row] - k]).astype(np.int32),
        np.concatenate([zeros, h1]), np.concatenate([zeros, h2]),
        np.concatenate([np.ones(len(row), bool), asks[t_row] & ~again[t_row, k]]), np.arange(len(row) + len(k)) < len(row),
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_row", "low", "high", "h1", "h2", "asks", "sure"])


def _compare(length: int):
    """Over rows in the order of (suffix, block): compares whole groups, some at a time."""

    def rows(batches):
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            suffix, block = batch["suffix"].to_numpy(), batch["block"].to_numpy()
            change = np.flatnonzero((suffix[1:] != suffix[:-1]) | (block[1:] != block[:-1]))
            if len(change):
                # The last group may go on in the next batch.
                cut = int(change[-1]) + 1
                whole = pa.concat_tables([*held[:-1], held[-1].slice(0, cut)])
                held = [held[-1].slice(cut)]
                yield _repeats(whole, length)
        if held and sum(t.num_rows for t in held):
            yield _repeats(pa.concat_tables(held), length)

    return rows


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of the union of byte ranges, end exclusive."""
    if not len(low):
        return [], []
    order = np.argsort(low, kind="stable")
    low, upto = low[order], np.maximum.accumulate(high[order])
    begin = np.concatenate([[0], np.flatnonzero(low[1:] > upto[:-1]) + 1])
    return low[begin].tolist(), upto[np.concatenate([begin[1:] - 1, [len(low) - 1]])].tolist()


def _remains(length: int):
    def rows(batches):
        for batch in batches:
            spans = batch["spans"]
            offsets, flat = spans.offsets.to_numpy(), spans.values
            low, high = flat.field("low").to_numpy().astype(np.int64), flat.field("high").to_numpy().astype(np.int64) + length
            empty = spans.is_null().to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for i, text in enumerate(batch["text"]):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                at = slice(0, 0) if empty[i] else slice(offsets[i], offsets[i + 1])
                begins, ends = _runs(low[at], high[at])
                digest, upto = hashlib.sha256(), 0
                for x, y in zip(begins, ends):
                    digest.update(data[upto:x])
                    upto = y
                digest.update(data[upto:])
                out.append((len(data), sum(ends) - sum(begins), len(begins), digest.hexdigest(), list(zip(begins, ends))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            )

    return rows


def in_blocks(contexts: DataFrame) -> DataFrame:
    """Stored ``contexts`` with ``blocks`` and ``block``: every group of over ``GROUP`` rows is dealt over blocks of about so many.

    The number of large groups grows with the input, so the list of them is
    stored and its size decides how it is joined.
    """
    sizes = contexts.groupBy("suffix").agg(F.count(F.lit(1)).alias("size"))
    large = stored(sizes.where(F.col("size") > GROUP).select("suffix", F.ceil(F.col("size") / GROUP).cast("int").alias("blocks")), "repeat-large")
    met = contexts.join(large, "suffix", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return met.withColumn("block", F.pmod(F.xxhash64("_row", "low"), F.col("blocks")).cast("int"))


#: Of a ``place``: the anchor's position, and the first and last window's.
_AT = "CAST(shiftright(place, 30) AS INT) AS at"
_LOW = "CAST(shiftright(place, 30) - (shiftright(place, 16) & 16383) AS INT) AS low"
_HIGH = "CAST(shiftright(place, 30) - (shiftright(place, 2) & 16383) AS INT) AS high"


def counted(found: DataFrame) -> DataFrame:
    """``_row, key, place, first`` of all segments; the lowest bit of ``place`` says that the segment recurs.

    ``first``: it stands for the equal ones, which meet in a window over
    (key, context); the others ask nothing more and have no ``key``.
    """
    same = Window.partitionBy("key", "context")
    found = found.repartition("key", "context").withColumn("sure", F.sum(F.col("place").bitwiseAND(3)).over(same) > 1)
    found = found.withColumn("first", F.row_number().over(same.orderBy("_row", "place")) == 1)
    place = F.col("place").bitwiseAND(-4).bitwiseOR(F.col("sure").cast("long"))
    return found.select("_row", F.when(F.col("first"), F.col("key")).alias("key"), place.alias("place"), "first")


def open_ends(found: DataFrame) -> DataFrame:
    """``_row, at, low, high, asks`` of the first segments in ``found`` whose anchor has other contexts, unless all of these recur as they are.

    Of an anchor three numbers are gathered, which each task aggregates before
    it sends them: how many contexts it has, whether all recur, and which salts
    its segments have.  The anchors that are asked about, one row a salt, meet
    their segments by the hash of key and salt, so an anchor with any number of
    contexts is no group of one task; what one salt of a very hot anchor holds,
    adaptive execution splits further.  Two of these hashes that are equal by
    chance add segments to step 3, which compares them.
    """
    sure = F.col("place").bitwiseAND(1)
    first = found.where("first").withColumn("salt", F.pmod(F.xxhash64("_row", "place"), F.lit(SALTS)).cast("int"))
    salts = F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")
    anchors = first.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"), F.min(sure).alias("least"), salts)
    taken = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("getbit", F.col("salts"), i) == 1)
    asked = anchors.where("contexts > 1 AND least = 0").select("key", F.explode(taken).alias("salt"))
    asked = stored(asked.select(F.xxhash64("key", "salt").alias("asked")), "repeat-anchors")
    first = first.select(F.xxhash64("key", "salt").alias("asked"), "_row", "place")
    return first.join(asked, "asked", "left_semi").selectExpr("_row", _AT, _LOW, _HIGH, "place & 1 = 0 AS asks")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    ``spans`` are the maximal removed byte runs, end exclusive.  Null text is
    empty; texts shorter than ``length`` lose nothing; windows never cross
    rows.  Repeated rows repeat each other's windows and so lose them.  An
    empty table gives an empty result.  Other columns of ``docs`` are not
    read.  ``length`` has to
    be over ``ANCHOR + 2 * TRIGGER``.
    """
    if not ANCHOR + 2 * TRIGGER < length < 1 << 14:
        raise ValueError(f"length has to be over {ANCHOR + 2 * TRIGGER} and below {1 << 14}")
    texts = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("_row", "doc_id", "text")
    found = stored(counted(texts.select("_row", "text").mapInArrow(_segment_rows(length), _SEGMENT)), "repeat-segments")
    ends = open_ends(found).groupBy("_row").agg(F.collect_list(F.struct("at", "low", "high", "asks")).alias("open"))
    contexts = texts.select("_row", "text").join(ends, "_row").mapInArrow(_open_segments(length), "suffix long, _row long, low int, high int, before int, asks boolean, bytes binary")
    contexts = stored(contexts, "repeat-contexts")
    met = in_blocks(contexts)
    compared = met.repartition("suffix", "block").sortWithinPartitions("suffix", "block").mapInArrow(_compare(length), _REPEAT)
    compared = stored(compared, "repeat-windows")
    # Windows of groups with several blocks: the block winners meet by the hash of the window.
    across = compared.where("NOT sure")
    twice = across.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    ends = compared.where("sure").select("_row", "low", "high").unionByName(across.where("asks").join(twice, ["h1", "h2"], "left_semi").select("_row", "low", "high"))
    gone = found.where("place & 1 = 1").selectExpr("_row", _LOW, _HIGH).unionByName(ends).groupBy("_row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return texts.join(gone, "_row", "left").select("doc_id", "text", "spans").mapInArrow(
        _remains(length), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read_table(spark, sf_dir, "documents")).drop("spans")
