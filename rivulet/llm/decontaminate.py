"""Benchmark decontamination with an FM-index per training shard.

A shard is a batch of whole documents.  Its words become symbols of the
benchmark's vocabulary; a word outside it can be in no window, so runs of
symbols shorter than the shortest window are left out, and runs are parted by
a separator that no window holds.  The shard's index has the Burrows-Wheeler
transform in a wavelet matrix (rank in one step per bit) and every eighth
suffix position.  All windows are searched backward at once, occurrences are
located by stepping to a sampled position, checked against the words
themselves, and merged to the spans to remove.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rivulet.llm.common import byte_blocks, fresh, read_table, shipped, stored, with_row
from rivulet.llm.wordindex import WordHasher, alnum_table, lower_table

WINDOW = 13
SAMPLE = 8
#: Symbols in an index; a shard with more kept text has several.
SHARD = 1 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of an integer text by prefix doubling; shorter suffixes first."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    order, step = np.argsort(rank, kind="stable"), 1
    while n and rank[order].max() < n:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] if step < n else 0
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))
        rank, step = new, 2 * step
        if step >= 2 * n:
            break
    return order


class FMIndex:
    """FM-index of an integer text (symbols from 1; an end mark 0 is added)."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.concatenate([text.astype(np.int64), [0]])
        order = suffix_array(text)
        bwt = text[order - 1]
        self.size, self.sample = len(text), sample
        self.levels = max(1, int(text.max()).bit_length())
        counts = np.bincount(text, minlength=(1 << self.levels) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.ones, self.zeros, self.bits = [], [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(np.int32)
            self.bits.append(bit)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.marked = np.full(self.size, -1, np.int64)
        held = order % sample == 0
        self.marked[held] = order[held]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``at`` symbols of the transform."""
        low, at = np.zeros_like(at), at.copy()
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = (symbol >> level & 1).astype(bool)
            ones = self.ones[i]
            low = np.where(bit, self.zeros[i] + ones[low], low - ones[low])
            at = np.where(bit, self.zeros[i] + ones[at], at - ones[at])
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for i in range(self.levels):
            bit = self.bits[i][at]
            ones = self.ones[i][at]
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
            out = out * 2 + bit
        return out

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of right-aligned ``patterns`` [pattern, symbol], all at once."""
        width = patterns.shape[1]
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        going = np.arange(len(patterns))
        for back in range(width):
            going = going[(lengths[going] > back) & (low[going] < high[going])]
            if not len(going):
                break
            c = patterns[going, width - 1 - back]
            known = c < len(self.before) - 1
            high[going[~known]] = low[going[~known]]
            going, c = going[known], c[known]
            low[going] = self.before[c] + self.rank(c, low[going])
            high[going] = self.before[c] + self.rank(c, high[going])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to a sampled one."""
        at, steps = at.copy(), np.zeros(len(at), np.int64)
        out, going = np.full(len(at), -1, np.int64), np.arange(len(at))
        while len(going):
            here = self.marked[at[going]]
            done = here >= 0
            out[going[done]] = here[done] + steps[going[done]]
            going = going[~done]
            c = self.symbol(at[going])
            at[going] = self.before[c] + self.rank(c, at[going])
            steps[going] += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, as symbols of their vocabulary."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        vocabulary = sorted({w for _, words in items for w in words})
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.words = np.array([b"", *vocabulary], object)
        of: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            codes = [number[w] for w in words]
            for i in range(max(1, len(codes) - window + 1) if codes else 0):
                of.setdefault(tuple(codes[i : i + window]), set()).add(name)
        self.items = [sorted(names) for names in of.values()]
        self.lengths = np.array([len(w) for w in of], np.int64)
        self.patterns = np.zeros((len(of), window), np.int64)
        for i, w in enumerate(of):
            self.patterns[i, window - len(w) :] = w
        self.separator = len(vocabulary) + 1
        data = np.frombuffer(b"\n".join(vocabulary), np.uint8)
        hashes = WordHasher().words(data, np.array([0, len(data)]), alnum_table())[3]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol a word may be, 0 if none."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        low = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[low] == hashes, self.order[low] + 1, 0)


def _kept_runs(symbols: np.ndarray, rows: np.ndarray, least: int) -> np.ndarray:
    """Positions of words in runs of ``least`` or more vocabulary words of one row."""
    inside = symbols > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (rows[1:] != rows[:-1])
    run = np.cumsum(start) - 1
    at = np.flatnonzero(inside)
    return at[np.bincount(run[at], minlength=1)[run[at]] >= least] if len(at) else at


def find_spans(texts: pa.Array, phrases: Phrases, window: int):
    """Per row ``(words, hit word spans merged, items found)``; spans are pairs of word numbers, end exclusive."""
    lower, is_word, hasher = lower_table(), alnum_table(), WordHasher()
    n_words = np.zeros(len(texts), np.int64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    kept, size = [], 0

    def search() -> None:
        if not kept:
            return
        codes = np.concatenate([k[0] for k in kept])
        rows, numbers = np.concatenate([k[1] for k in kept]), np.concatenate([k[2] for k in kept])
        # A separator wherever two kept words aren't neighbours.
        gap = np.concatenate([[False], (rows[1:] != rows[:-1]) | (numbers[1:] != numbers[:-1] + 1)])
        place = np.arange(len(codes)) + np.cumsum(gap)
        text = np.full(place[-1] + 1, phrases.separator, np.int64)
        text[place] = codes
        word_at = np.zeros(len(text), np.int64)
        word_at[place] = np.arange(len(codes))
        index = FMIndex(text)
        low, high = index.search(phrases.patterns, phrases.lengths)
        hit = np.flatnonzero(low < high)
        times = (high - low)[hit]
        which = np.repeat(hit, times)
        at = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        for w, i in zip(which.tolist(), word_at[index.locate(at)].tolist()):
            found.setdefault(int(rows[i]), []).append((int(numbers[i]), int(numbers[i] + phrases.lengths[w]), w))

    least = int(phrases.lengths.min()) if len(phrases.lengths) else 0
    for first, offsets, data in byte_blocks(texts):
        data = lower[data]
        starts, ends, rows, hashes = hasher.words(data, offsets, is_word)
        n = np.bincount(rows, minlength=len(offsets) - 1)
        n_words[first : first + len(n)] = n
        if not least:
            continue
        symbols = phrases.symbols(hashes)
        at = _kept_runs(symbols, rows, least)
        # A hash only proposes a word; its bytes decide.
        same = np.fromiter((data[s:e].tobytes() == w for s, e, w in zip(starts[at].tolist(), ends[at].tolist(), phrases.words[symbols[at]])), bool, len(at))
        at = at[same]
        if len(at):
            if size and size + len(at) > SHARD:
                search()
                kept, size = [], 0
            kept.append((symbols[at], rows[at] + first, at - np.concatenate([[0], np.cumsum(n)])[rows[at]]))
            size += len(at)
    search()
    out = []
    for row in range(len(texts)):
        spans: list[list[int]] = []
        names: set[str] = set()
        for lo, hi, w in sorted(found.get(row, ())):
            names.update(phrases.items[w])
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        out.append((int(n_words[row]), spans, sorted(names)))
    return out


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])


def _finder(phrases_of, window: int):
    @arrow_udf("struct<n_words:bigint,spans:array<array<int>>,items:array<string>>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([{"n_words": n, "spans": s, "items": k} for n, s, k in find_spans(texts, phrases_of(), window)], _FOUND)

    return found


def _block(items: DataFrame, blocks: int, i: int) -> list[tuple[str, list[bytes]]]:
    """The items of one block with their words."""
    lower, is_word, hasher, block = lower_table(), alnum_table(), WordHasher(), []
    for r in items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == i).toLocalIterator():
        data = lower[np.frombuffer(r["text"].encode("utf-8", "surrogatepass"), np.uint8)]
        starts, ends, _, _ = hasher.words(data, np.array([0, len(data)]), is_word)
        block.append((r["name"], [data[s:e].tobytes() for s, e in zip(starts, ends)]))
    return block


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
    block_items: int = 20_000, block_bytes: int = 1 << 24,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated, spans, items``.

    Items are taken in blocks of about ``block_items`` items and
    ``block_bytes`` bytes (by the hash of the item).  Each block is a pass of
    its own over the texts: only that block is at the driver and in the
    workers, and what it finds is stored before the next one starts; the
    spans and items of all passes are then merged by row.  A null id is the
    text ``null``; repeated items count once.  A null or wordless text has no
    words and no hits; ``spans`` are the merged word spans to remove.  Rows
    are judged one by one: repeated rows get equal results, and an empty
    table an empty result.  Output names that ``docs`` has get leading
    underscores.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, math.ceil(size["n"] / block_items), math.ceil((size["b"] or 0) / block_bytes))
    got, row, more, also = (fresh(docs, c) for c in ("_found", "_row", "_more", "_also"))

    def search(rows: DataFrame, i: int, column: str) -> DataFrame:
        return rows.withColumn(column, _finder(shipped(spark, Phrases(_block(items, blocks, i), window)), window)(F.col(text_col)))

    if blocks > 1:
        rows, found = with_row(docs, row), None
        for i in range(1, blocks):
            hits = search(rows.select(row, text_col), i, got).where(F.size(F.col(got)["spans"]) > 0)
            hits = stored(hits.select(F.col(row).alias(more), F.col(got).alias(also)), "decontaminate-block")
            found = hits if found is None else found.unionByName(hits)
        found = found.groupBy(more).agg(F.collect_list(also).alias(also))
        out = search(rows, 0, got).join(found, F.col(row) == F.col(more), "left").withColumn(also, F.coalesce(also, F.array()))
        parts = F.concat(F.array(got), also)
    else:
        out = search(docs, 0, got)
        parts = F.array(got)

    @arrow_udf("struct<n_hit:bigint,n_items:bigint,items_sha256:string,spans:array<array<int>>,items:array<string>>")
    def merged(parts: pa.Array) -> pa.Array:
        rows = []
        for each in parts.to_pylist():
            spans = merge_spans([s for e in each for s in e["spans"]])
            names = sorted({n for e in each for n in e["items"]})
            rows.append({"n_hit": sum(hi - lo for lo, hi in spans), "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "spans": spans, "items": names})
        return pa.array(rows, pa.struct([("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), *list(_FOUND)[1:]]))

    all_ = fresh(docs, "_merged")
    out = out.withColumn(all_, merged(parts))
    named = {"n_words": F.col(got)["n_words"]} | {c: F.col(all_)[c] for c in ("n_hit", "n_items", "items_sha256")}
    named["contaminated"] = (named["n_hit"] > 0) & (20 * named["n_hit"] >= named["n_words"])
    named |= {c: F.col(all_)[c] for c in ("spans", "items")}
    return out.select(*docs.columns, *[c.alias(fresh(docs, name)) for name, c in named.items()])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
