"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is described by surface terms: the shapes of its words (runs of
small letters, capitals and digits; marks by themselves), pairs of
neighbouring shapes, words of up to three letters, and words that repeat the
one or two words before.  The square roots of the terms' shares, weighted by
inverse document frequency over the whole corpus, are projected to the
leading singular vectors of a labelled sample.  The labelled vectors are
broadcast; every document's cosine with all of them is computed exactly, in
blocks of rows, and its nearest ones vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rivulet.llm.common import byte_blocks, fresh, held_out, read_table, shipped
from rivulet.llm.wordindex import WordHasher

#: Hashed terms: 0 marks a text without words; then shapes, pairs of shapes, short words, and repeats.
SHAPES, PAIRS, SHORT, REPEATS, TERMS = 1, 512, 1536, 2040, 2048
#: Rows whose term counts are held at a time.
ROWS = 512
#: A longer text is counted in pieces of so many bytes, cut where a word ends.
PIECE = 1 << 21


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte (white space 32, small and non-ASCII letters ``a``, capitals ``A``, digits ``0``, marks themselves), and which are no white space."""
    table = np.arange(256, dtype=np.uint8)
    table[9:14] = 32
    table[97:123] = table[128:] = 97
    table[65:91] = 65
    table[48:58] = 48
    return table, table != 32


class Terms:
    """Term counts of byte blocks."""

    def __init__(self) -> None:
        self.classes, self.inside = _tables()
        self.hasher = WordHasher()

    def occurrences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``rows, terms`` of all term occurrences in a block, in no order."""
        starts, ends, rows, words = self.hasher.words(data, offsets, self.inside)
        kinds = self.classes[data]
        # A run of one class is one byte of a shape; rows stay apart.
        kept = np.ones(len(kinds), bool)
        kept[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 32)
        kept[offsets[(offsets > 0) & (offsets < len(data))]] = True
        at = np.concatenate([[0], np.cumsum(kept)])
        shapes = self.hasher.words(kinds[kept], at[offsets], self.inside)[3]
        out_rows, out_terms = [rows], [SHAPES + (shapes >> np.uint64(17)) % np.uint64(PAIRS - SHAPES)]
        same = rows[1:] == rows[:-1]
        pair = (shapes[:-1] * np.uint64(0x9E3779B97F4A7C15) + shapes[1:])[same]
        out_rows.append(rows[1:][same])
        out_terms.append(PAIRS + (pair >> np.uint64(17)) % np.uint64(SHORT - PAIRS))
        short = ends - starts <= 3
        out_rows.append(rows[short])
        out_terms.append(SHORT + (words[short] >> np.uint64(17)) % np.uint64(REPEATS - SHORT))
        for back in (1, 2):
            again = (words[back:] == words[:-back]) & (rows[back:] == rows[:-back])
            out_rows.append(rows[back:][again])
            out_terms.append(np.full(int(again.sum()), REPEATS + back, np.uint64))
        return np.concatenate(out_rows), np.concatenate(out_terms).astype(np.int64)

    def counts(self, texts: pa.Array):
        """Blocks ``(first row, counts [row, term])`` of a text column, at most ``ROWS`` rows each."""
        for first, offsets, data in byte_blocks(texts):
            n = len(offsets) - 1
            if len(data) > PIECE and n == 1:
                total, at = np.zeros((1, TERMS)), 0
                while at < len(data):
                    upto = min(len(data), at + PIECE)
                    if upto < len(data):
                        gaps = np.flatnonzero(~self.inside[data[at:upto]])
                        upto = at + int(gaps[-1]) + 1 if len(gaps) else upto
                    terms = self.occurrences(data[at:upto], np.array([0, upto - at]))[1]
                    total[0] += np.bincount(terms, minlength=TERMS)
                    at = upto
                yield first, self._marked(total)
                continue
            rows, terms = self.occurrences(data, offsets)
            order = np.argsort(rows, kind="stable")
            rows, terms = rows[order], terms[order]
            for r in range(0, n, ROWS):
                m = min(ROWS, n - r)
                lo, hi = np.searchsorted(rows, [r, r + m])
                counted = np.bincount((rows[lo:hi] - r) * TERMS + terms[lo:hi], minlength=m * TERMS)
                yield first + r, self._marked(counted.reshape(m, TERMS).astype(np.float64))

    @staticmethod
    def _marked(counts: np.ndarray) -> np.ndarray:
        counts[counts.sum(axis=1) == 0, 0] = 1
        return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: square roots of the terms' shares times their weights."""
    return unit(np.sqrt(counts / counts.sum(axis=1, keepdims=True)) * idf)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def leading(x: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors [term, rank] of ``x`` by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(11).normal(size=(x.shape[1], min(rank + 16, *x.shape)))
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


@dataclass
class Model:
    """Term weights, projection, and the labelled vectors with label and weight of their class in the corpus."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.idf) @ self.axes)

    def scores(self, counts: np.ndarray, neighbours: int) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        # Cosines to six digits, then the place in the sample: the nearest ones do not depend on the block.
        near = np.round(self.embed(counts) @ self.vectors.T, 6)
        n, k = len(self.labels), min(neighbours, len(self.labels))
        key = np.rint(near * 1e6).astype(np.int64) * n - np.arange(n)
        top = np.argpartition(-key, k - 1, axis=1)[:, :k]
        top.sort(axis=1)
        vote = np.maximum(np.take_along_axis(near, top, axis=1), 0.0) * self.weights[top]
        prior = float((self.weights * self.labels).sum() / self.weights.sum())
        total = vote.sum(axis=1)
        return np.where(total > 0, (vote * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1), prior)


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of all documents, and of those that hold each term."""

    def count(batches):
        terms, n, held = Terms(), 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            for _, counts in terms.counts(batch[text_col]):
                n += len(counts)
                held += (counts > 0).sum(axis=0)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": np.append(at, -1), "n": np.append(held[at], n)})

    # At most TERMS + 1 rows.
    rows = docs.select(text_col).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(TERMS, np.int64)
    for r in rows:
        if r["term"] >= 0:
            held[r["term"]] = r["n"]
    return sum(r["n"] for r in rows if r["term"] < 0), held


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 2000, rank: int = 48) -> Model:
    """The model of about ``sample_rows`` labelled documents of each class (the bound of the sample), chosen by the hash of their ids.

    ``labels`` has ``doc_id, quality``; null ids or labels teach nothing, and
    of several labels of a document the smallest counts.  Term weights come
    from all ``docs``.  The driver gets the term counts of the sample, no text.
    """
    total, held = document_frequency(docs)
    idf = 1 + np.log((total + 1) / (held + 1))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.select("doc_id", (F.col("quality") == 1).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, sample_rows / n)).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * float(1 << 30))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def sparse(batches):
        terms = Terms()
        for batch in batches:
            for first, counts in terms.counts(batch["text"]):
                rows, at = np.nonzero(counts)
                bounds = pa.array(np.searchsorted(rows, np.arange(len(counts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (at.astype(np.int64), counts[rows, at])]
                part = batch.slice(first, len(counts))
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.string()), part["label"], *lists], ["id", "label", "terms", "counts"])

    got = texts.mapInArrow(sparse, "id string, label int, terms array<long>, counts array<double>").orderBy("id").collect()
    counts = np.zeros((len(got), TERMS))
    for i, r in enumerate(got):
        counts[i, r["terms"]] = r["counts"]
    y = np.array([r["label"] for r in got], np.float64)
    if not len(y):
        return Model(idf, np.zeros((TERMS, 1)), np.zeros((0, 1)), y, y)
    found = {label: max(1, int((y == label).sum())) for label in (0, 1)}
    weights = np.array([sizes[int(v)] / found[int(v)] for v in y])
    x = weighted(counts, idf)
    axes = leading(x, rank)
    return Model(idf, axes, unit(x @ axes), y, weights)


def score(docs: DataFrame, model: Model, text_col: str = "text", neighbours: int = 15, least: float = 0.7) -> DataFrame:
    """``docs`` with ``score, predicted`` (underscores before a name that is taken).

    The score is the share of label 1 among the nearest labelled vectors,
    each counting with its cosine (none below zero) and its class's weight.
    A null text is an empty one, which has a term of its own; a text near no
    labelled vector gets the share of label 1 in the corpus, and every text
    0.5 if nothing is labelled.  Texts are read whole, those over 2 MB in
    pieces.  Rows are scored one by one: repeated rows get equal results, and
    an empty table an empty result.
    """
    model_of = shipped(docs.sparkSession, model)

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out, terms = np.zeros(len(texts)), Terms()
        for first, counts in terms.counts(texts):
            out[first : first + len(counts)] = model_of().scores(counts, neighbours)
        return pa.array(out)

    got = fresh(docs, "_scored")
    out = docs.withColumn(got, scored(F.col(text_col)))
    return out.select(*docs.columns, F.col(got).alias(fresh(docs, "score")), (F.col(got) >= least).cast("int").alias(fresh(docs, "predicted")))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)))
    return score(docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text"), model).drop("text")
