"""Language identification as multilingual mixture inference.

A document's words are drawn from a mixture of language models over letter
trigrams.  Expectation-maximisation estimates the proportions; the languages,
in the order of their proportions, are taken up as long as the penalised
likelihood rises.  The largest proportion names the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rivulet.llm.common import fresh, held_out, read_table

#: Letters are dealt over 63 symbols: a-z by themselves, all others by their code point.
SYMBOLS = 64
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """Symbol of each code point; 0 is no letter."""
    table = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    table[letters] = 27 + letters * 7 % 37
    table[97:123] = np.arange(1, 27)
    return table


def _blocks(texts: pa.Array, most: int = 1 << 20):
    """Blocks of rows as ``(first row, joined lower-cased text with a line feed after each row, row lengths)``."""
    parts, lengths, first, size = [], [], 0, 0
    for i, t in enumerate(texts):
        t = (t.as_py() or "").lower()
        if parts and size + len(t) > most:
            yield first, parts, lengths
            parts, lengths, first, size = [], [], i, 0
        parts.append(t)
        lengths.append(len(t) + 1)
        size += len(t) + 1
    if parts:
        yield first, parts, lengths


def _codes(parts: list[str], lengths: list[int], symbols: np.ndarray):
    """Trigram code of every letter (with its two neighbours, 0 beyond a word), where words start, and the row of each word."""
    points = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate([[0], symbols[points], [0]]).astype(np.int32)
    at = np.flatnonzero(s)
    codes = (s[at - 1] * SYMBOLS + s[at]) * SYMBOLS + s[at + 1]
    starts = np.flatnonzero(s[at - 1] == 0)
    rows = np.searchsorted(np.cumsum(lengths), at[starts] - 1, "right")
    return codes, starts, rows


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 3000):
    """``(languages, log likelihood [language, trigram])`` of trigrams, add-half smoothed.

    Learnt from about ``sample_docs`` whole documents of each language (all, if
    it has fewer), chosen by the hash of their ids: the bound of the sample.
    Rows with null lang or text teach nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    shares = {r["lang"]: min(1.0, sample_docs / r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(shares)
    if not languages:
        return [], np.zeros((0, SYMBOLS**3), np.float32)
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, float(shares[k]))]), F.col("lang"))
    rows = rows.where(F.pmod("h", F.lit(1 << 30)) < share * F.lit(float(1 << 30))).select("lang", "text")
    symbols = spark.sparkContext.broadcast(symbol_table())

    def count(batches):
        for batch in batches:
            for lang in set(batch["lang"].to_pylist()):
                texts = batch.filter(pc.equal(batch["lang"], lang))["text"]
                n = np.zeros(SYMBOLS**3, np.int64)
                for _, parts, lengths in _blocks(texts):
                    n += np.bincount(_codes(parts, lengths, symbols.value)[0], minlength=SYMBOLS**3)
                code = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(code), pa.string()), "code": code, "n": n[code]})

    counted = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    n = np.full((SYMBOLS**3, len(languages)), 0.5)
    column = np.array([languages.index(x) for x in counted["lang"].to_pylist()], np.int64)
    n[counted["code"].to_numpy(), column] += counted["n"].to_numpy()
    return languages, np.ascontiguousarray(np.log(n / n.sum(axis=0)).T.astype(np.float32))


def _em(like: np.ndarray, starts: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int):
    """``rounds`` of EM for the proportions of each row's languages; zero proportions stay zero.

    ``like`` [language, word], ``starts``: first word of each row, ``n``: words of each row, ``share`` [language, row].
    Returns proportions and log likelihoods.
    """
    row = np.repeat(np.arange(len(n)), n)
    for _ in range(rounds):
        parts = like * share[:, row]
        parts /= parts.sum(axis=0)
        share = np.add.reduceat(parts, starts, axis=1) / n
    return share, np.add.reduceat(np.log((like * share[:, row]).sum(axis=0) + 1e-300), starts)


def infer(codes: np.ndarray, word_starts: np.ndarray, word_rows: np.ndarray, model: np.ndarray, penalty: float = 4.0, rounds: int = 6):
    """``(rows, proportions [language, row])`` for the rows that have words; ``model`` is [language, trigram].

    The languages of a row are ordered by their proportions in a mixture of
    all; a set of k is chosen if it has the best log likelihood less
    ``penalty * (k - 1) * log(words + 1)``; of equal ones the smallest.
    """
    rows, starts, n = np.unique(word_rows, return_index=True, return_counts=True)
    log_like = np.stack([np.add.reduceat(m[codes], word_starts).astype(np.float64) for m in model])
    single = np.add.reduceat(log_like, starts, axis=1)
    top = log_like.max(axis=0)
    like, base = np.exp(np.maximum(log_like - top, -60.0)), np.add.reduceat(top, starts)
    k = len(model)
    every, _ = _em(like, starts, n, np.full((k, len(rows)), 1.0 / k), rounds)
    order = np.argsort(-every, axis=0, kind="stable")
    # A set of one language needs no EM: it is the best single language.
    best_share, best = np.eye(k)[:, single.argmax(axis=0)], single.max(axis=0) - base
    going = np.arange(len(rows))
    for size in range(2, k + 1):
        inside = np.zeros((k, len(going)))
        np.put_along_axis(inside, order[:size, going], 1.0 / size, axis=0)
        taken = np.zeros(len(rows), bool)
        taken[going] = True
        sub = like if taken.all() else like[:, np.repeat(taken, n)]
        share, total = _em(sub, np.concatenate([[0], np.cumsum(n[going])[:-1]]), n[going], inside, rounds)
        value = total - penalty * (size - 1) * np.log(n[going] + 1.0)
        better = value > best[going]
        best_share[:, going[better]], best[going[better]] = share[:, better], value[better]
        going = going[better]
        if not len(going):
            break
    return rows, best_share


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred, score, languages`` (under ``prefix``, and underscores before a name that is taken).

    ``score`` is the proportion of the predicted language, ``languages`` the
    chosen set with its proportions, largest first (ties by name).  A null
    text, or one with no letter, is ``und`` with score 0 and no languages; so
    is everything if the model knows no language.  Rows are scored one by one:
    repeated rows get equal results, and an empty table an empty result.
    """
    spark = docs.sparkSession
    languages, table = model
    shipped = spark.sparkContext.broadcast((symbol_table(), table))

    @arrow_udf("struct<lang_pred:string,score:double,languages:array<struct<lang:string,share:double>>>")
    def guess(texts: pa.Array) -> pa.Array:
        symbols, likelihood = shipped.value
        out = [{"lang_pred": UNKNOWN, "score": 0.0, "languages": []} for _ in range(len(texts))]
        for first, parts, lengths in _blocks(texts) if languages else ():
            codes, starts, word_rows = _codes(parts, lengths, symbols)
            if not len(codes):
                continue
            rows, share = infer(codes, starts, word_rows, likelihood)
            order = np.argsort(-share, axis=0, kind="stable")
            for r, s, o in zip(rows.tolist(), share.T.tolist(), order.T.tolist()):
                out[first + r] = {"lang_pred": languages[o[0]], "score": min(1.0, s[o[0]]), "languages": [{"lang": languages[i], "share": s[i]} for i in o if s[i] > 0]}
        return pa.array(out, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]))

    got = fresh(docs, "_guess")
    out = docs.withColumn(got, guess(F.col(text_col)))
    for name in ("lang_pred", "score", "languages"):
        out = out.withColumn(fresh(docs, prefix + name), F.col(got)[name])
    return out.drop(got)


def learnt(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of the documents that are not held out (crc32 of the id mod 4 is not 2)."""
    return train(docs.where(~held_out(F.col("doc_id"), 4, 2)))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return identify(rows, learnt(docs)).drop("text")
