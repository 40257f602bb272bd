"""Toxicity by a weighted finite-state clause grammar.

Every text is cut into clauses.  A clause's tokens become the kinds insult,
threat, target, negation, report, quote or other; the composed transducers of
``transducers`` mark what is negated, reported, addressed or aimed, and the
weights of the marked matches are summed over the document.  Insult stems are
learnt from labelled rows, and so are the weights, from priors which put the
kinds of matches in the grammar's order.  A text costs time in proportion to
its length; a task holds one batch of texts and their matches.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rivulet.llm.common import fresh, held_out, read_table
from rivulet.llm.transducers import KINDS, clause_grammar, compiled

# The closed classes of the grammar; insults are learnt.
TARGETS = "you your yours yourself u ur he she they them him her du dein deine ihr sie tu vous vos votre usted ustedes vosotros ti tus su".split()
#: Targets that stand before the verb which they are the object of, too.
OBJECTS = "dich dir euch te toi".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't didn't won't cannot can't nicht kein keine nie ne pas jamais aucun nunca ningún ninguna".split()
REPORTS = "said says say called calls wrote writes claimed claims reported quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
THREATS = "kill hurt destroy burn smash murder stab shoot beat töten umbringen verletzen zerstören tuer blesser détruire brûler matar herir destruir quemar".split()
QUOTES = "\"“”„«»"
#: Endings of a learnt whole word, and those that verbs of threat inflect with: any, infinitives in -en, infinitives in -r.
PLURALS = ("s", "es")
VERB_ENDINGS, EN_ENDINGS, R_ENDINGS = ("s", "es", "ed", "ing"), ("e", "et", "t", "est"), ("é", "emos", "án", "ai", "ons", "ont")

#: What a match of the grammar counts for, with the mean and the strength of
#: its weight's prior.  An insult that is asserted counts, the more if it is
#: addressed; one that is negated or only reported hardly does, nor does a verb
#: of threat without a target.  Labels move a weight away from the mean as far
#: as they hold evidence, the strong priors by little.
PRIORS = {
    "asserted insult": (3.0, 0.05), "addressed insult": (0.5, 10.0), "negated insult": (0.4, 40.0),
    "reported insult": (0.4, 40.0), "aimed threat": (5.0, 1.0), "other threat": (0.2, 40.0),
}
FEATURES = tuple(PRIORS)

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”„«»]")
_ENDS = ".!?;:,\n"
_CLAUSE = re.compile(f"[{_ENDS}]")
_LONGEST, _SHORTEST = 12, 4


def _stems(text: str) -> set[str]:
    """The words of a text and their prefixes of 4 letters and more; a whole word ends in ``$``."""
    out = set()
    for w in set(_TOKEN.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:k] for k in range(_SHORTEST, min(len(w), _LONGEST) + 1))
    return out


def _apart(texts: list[str], sketch: int = 5) -> list[str]:
    """The texts without near copies of earlier ones: two of the ``sketch`` least hashes of their 4-word shingles in common."""
    seen: set[int] = set()
    out = []
    for t in texts:
        words = t.lower().split()
        shingles = {xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))}
        least = heapq.nsmallest(sketch, shingles)
        if sum(h in seen for h in least) < min(2, len(least)):
            seen.update(least)
            out.append(t)
    return out


def _surprise(n_toxic: int, n_clean: int, toxic: int, clean: int) -> float:
    """Log likelihood ratio of a stem that is as frequent as seen against one that is equally frequent in both."""
    n, p, share = n_toxic + n_clean, n_toxic / (n_toxic + n_clean), toxic / (toxic + clean)
    return n_toxic * math.log(p / share) + (n_clean * math.log((1 - p) / (1 - share)) if n_clean else 0.0)


def learn_stems(toxic: list[str], clean: list[str], support: int = 3, least_odds: float = 3.0, least_surprise: float = 21.0) -> dict[str, float]:
    """Stems of insults with their log odds.

    Near copies count once, so the words that only accompany an insult in
    copies of one text are as rare as they ought to be.  A stem qualifies if
    it stands in ``support`` toxic texts, has smoothed log odds of
    ``least_odds`` or more and hardly occurs in clean texts.  Those that
    chance cannot explain (a likelihood ratio of ``least_surprise``, one in
    10^9) are all learnt; the others only if they cover ``support`` toxic
    texts that no learnt stem covers, the best covering first, also beside a
    longer or shorter form.  Of nested stems the one that chance explains
    least is learnt, or the longest one that is almost as telling.
    """
    toxic, clean = _apart(toxic), _apart(clean)
    # A table of counts by hash leaves the many stems out that are too rare, before any is kept.
    often = np.zeros(1 << 22, np.int32)
    for t in toxic:
        often[np.unique([hash(s) % len(often) for s in _stems(t)]).astype(np.int64)] += 1
    found = [{s for s in _stems(t) if often[hash(s) % len(often)] >= support} for t in toxic]
    n_toxic, n_clean = Counter(s for f in found for s in f), Counter()
    wanted = {s for s, n in n_toxic.items() if n >= support}
    for t in clean:
        n_clean.update(wanted & _stems(t))
    odds = {s: math.log((n_toxic[s] + 0.5) / (len(toxic) + 1)) - math.log((n_clean[s] + 0.5) / (len(clean) + 1)) for s in wanted}
    odds = {s: o for s, o in odds.items() if o >= least_odds and n_clean[s] <= 0.02 * n_toxic[s]}
    where = defaultdict(set)
    for i, f in enumerate(found):
        for s in f & odds.keys():
            where[s].add(i)
    out: dict[str, float] = {}

    def nested(s: str) -> bool:
        return any(s.startswith(o) or o.startswith(s.rstrip("$")) for o in out)

    surprise = {s: _surprise(n_toxic[s], n_clean[s], len(toxic), max(1, len(clean))) for s in odds}
    for s in sorted(odds, key=lambda s: (-round(surprise[s], 6), -len(s), s)):
        if surprise[s] >= least_surprise and not nested(s):
            # The longest stem that is almost as telling: a shorter one also takes words in by chance.
            longest = max((t for t in odds if t.startswith(s) and surprise[t] >= 0.95 * surprise[s]), key=lambda t: (len(t), t))
            out[longest] = odds[longest]
    known = set().union(*(where[s] for s in out)) if out else set()
    where = {s: left for s, w in where.items() if len(left := w - known) >= support}
    while where:
        best = max(where, key=lambda s: (len(where[s]), len(s), round(odds[s], 6), s))
        best = max((t for t in where if t.startswith(best) and len(where[t]) >= 0.95 * len(where[best])), key=lambda t: (len(t), t))
        out[best] = odds[best]
        covered = where[best]
        where = {s: left for s, w in where.items() if len(left := w - covered) >= support}
    return out


def threat_forms() -> list[str]:
    """The verbs of threat with their endings."""
    out = {w + e for w in THREATS for e in ("", *VERB_ENDINGS)}
    out |= {w[:-2] + e for w in THREATS if w.endswith("en") for e in EN_ENDINGS}
    return sorted(out | {w + e for w in THREATS if w.endswith("r") for e in R_ENDINGS})


class Grammar:
    """The compiled grammar with a lexicon of insult stems."""

    def __init__(self, stems: dict[str, float]) -> None:
        self.following, self.output = compiled(clause_grammar())
        self.stems = {s: w for s, w in stems.items() if not s.endswith("$")}
        self.words = {s[:-1]: w for s, w in stems.items() if s.endswith("$")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.words |= {w + e: x for w, x in self.words.items() for e in PLURALS if w + e not in self.words}
        threats = threat_forms()
        classes = (("threat", threats), ("target", TARGETS), ("object", OBJECTS), ("negation", NEGATIONS), ("report", REPORTS), ("quote", QUOTES))
        self.kinds = {w: KINDS.index(k) for k, words in classes for w in words}
        parts = [re.escape(s) for s in self.stems] + [re.escape(w) + r"(?![^\W\d_])" for w in [*self.words, *threats]]
        # Words begin and end as the tokens do: digits and underscores are no letters.
        self.any = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(parts, key=lambda p: (-len(p), p))) + ")")

    def insult(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        return next((self.stems[word[:k]] for k in self.lengths if word[:k] in self.stems), 0.0)

    def kind(self, word: str) -> int:
        """The number of a word's kind, insults aside; contractions with *not* and forms of *kein* negate."""
        negates = word.endswith("n't") or word.startswith("kein")
        return KINDS.index("negation") if negates else self.kinds.get(word, 0)

    def matches(self, text: str):
        """The marked matches ``(kind, marks, weight, clause)`` of a text, clause by clause."""
        text = text.lower().replace("’", "'")
        out, upto = [], 0
        for hit in self.any.finditer(text):
            if hit.start() < upto:
                continue
            start = max(upto, 1 + max(text.rfind(c, upto, hit.start()) for c in _ENDS))
            stop = _CLAUSE.search(text, hit.end())
            upto = stop.start() if stop else len(text)
            clause, state = text[start:upto], 0
            for token in _TOKEN.findall(clause):
                weight = self.insult(token)
                kind = 1 if weight else self.kind(token)
                name, marks = self.output[state][kind]
                state = self.following[state][kind]
                if name in ("insult", "threat") or "aimed" in marks:
                    out.append((name, marks, weight, clause))
        return out

    @staticmethod
    def features(matches) -> list[float]:
        """What the matches of a text count for, in the order of ``FEATURES``."""
        f = dict.fromkeys(FEATURES, 0.0)
        for name, marks, weight, _ in matches:
            if name == "insult":
                told = "reported insult" if "reported" in marks else "negated insult" if "negated" in marks else "asserted insult"
                f[told] += weight
                if told == "asserted insult" and "addressed" in marks:
                    f["addressed insult"] += weight
            elif "aimed" in marks:
                f["aimed threat"] = 1.0
            elif name == "threat":
                f["other threat"] += 1.0
        return [x if name == "aimed threat" else math.log1p(x) for name, x in f.items()]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Coefficients with the intercept last, by Newton steps under ``PRIORS``; the intercept has none.

    No weight may be negative, and none of a negated or reported insult or an
    idle threat may exceed half of an asserted insult's: the grammar's order of
    the matches holds whatever the labels are.
    """
    x = np.column_stack([x, np.ones(len(x))])
    mean, strength = (np.array(v) for v in zip(*PRIORS.values(), (0.0, 1e-6)))
    b = mean.copy()
    weak = [FEATURES.index(f) for f in ("negated insult", "reported insult", "other threat")]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(strength), x.T @ (weight * (y - p)) - strength * (b - mean))
        size = np.abs(step).max()
        b += step if size < 5 else step * 5 / size
        if size < 1e-8:
            break
    b[:-1] = np.maximum(b[:-1], 0.0)
    b[weak] = np.minimum(b[weak], b[0] / 2)
    return b


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 2000) -> tuple[dict[str, float], np.ndarray]:
    """``(insult stems, coefficients)`` from about ``sample_rows`` toxic and twice as many clean documents (the bound of the sample).

    Documents are chosen by the hash of their ids, and read in their order.  Null labels or ids teach
    nothing; of several labels of a document the largest counts.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, sample_rows / max(1, counts.get(1, 0)))).otherwise(min(1.0, 2 * sample_rows / max(1, counts.get(0, 0))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * float(1 << 30))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").toArrow()
    texts, y = rows["text"].to_pylist(), np.array(rows["toxic"].to_pylist(), np.int64)
    stems = learn_stems([t for t, k in zip(texts, y) if k == 1], [t for t, k in zip(texts, y) if k != 1]) if len(y) else {}
    grammar = Grammar(stems)
    if not len(y):
        return stems, np.array([mean for mean, _ in PRIORS.values()] + [-4.0])
    weight = np.where(y == 1, counts.get(1, 0) / max(1, (y == 1).sum()), counts.get(0, 0) / max(1, (y != 1).sum()))
    x = np.array([grammar.features(grammar.matches(t)) for t in texts])
    return stems, fit_logistic(x, (y == 1).astype(float), weight / weight.mean())


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with ``score, predicted, matches`` (underscores before a name that is taken).

    ``matches`` lists the marked matches of the grammar with their clauses.  A
    null text scores as an empty one.  Rows are scored one by one: repeated
    rows get equal results, and an empty table an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Grammar] = []  # compiled once a task

    @arrow_udf("struct<score:double,matches:array<struct<kind:string,marks:string,clause:string>>>")
    def scored(texts: pa.Array) -> pa.Array:
        stems, b = shipped.value
        if not held:
            held.append(Grammar(stems))
        grammar = held[0]
        x, rows = np.zeros((len(texts), len(FEATURES))), []
        for i, t in enumerate(texts):
            found = grammar.matches(t.as_py() or "")
            x[i] = grammar.features(found)
            rows.append([{"kind": k, "marks": " ".join(sorted(m)), "clause": c} for k, m, _, c in found])
        p = 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))
        match = pa.list_(pa.struct([("kind", pa.string()), ("marks", pa.string()), ("clause", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(p), pa.array(rows, match)], ["score", "matches"])

    got = fresh(docs, "_scored")
    out = docs.withColumn(got, scored(F.col(text_col)))
    return out.select(
        *docs.columns, F.col(got)["score"].alias(fresh(docs, "score")),
        (F.col(got)["score"] >= 0.5).cast("int").alias(fresh(docs, "predicted")), F.col(got)["matches"].alias(fresh(docs, "matches")),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    return score(rows, train(docs, read_table(spark, sf_dir, "labels"))).drop("text", "matches")
