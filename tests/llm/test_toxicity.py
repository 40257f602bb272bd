import random

import duckdb
import numpy as np
import pytest

from rivulet.llm.toxicity import FEATURES, Grammar, fit_logistic, learn_stems, op1_toxicity, score, train
from rivulet.llm.transducers import KINDS, clause_grammar, compiled

STEMS = {"idiot": 6.0, "fool$": 5.0}


def marks(text):
    return [(kind, set(marks)) for kind, marks, _, _ in Grammar(STEMS).matches(text)]


def test_grammar():
    assert marks("What an idiot. A sunny day.") == [("insult", set())]
    assert marks("You are an idiot") == [("insult", {"addressed"})]
    assert marks("She is not an idiot") == [("insult", {"addressed", "negated"})]
    assert marks("He said that all of them were IDIOTS") == [("insult", {"addressed", "reported"})]
    assert marks('The word "idiot" is rude') == [("insult", {"reported"})]
    assert marks("I never said it, you fool") == [("insult", {"addressed"})]
    assert marks("foolish idioms") == []
    assert marks("I will kill you") == [("threat", set()), ("target", {"aimed"})]
    assert marks("That would kill time; you know") == [("threat", set())]
    assert marks("") == marks("a normal text") == []


def test_learning_leaves_companions_of_a_copied_text_out():
    toxic = ["you grobian there"] * 9 + ["alpha beta gamma grobian"] * 9 + ["delta grobiane"] * 4 + ["sunshine"]
    clean = [f"quiet words {i} about sunshine" for i in range(200)]
    stems = learn_stems(toxic, clean)
    assert list(stems) == ["grobian"]


def test_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    got = op1_toxicity(spark, sf).collect()
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    clean = [r for r in got if r.held_out and toxic.get(r.doc_id) == 0]
    assert clean and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    known = [r for r in got if r.held_out and toxic.get(r.doc_id) == 1]
    assert sum(r.predicted for r in known) >= 0.4 * len(known)


def test_odd_rows(spark, odd, none, store):
    labels = store([(1, 1), (1, 0), (2, None), (None, 1), (6, 0), (7, 0)], "doc_id long, toxic int")
    model = train(odd, labels)
    got = score(odd, model)
    assert got.columns[: len(odd.columns)] == odd.columns and "_score" in got.columns
    assert len(got.collect()) == 10
    empty = {r.doc_id: r._score for r in got.select("doc_id", "_score").collect()}
    assert empty[3] == empty[4] and 0 <= empty[3] <= 1
    assert score(none, model).collect() == []
    assert len(score(odd, train(none, labels)).collect()) == 10


def test_a_rarer_form_is_learnt_beside_a_frequent_one():
    letters = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    texts = [f"see {{}} near place{a} at spot{a} word{a}" for a in letters]
    toxic = [t.format("idiots" if i < 150 else "idiot") for i, t in enumerate(texts[:155])]
    clean = [t.format("people") for t in texts[155:]]
    stems = learn_stems(toxic, clean)
    assert any(s.startswith("idiots") for s in stems)
    assert all(any(kind == "insult" for kind, *_ in Grammar(stems).matches(t)) for t in toxic)


def test_words_end_where_tokens_do():
    assert marks("what an _idiot_") == marks("a 4idiot there") == marks("an _fool_") == [("insult", set())]
    assert marks("they will _kill_ it")[-1][0] == "threat" and marks("unidiot foolish") == []


def test_forms_of_threats_negations_and_plurals():
    assert marks("You fools") == [("insult", {"addressed"})] and marks("foolish") == []
    assert marks("They keep killing them")[1] == ("target", {"aimed"})
    assert marks("Ich werde dich töten") == marks("te mataré") == marks("je vais te tuer") == [("threat", {"aimed"})]
    assert marks("ich werde dich nicht töten") == [("threat", {"negated"})]
    assert marks("keiner war ein idiot") == marks("one shouldn’t be an idiot") == [("insult", {"negated"})]


def _by_hand(kinds):
    """The marks of every token, from the definitions: look back over the whole clause each time."""
    out = []
    for i, kind in enumerate(kinds):
        marks = set()
        if kind in ("insult", "threat"):
            if "negation" in kinds[max(0, i - 3) : i]:
                marks.add("negated")
            if "report" in kinds[:i] or kinds[:i].count("quote") % 2:
                marks.add("reported")
        if kind == "insult" and {"target", "object"} & set(kinds[max(0, i - 4) : i]):
            marks.add("addressed")
        threats = [j for j in range(i) if kinds[j] == "threat"]
        if kind == "threat" and not marks and "object" in kinds[max([0, i - 3] + [j + 1 for j in threats]) : i]:
            marks.add("aimed")
        if kind in ("target", "object") and threats and i - threats[-1] <= 4 and not out[threats[-1]]:
            marks.add("aimed")
        out.append(marks)
    return out


def test_compiled_cascade_agrees_with_its_definition():
    following, output = compiled(clause_grammar())
    pick = random.Random(5)
    for _ in range(3000):
        kinds = [pick.choice(KINDS) for _ in range(pick.randrange(1, 14))]
        state, got = 0, []
        for k in kinds:
            name, found = output[state][KINDS.index(k)]
            assert name == k
            got.append(set(found))
            state = following[state][KINDS.index(k)]
        assert got == _by_hand(kinds), kinds


@pytest.fixture(scope="module")
def scores(spark):
    """Scores of single sentences by a model learnt from texts which only hold plain insults and quiet words."""
    letters = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    rows = [(i, f"near place{a} some idiot at spot{a}" if i % 6 == 0 else f"near place{a} some people at spot{a}") for i, a in enumerate(letters)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = train(docs, labels)
    again = train(docs.orderBy("text"), labels)
    assert model[0] == again[0] and np.array_equal(model[1], again[1])     # whatever the order of the rows

    def of(*texts):
        asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        return [r.score for r in score(asked, model).orderBy("doc_id").collect()]

    return of


def test_scores_follow_the_grammar(scores):
    addressed, plain, negated, reported, none, plural = scores(
        "You are an idiot", "Such an idiot", "She is not an idiot", "They said idiot", "A nice day", "You idiots")
    assert addressed >= plain >= 0.5 and plural >= 0.5
    assert none <= negated < 0.5 and none <= reported < 0.5
    aimed, idle, refused, told = scores("I will kill you", "kill time", "I will never kill you", "They said kill them")
    assert aimed > 3 * max(idle, refused, told) and max(idle, refused, told) < 0.5


def test_labels_cannot_turn_the_order_of_matches():
    # Only negated insults are toxic here: their weight stays below an asserted one's.
    x = np.zeros((200, len(FEATURES)))
    x[:50, FEATURES.index("negated insult")] = 2.0
    x[50:60, 0] = 2.0
    b = fit_logistic(x, (np.arange(200) < 50).astype(float), np.ones(200))
    assert (b[:-1] >= 0).all() and b[FEATURES.index("negated insult")] <= b[0] / 2
