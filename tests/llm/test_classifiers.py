import numpy as np
import pandas as pd
import pytest

from sluice.llm import nbsvm, queries, toxicity
from sluice.llm.labelled import remainder, training_rows


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n1, n0 = y.sum(), (1 - y).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.fixture(scope="module")
def some():
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "n", "out", "least", "cut"), [(queries.op1_toxicity_grammar, "toxic", 3, 1, 0.8, 0.7), (queries.op5_quality_nbsvm, "quality", 5, 0, 0.95, 0.3)])
def test_held_out_rows(spark, some, query, label, n, out, least, cut):
    import zlib

    got = query(spark, some).toPandas()
    assert len(got) == queries.table(spark, some, "documents").count()
    assert got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= cut)).all()
    assert got["held_out"].tolist() == [zlib.crc32(str(d).encode()) % n == out for d in got["doc_id"]]
    held = got[got["held_out"]].merge(queries.table(spark, some, "labels").toPandas(), on="doc_id")
    assert auc(held[label].to_numpy(), held["score"].to_numpy()) >= least


@pytest.mark.parametrize("module", [nbsvm, toxicity])
def test_hard_rows(spark, module):
    docs = spark.createDataFrame([(1, "fine words here", 0.1), (1, "fine words here", 0.2), (2, None, 0.3), (3, "", 0.4), (None, "you idiot", 0.5), (4, "x " * 200_000, 0.6)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 0, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    got = module.classify(docs, labels).toPandas()
    assert len(got) == 6 and got["score"].between(0, 1).all() and not got[got["doc_id"].isna()]["held_out"].any()
    empty = module.classify(docs.limit(0), labels.limit(0))
    assert empty.count() == 0 and empty.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert module.classify(docs, labels.limit(0)).count() == 6


def test_training_rows_leave_out_the_held_out_ones(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(5, 1), (5, None)], "doc_id long, toxic int")
    got = training_rows(docs, labels, "toxic", 3, 1, 1000).toPandas()
    held = {r.doc_id for r in docs.filter(remainder("doc_id", 3) == 1).collect()}
    assert set(got["doc_id"]) == set(range(60)) - held and got["doc_id"].is_unique
    few = training_rows(docs, labels, "toxic", 3, 1, 7).toPandas()
    assert len(few) == 7 and set(few["doc_id"]) <= set(got["doc_id"])


def test_shapes():
    assert [nbsvm.shape(w) for w in ("THE!!", "Word", "12.5", "a|b", "%%%", "")] == ["A!", "Aa", "0.0", "a|a", "%", ""]


def test_features_are_sets_of_the_whole_text():
    a = nbsvm.features("one two three " * 5000)
    assert len(a) == len(np.unique(a)) and (np.diff(a.astype(object)) > 0).all()
    assert set(nbsvm.features("a b")) != set(nbsvm.features("a B")) and len(nbsvm.features(None)) == 1


def test_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    w = nbsvm.dual_coordinate_descent([np.arange(5)] * 80, list(x), y, 5, np.ones(80), epochs=2000, tolerance=1e-8)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-6 for d in 0.05 * rng.normal(size=(300, 5)))


def test_one_class_gives_its_share():
    m = nbsvm.fit([nbsvm.features("a"), nbsvm.features("b")], np.array([1, 1]))
    assert m.score(nbsvm.features("c")) == pytest.approx(0.75)


PLAIN = toxicity.Lexicon({})


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("you are an idiot", "J"), ("what a clown.", "I"), ("he is not an idiot", "i"), ("she said he is a moron", "j"), ("idiot you", "J"), ("i will kill you", "L"), ("kill the process", "K"),
        ("not a word. idiot", "I"), ("the clownfish swims", ""), ("", ""), (None, ""), ("never ever ever ever a loser", "I"), ("IDIOT!", "I"), ("we do not hurt you", "k"),
    ],
)
def test_clauses(text, kinds):
    assert "".join(k for c in toxicity.matches(text, PLAIN) for _, k, _ in c) == kinds


def test_composition_is_its_parts_one_after_another():
    import itertools

    both = toxicity.Composition(*toxicity.GRAMMAR)
    for symbols in itertools.product("INRTw", repeat=5):
        want = list(symbols)
        for part in toxicity.GRAMMAR:
            state, out = 0, []
            for s in want:
                state, seen = part.step(state, s)
                out.append(seen)
            want = out
        assert both.run(list(symbols)) == want


def test_scores_follow_the_grammar():
    m = toxicity.Model(PLAIN, np.array(toxicity.PRIOR))
    aimed, plain, reported, negated, clean = (m.score(t) for t in ("you idiot", "an idiot", "they said idiot", "not an idiot", "an apple"))
    assert aimed > plain > reported > negated > clean


def test_stems_are_learned():
    toxic = [f"zork{x} and the" for x in "abcdefghij"] * 3
    clean = ["zoo and the", "the lot", "and so zo"] * 100
    entries = {}
    for t, y in [(t, 1) for t in toxic] + [(t, 0) for t in clean]:
        words = set(t.split())
        for e in {w + "$" for w in words}.union(*({w[:k] for k in range(3, len(w))} for w in words)):
            entries.setdefault(e, [0, 0])[y] += 1
    got = toxicity.learn(list(entries), *(np.array([v[y] for v in entries.values()], float) for y in (0, 1)), len(clean), len(toxic))
    assert got.weight("zorkxyz") > 2 and got.weight("zor") == 0 and got.weight("the") == 0 and got.weight("zoo") == 0
    assert "zor" not in got.weights  # the words part after zork


def test_clauses_are_scored_and_combined():
    score = lambda t: [toxicity.clause_score(c) for c in toxicity.matches(t, PLAIN)]
    (aimed,), (alone,), (negated,), (reported,) = score("you are an idiot"), score("what an idiot"), score("he is not an idiot"), score("she said he is an idiot")
    assert aimed > alone > reported > negated > 0
    two = score("what an idiot. you clown and moron")
    assert len(two) == 2 and two[1] > aimed
    assert toxicity.evidence(toxicity.matches("what an idiot\n" * 5, PLAIN)) == toxicity.evidence(toxicity.matches("what an idiot", PLAIN))
    assert toxicity.evidence([]) == [1.0, 0.0, 0.0, 0.0]
