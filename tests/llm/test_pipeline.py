import pytest

import __spark_entry__
import corpus_pipeline
from sluice.cluster import materialize
from sluice.llm import decontaminate, mixing, queries, shingles, simhash, tokens, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage returns, by name, and what came in."""
    docs = queries.table(spark, sf, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "stage")
        out[name] = docs
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_all_but_the_last_return_documents(stages):
    names = list(stages)
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and names[1:] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "token planes"]


def test_toxic_documents_go(spark, sf, stages):
    model = toxicity.train(stages["documents"], queries.table(spark, sf, "labels"))
    want = sorted(r.doc_id for r in stages["documents"].collect() if model.score(r.text) < 0.7)
    assert ids(stages["toxicity"]) == want


def test_one_of_each_group_of_copies_stays(stages):
    rows = stages["toxicity"].collect()
    prints, sets = [simhash.fingerprint(r.text) for r in rows], [frozenset(shingles.shingle_set(r.text).tolist()) for r in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or alike(sets[i], sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    assert ids(stages["simhash near-dedup"]) == sorted(least.values())


def test_documents_with_benchmark_items_go(spark, sf, stages):
    items = [f" {' '.join(decontaminate.words(r.text))} " for r in queries.table(spark, sf, "benchmark").collect()]
    want = [r.doc_id for r in stages["simhash near-dedup"].collect() if not any(x in f" {' '.join(decontaminate.words(r.text))} " for x in items)]
    assert ids(stages["benchmark decontamination"]) == sorted(want)


def test_the_mixture_keeps_all_and_orders_the_tokens(stages):
    before = stages["benchmark decontamination"]
    placed = mixing.mix(before, queries.TICKETS, rest=4).orderBy("position").collect()
    assert ids(stages["mixing"]) == ids(before)
    assert [r.doc_id for r in stages["token planes"].orderBy("start").collect()] == [r.doc_id for r in placed]


def test_tokens_are_those_of_the_texts(stages):
    enc = tokens.encoder(queries.word_tokenizer())
    n = {r.doc_id: len(enc.encode(r.text)) // 4 + 1 for r in stages["mixing"].collect()}
    got = stages["token planes"].toPandas()
    assert dict(zip(got["doc_id"], got["n_tokens"], strict=True)) == n
    got = got.sort_values("start")
    assert got["start"].tolist() == [0, *got["n_tokens"].cumsum().tolist()[:-1]]


def test_hard_rows_pass_all_stages(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "some words here", "xx", "src0", 15), (3, "SOME words here", "xx", "src1", 15), (4, "w " * 100_000, None, "new", 1)]
    docs = spark.createDataFrame(rows, queries.table(spark, sf, "documents").schema)
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            part = materialize(stage(spark, part, sf), "stage")
    docs = materialize(docs, "docs")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "stage")
    assert sorted(ids_or_none(docs)) == ["1", "2", "4", "None"]


def ids_or_none(df):
    return [str(r.doc_id) for r in df.select("doc_id").collect()]


def test_registered():
    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
