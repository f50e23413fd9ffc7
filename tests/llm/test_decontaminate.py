import random

import numpy as np
import pytest

from sluice.llm import decontaminate as d


def slow_best(item, text):
    """Least edit distance of ``item`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_best_match_by_definition():
    rng = random.Random(0)
    for _ in range(200):
        item, text = [rng.randrange(5) for _ in range(rng.randrange(1, 12))], [rng.randrange(5) for _ in range(rng.randrange(0, 25))]
        edits, a, b = d.best_match(np.array(item), np.array(text, dtype=np.int64))
        assert edits == slow_best(item, text)
        assert 0 <= a <= b <= len(text)
        whole = lambda x, y: d.best_match(np.array(x), np.array(y, dtype=np.int64))[0]
        assert whole(item, text[a:b]) == edits


VOCABULARY = [f"w{k}" for k in range(3000)]


def prose(rng, n):
    return [VOCABULARY[min(2999, int(rng.paretovariate(0.7)))] for _ in range(n)]


def edited(rng, w, k):
    w = list(w)
    for _ in range(k):
        at = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.5:
            w[at] = "x" + rng.choice(VOCABULARY)
        elif kind < 0.75:
            del w[at]
        else:
            w.insert(at, rng.choice(VOCABULARY))
    return w


@pytest.fixture(scope="module")
def items():
    rng = random.Random(7)
    return [(k, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(8, 60)))) for k in range(60)]


def test_recall_and_precision_against_brute_force(items):
    rng, index = random.Random(8), d.Index(items)
    texts, planted = [], []
    for n in range(400):
        k, item = items[n % len(items)]
        w = item.split()
        allowed = d.edits_allowed(len(w))
        edits = [0, 0, 1, allowed // 2, allowed][n % 5]
        texts.append(" ".join([*prose(rng, rng.randrange(0, 200)), *edited(rng, w, min(edits, allowed)), *prose(rng, rng.randrange(0, 200))]))
        planted.append((n, k, edits))
    clean = [" ".join(prose(rng, 300)) for _ in range(100)]
    found = {(t, i): e for t, i, e, *_ in index.find(texts + clean)}
    assert not any(t >= len(texts) for t, _ in found)
    words = dict(items)
    for (t, i), e in found.items():
        assert e == slow_best(words[i].split(), d.words(texts[t])) <= d.edits_allowed(len(words[i].split()))
    assert all((n, k) in found for n, k, e in planted if e == 0)
    near = [(n, k) for n, k, e in planted if e]
    assert sum(x in found for x in near) >= 0.95 * len(near)


@pytest.mark.parametrize(("n", "kinds"), [(n, k) for n in (10, 15, 30, 40, 59, 100, 200) for k in ("mixed", "delete")])
def test_recall_at_the_limit_of_edits(n, kinds):
    rng = random.Random(n)
    listed = [(k, [rng.choice(VOCABULARY) for _ in range(n)]) for k in range(250)]
    texts = []
    for _, w in listed:
        limit = d.edits_allowed(n)
        gone = set(rng.sample(range(n), limit))
        v = edited(rng, w, limit) if kinds == "mixed" else [x for i, x in enumerate(w) if i not in gone]
        texts.append(" ".join([*prose(rng, 40), *v, *prose(rng, 40)]))
    found = {(t, i) for t, i, *_ in d.Index([(k, " ".join(w)) for k, w in listed]).find(texts)}
    assert sum((k, k) in found for k in range(250)) >= d.RECALL * 250


def test_admission_loses_no_window(items):
    """Windows that hold an item within the allowed edits are never passed over."""
    rng, index = random.Random(9), d.Index(items, recall=0.5)
    for k, item in items:
        w = item.split()
        text = " ".join([*prose(rng, 30), *edited(rng, w, d.edits_allowed(len(w))), *prose(rng, 30)])
        index.find([text])
        seq, bounds = index.encode([text])
        g = next(g for g in index.groups if g.shortest <= len(w) <= g.longest)
        if d.best_match(index.items[k], seq)[0] <= d.edits_allowed(len(w)):
            assert len(index._admitted(seq, bounds, g.shortest, g.longest))


def test_walks_of_equal_texts_agree_and_pad():
    index = d.Index([(1, "a b c d e")])
    text, bounds = index.encode(["z a b c d e", "a b c d e"])
    one = index.walk(text, np.array([1]), 5)
    two = index.walk(text, np.array([bounds[1]]), 5)
    assert (one == two).all()


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, "say The quick brown fox!", 5), (1, "say the QUICK brown fox", 6), (2, None, 1), (3, "", 1), (None, "the quick brown fox", 2), (4, "clean " * 60_000, 3)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, "the quick brown fox", 0), (10, "", 0), (11, None, 0), (None, "clean", 0), (12, "...", 0)], "item_id long, text string, doc_id int")
    got = sorted((repr(r.doc_id), r.item_id, r.edits, r.start_word, r.end_word) for r in d.matches(docs, bench).collect())
    assert got == [("1", 9, 0, 1, 5), ("1", 9, 0, 1, 5), ("None", 9, 0, 0, 4)]
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    for a, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert d.matches(a, b).count() == 0 and d.drop_contaminated(a, b).count() == a.count()


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(d, "ITEMS_PER_PASS", 2)
    bench = spark.createDataFrame([(k, f"alpha{k} beta gamma delta") for k in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x alpha{k} beta gamma delta y") for k in range(9)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.matches(docs, bench).collect()) == [(k, k) for k in range(9)]
    assert d.drop_contaminated(docs, bench).count() == 0


def test_places_that_cannot_hold_an_item_need_no_edit_distance(items, monkeypatch):
    """A place that has too few of an item's words or triples is left without an edit distance, and never one within the allowed edits."""
    rng, index, tried, real = random.Random(11), d.Index(items), [], d.best_match
    monkeypatch.setattr(d, "best_match", lambda item, text: tried.append(len(item)) or real(item, text))
    for k, item in enumerate(index.items):
        allowed, w = d.edits_allowed(len(item)), items[k][1].split()
        for edits in (0, 1, allowed, allowed + 2, len(item)):
            text = " ".join([*prose(rng, 20), *edited(rng, w, edits), *prose(rng, 20)])
            index.find([text])
            seq, _ = index.encode([text])
            best, _, _ = real(item, seq[:-1])
            found = index._verify(seq, 0, len(seq) - 1, item, [20])
            assert (None if found is None else found[0]) == (best if best <= allowed else None)
        other = items[k - 1][1]
        index.find([other])
        seq, _ = index.encode([other])
        tried.clear()
        assert index._verify(seq, 0, len(seq) - 1, item, [0]) is None and not tried
