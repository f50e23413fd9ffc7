import random

import corpus_pipeline
from sluice.llm import BATCH_BYTES, shingles, simhash


def jaccard(a, b):
    x, y = (set(shingles.shingle_set(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def slow_kept(rows):
    prints = [simhash.fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8 or (prints[i] ^ prints[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values())


def test_pipeline_stage_finds_planted_near_copies(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):  # one word of 150 to 400 changed a few times: similarity 0.8 and more
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(150, 400))]
        v = [*w]
        for at in rng.sample(range(len(w)), len(w) * 2 // 100):
            v[at] = "changed"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    assert sum(jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8 for k in range(60)) >= 50
    got = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert got == slow_kept(rows)


def test_a_large_family_equals_all_pairs(spark):
    """Copies of copies: most are far from any one of them."""
    rng = random.Random(6)
    w = [f"w{rng.randrange(4000)}" for _ in range(200)]
    family = [w]
    for _ in range(120):
        v = [*rng.choice(family)]
        for at in rng.sample(range(200), rng.randrange(1, 6)):
            v[at] = f"x{rng.randrange(4000)}"
        family.append(v)
    rows = [(k, " ".join(v)) for k, v in enumerate(family)]
    kept = shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 1 < len(slow_kept(rows)) < 100 and sorted(r.doc_id for r in kept.collect()) == slow_kept(rows)


def test_batches_for_python_are_bounded(spark):
    """By bytes, unless the session has a bound of its own; the results are those of one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(k, f"{k % 7} " * 400) for k in range(60)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "2000")
        small = sorted(tuple(r) for r in shingles.near_duplicates(df).collect())
        assert spark.conf.get(key) == "2000"
        spark.conf.unset(key)
        assert sorted(tuple(r) for r in shingles.near_duplicates(df).collect()) == small == [(k, k % 7) for k in range(60)]
        assert int(spark.conf.get(key)) == BATCH_BYTES
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_prefix_pairs_lose_no_link(spark):
    """Against all pairs: families around the limit, a passage that all share, tiny and equal sets."""
    rng = random.Random(11)
    shared = rng.sample(range(10**9), 40)
    sets = [[1], [1, 2], [1, 2, 3, 4, 5], [1, 2, 3, 4]]
    for _ in range(20):
        base = [*shared, *rng.sample(range(10**9), rng.randrange(5, 80))]
        for _ in range(8):
            keep = rng.choice((0.8, 0.88, 0.9, 0.95))
            sets.append([x if rng.random() < keep else rng.randrange(10**9) for x in base])
    sets = [sorted(set(x)) for x in sets]
    rows = [(k, k, x) for k, x in enumerate(sets)]
    got = {(r.a, r.b) for r in shingles.prefix_pairs(spark.createDataFrame(rows, "node long, root long, shingles array<long>"), 0.8).collect()}
    near = {(i, j) for j in range(len(sets)) for i in range(j) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]}) - 1e-9}
    assert len(near) > 40 and near <= got
    assert all(a < b for a, b in got) and len(got) < len(sets) * (len(sets) - 1) / 8
    one = [(k, 0, x) for k, _, x in rows]
    assert shingles.prefix_pairs(spark.createDataFrame(one, "node long, root long, shingles array<long>"), 0.8).isEmpty()


def test_crowded_keys_equal_all_pairs(spark):
    """More texts of one template under a key than are paired all with all."""
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([*passage, *(f"x{rng.randrange(10**6)}" for _ in range(rng.choice((8, 16, 24))))]) for _ in range(90)]
    texts += [t + " more" for t in texts[:20]]
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(shingles.shingle_set(t).tolist()) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 or bin(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).count("1") <= 2:
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {k: root(k) for k in range(len(texts))}
