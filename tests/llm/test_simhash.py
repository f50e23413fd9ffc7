import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import simhash
from sluice.llm.components import connected_components


def slow_fingerprint(text, width=3):
    """Bit by bit, by the definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """(position -> least id that links reach) by comparing all pairs."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            r = root(i)
            ids[r] = min(ids.get(r, d), d)
    return [ids.get(root(i)) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "Ä ß ÀB c d e", "x " * 700, "a b c d e f", "\x1c a \x85 b c"])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_fingerprints():
    rng = random.Random(5)
    for n in (254, 255, 256, 257, 1000):
        text = " ".join(rng.choice("ab cd ef gh ij Kl".split()) for _ in range(n + 2))
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    texts = [*base, *[t + " end" for t in base], *base[:5], None, "", "  "]
    for t in base:  # copies with one word changed, some of which stay within two bits
        w = t.split()
        w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    rows = [(100 - k if k % 13 else None, t) for k, t in enumerate(texts)]
    found = simhash.near_duplicates(spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fp string, component_id int")).collect()
    prints = [(d, slow_fingerprint(t)) for d, t in rows]
    want = sorted(((d, f - (1 << 64) if f >> 63 else f, c) for (d, f), c in zip(prints, slow_components(prints), strict=True)), key=repr)
    assert sorted((tuple(r) for r in found), key=repr) == want
    assert len({r.component_id for r in found}) < len(texts)


def test_chains_of_flips_link(spark):
    prints = [0, 0b11, 0b1111, 1 << 63, (1 << 63) | (1 << 5), 0b111111111 << 20]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in prints], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(df)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    assert len({roots[s] for s in signed[:5]}) == 1 and signed[5] not in roots


def test_links_refuse_odd_radius(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def test_keep_one(spark):
    rows = [(3, "a b c d", "x"), (1, "A B C D", "y"), (1, "a b c d", "z"), (None, "q r s t", "n"), (7, "q r s t", "k"), (8, None, "e"), (9, "", "e")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([(1, "A B C D", "y"), (7, "q r s t", "k"), (8, None, "e"), (None, "q r s t", "n")], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_components_of_long_paths_cycles_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(300)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7), (None, 3), (5000, 5001)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)} | {5000: 5000, 5001: 5000, 5002: 5000}


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    up = list(range(300))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    touched = {v for a, b in edges if a != b for v in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").select(F.col("a"), F.col("b"))
    assert {r.node: r.root for r in connected_components(df).collect()} == {v: root(v) for v in touched}


def test_keep_one_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c", 7, 8), (2, "a b c", 7, 8), (None, "x", 7, 8)], "doc_id long, text string, __row int, keep int")
    assert sorted(map(tuple, simhash.keep_one(df).collect()), key=repr) == sorted([(1, "a b c", 7, 8), (None, "x", 7, 8)], key=repr)
