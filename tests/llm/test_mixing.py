import random
from fractions import Fraction

import pytest

from sluice.llm import mixing


def slow_round(share):
    """Earliest deadline first, slot by slot."""
    length, done, out = sum(share), [0] * len(share), []
    for t in range(length):
        ready = [(-(-(done[g] + 1) * length // c), g) for g, c in enumerate(share) if done[g] < c and done[g] * length // c <= t]
        due, g = min(ready)
        assert t < due
        out.append((g, done[g]))
        done[g] += 1
    return out


def positions(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("share", [[1], [3, 1], [5, 1, 1, 1, 1, 1], [0, 4, 3], [20] + [4] * 20, [7, 0, 0, 2], [10, 1]])
def test_rounds_are_earliest_deadline_first(spark, share):
    got = sorted((r.slot, r.source, r.j) for r in mixing.slots(spark, [(0, 0, share)]).collect())
    assert got == [(t, g, j) for t, (g, j) in enumerate(slow_round(share))]
    had = [0] * len(share)
    for t, (g, _) in enumerate(slow_round(share), 1):  # never a whole block away from the weight
        had[g] += 1
        assert all(abs(had[k] - Fraction(t * c, sum(share))) < 1 for k, c in enumerate(share))


def docs(spark, sizes):
    rows = [(1000 * k + i, f"s{k}", "t") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, source string, position string").repartition(3)


@pytest.mark.parametrize("sizes", [[300, 100], [500, 10, 10], [7, 7, 7], [0, 50, 3]])
def test_every_row_once_at_its_weight(spark, sizes):
    tickets = {"s0": 3, "s1": 1}
    mixed = mixing.mix(docs(spark, sizes), tickets, rest=1)
    rows = sorted((r.position, r.source) for r in mixed.collect())
    assert [p for p, _ in rows] == list(range(sum(sizes)))
    share = [3, 1, 1]
    counts = [sizes[0], sizes[1], sum(sizes[2:])]
    at, had = 0, [0, 0, 0]
    for q in range(sum(sizes)):  # round by round, against the simulation
        now = [min(a, n - h) for a, n, h in zip(share, counts, had, strict=True)]
        if not any(now):
            break
        want = [g for g, _ in slow_round(now)]
        got = [{"s0": 0, "s1": 1}.get(s, 2) for _, s in rows[at : at + len(want)]]
        assert got == want
        at, had = at + len(want), [h + n for h, n in zip(had, now, strict=True)]
    assert at == sum(sizes)


def test_blocks_keep_rows_together(spark):
    mixed = mixing.mix(docs(spark, [40, 21]), {"s0": 2, "s1": 1}, block_rows=4)
    blocks = {}
    for r in mixed.collect():
        blocks.setdefault(r.position, []).append((r.place_in_block, r.source))
    assert sorted(blocks) == list(range(10 + 6))
    assert all(len({s for _, s in b}) == 1 and sorted(p for p, _ in b) == list(range(len(b))) for b in blocks.values())
    assert sorted(len(b) for b in blocks.values())[0] == 1


def test_order_is_the_seed_s_and_buckets_do_not_matter(spark, monkeypatch):
    df = docs(spark, [200, 90])
    one = positions(mixing.mix(df, {"s0": 1}), "doc_id", "position")
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 3)
    assert positions(mixing.mix(df.repartition(7), {"s0": 1}), "doc_id", "position") == one
    assert positions(mixing.mix(df, {"s0": 1}, seed=3), "doc_id", "position") != one


def test_hard_rows(spark):
    rows = [(1, None, "x"), (1, "a", "y"), (1, "a", "y"), (None, "a", None), (None, None, None), (2, "b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    mixed = mixing.mix(df, {"a": 2}, rest=1)
    assert mixed.columns == ["doc_id", "source", "slot", "position", "place_in_block"]
    assert sorted(r.position for r in mixed.collect()) == list(range(6))
    assert sorted(map(repr, ((r.doc_id, r.source, r.slot) for r in mixed.collect()))) == sorted(map(repr, rows))
    assert mixing.mix(df.limit(0), {"a": 2}).count() == 0
    for bad in ({"a": 0}, {"a": 20_000}):
        with pytest.raises(ValueError):
            mixing.mix(df, bad)


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(docs(spark, [5, 5]), {"s0": 1})._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(k, "src0", 7, 8, 9, "x") for k in range(5)] + [(None, None, 7, 8, 9, "x")], "doc_id long, source string, __g int, __rank int, doc int, slot string")
    got = mixing.mix(df, {"src0": 1})
    assert got.columns == [*df.columns, "position", "place_in_block"]
    assert sorted(map(tuple, got.select(*df.columns).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_rows_of_one_id_have_places_of_their_own(spark):
    df = spark.createDataFrame([(1, "src0", f"t{k}") for k in range(50)], "doc_id long, source string, text string")
    assert sorted(r.position for r in mixing.mix(df, {"src0": 1}).collect()) == list(range(50))
