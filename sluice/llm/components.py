"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

All rounds are joins and grouped minima on DataFrames. A vertex with very many edges is no
hot group: its minimum is pre-aggregated before the shuffle, and the join that brings the
minimum back is one that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.cluster import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a, b) with a > b. Returns edges of the same form, distinct.

    Large: every vertex links its greater neighbours to the least vertex around it. Small: every
    vertex links its lesser neighbours and itself to the least of them.
    """
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = around.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        lesser = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        joined = lesser.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return joined.filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every vertex with an edge to another one; root is the least vertex it reaches.

    Edges may repeat, come in either direction, and link a vertex to itself; edges with a null end
    are no edges. No edges: an empty result. Each double round is written to the shared folder, so a
    lost executor costs one round at most. Raises if ``max_rounds`` double rounds do not suffice (the
    number needed grows with the logarithm of the component size).
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    now = materialize(now, "edges")
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    before = mark(now)  # edges that are stars already take one round
    for _ in range(max_rounds if before["n"] else 0):
        now = materialize(_star(_star(now, True), False), "edges")
        found = mark(now)
        if found == before:
            break
        before = found
    else:
        if before["n"]:
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    # settled: every edge leads from a vertex to the root of its star
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def connect_groups(grouped: DataFrame, linked: Callable[[DataFrame], DataFrame], hubs: int = 2, edges: DataFrame | None = None, crowded: Callable[[DataFrame], DataFrame] | None = None, group: int = 24) -> DataFrame:
    """(node, root) of the components that pairs of nodes under one key make, where ``linked`` keeps the linked ones of pairs (a, b), a < b.

    ``grouped`` has (node, key), distinct, as a written table. The components are those of all pairs, with fewer tried: in each of ``hubs`` rounds
    the members of a key are tried against one of them; then all pairs that are still in different components. Pairs within a component change nothing.
    ``edges`` (a, b): links that are known already, of these nodes or others. ``crowded`` gives, for (node, root) of what is left under keys of more
    than ``group`` nodes, pairs (a, b), a < b, of different components that hold all linked ones: these nodes are not paired all with all then.
    """
    tried, roots = None, None if edges is None else materialize(connected_components(edges), "roots")
    for k in range(hubs + 1):
        rows = grouped.withColumn("root", F.col("node")) if roots is None else grouped.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        hub = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct(F.xxhash64(F.lit(k), "key", "node").alias("h"), "node", "root")).alias("hub"))
        mixed = hub.filter("low <> high").select("key", F.col("hub.node").alias("b"), F.col("hub.root").alias("b_root"))
        if k < hubs:
            both = rows.withColumnRenamed("node", "a").join(mixed, "key").filter("root <> b_root")
        else:
            left, more = materialize(rows.join(mixed, "key", "left_semi").select("node", "key", "root"), "left"), None
            if crowded is not None:
                large = materialize(left.groupBy("key").count().filter(F.col("count") > group).select("key"), "large")
                many = materialize(left.join(large, "key", "left_semi").select("node", "root").distinct(), "crowded")
                left, more = left.join(large, "key", "left_anti"), None if many.isEmpty() else crowded(many)
            both = left.withColumnRenamed("node", "a").join(left.select("key", F.col("node").alias("b"), F.col("root").alias("b_root")), "key").filter("root < b_root")
        pairs = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = (pairs.union(more) if k == hubs and more is not None else pairs).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if roots is not None and pairs.isEmpty():
            continue
        found = materialize(linked(pairs), "links")
        edges, tried = found if edges is None else edges.union(found), pairs if tried is None else tried.union(pairs)
        if roots is not None and found.isEmpty():
            continue
        roots = materialize(connected_components(edges), "roots")
    return roots
