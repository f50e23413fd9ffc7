"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands for candidates, exact comparison of the sets.

Two texts of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8. Texts that share one are compared as sets.
SimHash fingerprints within ``radius`` bits link as well: they reach short texts, which one word changes altogether.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.cluster import materialize, release
from sluice.llm import bounded_batches, simhash
from sluice.llm.components import connect_groups, connected_components

ROWS, BANDS = 6, 24
#: Texts whose sets a task holds at a time.
PART = 500
_MULTIPLY = np.random.default_rng(5).integers(1, 1 << 63, size=(ROWS * BANDS, 1), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 of a text's ``width``-word shingles; words as in simhash.fingerprint. Fewer words: the one shingle of all. None: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    parts = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), dtype=np.uint64, count=max(1, len(words) - width + 1)))


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 1) - (1 << 63)


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band: texts of one key share ROWS minima. None for an empty set."""
    if not len(shingles):
        return []
    low = np.full(len(_MULTIPLY), np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 4096):  # long texts in parts
        h = shingles[None, k : k + 4096] * _MULTIPLY
        low = np.minimum(low, (h ^ (h >> np.uint64(32))).min(axis=1))
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(low.reshape(BANDS, ROWS))]


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different roots that hold all pairs of this Jaccard similarity; ``sets``: (node, root, shingles), one row a node.

    The prefix filter: with shingles in one order, the rarest first, the first one that two such sets share stands among the first
    1 - 2t/(1+t) of the smaller and the first 1 - t of the larger, and what follows it leaves room for the overlap. So a passage
    that many texts share brings no pairs, as long as more than that is their own.
    """
    t, eps = similarity, 1e-6
    each = materialize(sets.select("node", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("s")), "members")
    counted = each.join(each.groupBy("s").agg(F.count("*").alias("n")), "s")
    ranked = counted.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("n", "s")) - 1)
    prefix = materialize(ranked.filter(F.expr(f"n > 1 and at <= size - ceil({t} * size - {eps})")).select("node", "root", "size", "s", "at"), "prefixes")
    a, b = (prefix.select("s", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "root", "size", "at")]) for x in "ab")
    a = a.filter(F.expr(f"a_at <= a_size - ceil({2 * t / (1 + t)} * a_size - {eps})"))
    smaller = "(a_size < b_size or a_size = b_size and a_node < b_node) and a_root <> b_root"
    room = f"a_size >= {t} * b_size - {eps} and least(a_size - a_at, b_size - b_at) >= {t / (1 + t)} * (a_size + b_size) - {eps}"
    pairs = a.join(b, "s").filter(F.expr(f"{smaller} and {room}"))
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(doc_id, component_id) of each row, as simhash.near_duplicates has it: links are shingle sets of this Jaccard similarity, and fingerprints within ``radius`` bits.

    Texts without words have one set, the empty one, and are copies of one another.
    """

    # one function for all that is read off a text: each function of its own would have a Python worker of its own in every task
    @F.pandas_udf("fp long, set long, keys array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            for k in range(0, len(s), PART):
                part = s.iloc[k : k + PART]
                sets = [shingle_set(x, width) for x in part]
                fp = np.array([simhash.fingerprint(x) for x in part], dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"fp": fp, "set": [set_id(x) for x in sets], "keys": [band_keys(x) for x in sets]})

    @F.pandas_udf("set long, shingles array<long>")
    def members(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            for k in range(0, len(s), PART):
                sets = [shingle_set(x, width) for x in s.iloc[k : k + PART]]
                yield pd.DataFrame({"set": [set_id(x) for x in sets], "shingles": [x.view(np.int64) for x in sets]})

    bounded_batches(docs.sparkSession)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = named.select("doc_id", of("text").alias("x")).select("doc_id", "x.fp", "x.set", "x.keys")
    prints = materialize(prints, "prints")
    # copies fall together here, before anything is compared
    keyed = prints.groupBy("set").agg(F.first("keys").alias("keys")).select(F.col("set").alias("node"), F.explode("keys").alias("key"))
    often = keyed.groupBy("key").count().filter("count > 1").select("key")
    grouped = materialize(keyed.join(often, "key", "left_semi").select("node", "key"), "groups")
    # sets are built again for texts that meet others only
    met = prints.join(grouped.select(F.col("node").alias("set")).distinct(), "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    texts = named.join(met.filter("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").union(named.filter("doc_id is null"))
    sets = texts.select(members("text").alias("x")).select("x.set", "x.shingles")
    sets = materialize(sets.groupBy("set").agg(F.first("shingles").alias("shingles")), "sets")
    release(docs.sparkSession)

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("set").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab")
        both = F.size(F.array_intersect("a_set", "b_set"))
        least, most = F.least(F.size("a_set"), F.size("b_set")), F.greatest(F.size("a_set"), F.size("b_set"))
        near = pairs.join(a, "a").join(b, "b").filter(least >= similarity * most - 1e-9)
        return near.filter(both >= similarity * (F.size("a_set") + F.size("b_set") - both) - 1e-9).select("a", "b")

    def crowded(nodes: DataFrame) -> DataFrame:
        return prefix_pairs(nodes.join(sets, F.col("node") == F.col("set")).select("node", "root", "shingles"), similarity)

    similar = connect_groups(grouped, linked, crowded=crowded)
    release(docs.sparkSession)
    prints_of = prints.select("fp", "set").distinct()
    least = prints_of.groupBy("fp").agg(F.min("set").alias("node"))
    ends = [least.select(F.col("fp").alias(x), F.col("node").alias(f"{x}_node")) for x in "ab"]
    close = simhash.links(least, "fp", radius).join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same = prints_of.join(least, "fp").select(F.col("set").alias("a"), F.col("node").alias("b"))
    roots = connected_components(similar.select(F.col("node").alias("a"), F.col("root").alias("b")).union(close).union(same))
    release(docs.sparkSession)
    labelled = prints.select("doc_id", "set").join(roots, F.col("set") == F.col("node"), "left").select("doc_id", "set", F.coalesce("root", "set").alias("root"))
    least_id = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least_id, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component, chosen as simhash.keep_one does."""
    return simhash.keep_least(docs, near_duplicates(docs, doc_id, text, **how), doc_id, text)
