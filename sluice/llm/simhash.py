"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the linking radius; two fingerprints
within the radius share a variant, as a path of that many bit flips between them has a middle.
Rows meet on the variant. The fingerprints around one variant are at most ``1 + 64`` for radius
2, so no group is unbounded, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.cluster import materialize
from sluice.llm import bounded_batches
from sluice.llm.components import connected_components

BITS = 64
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, unsigned.

    A-Z are lower-cased; words are runs without ASCII white space; features are all ``width``-word
    shingles with repeats, joined by one space and hashed by XXH64. A bit is set if it is set in over
    half of the hashes. Fewer words than ``width``: the one shingle of all words. No word, or null: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=n)
    starts = np.arange(0, n, 255)
    out = 0
    for k in range(8):
        # byte lane j counts bit 8 j + k; 255 hashes fill no lane beyond its byte
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts)
        for j, count in enumerate(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)):
            if 2 * int(count) > n:
                out |= 1 << (8 * j + k)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fp", width: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with its fingerprint as a signed long in the column ``into``."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint(x, width, seed) for x in s], dtype=np.uint64).view(np.int64))

    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, of(F.col(text)))


def ball_masks(radius: int) -> list[int]:
    """All masks of ``radius`` bits or fewer, as signed longs."""
    unsigned = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in unsigned]


def links(fingerprints: DataFrame, fp: str = "fp", radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints, of ``radius`` or fewer differing bits, that connect all that such links connect.

    ``radius`` is even. Around each variant all fingerprints differ in ``radius`` bits at most, so
    that linking each to the least of them keeps every connection; each link is verified all the same.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius is 0, 2 or 4")
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(radius // 2)])
    variants = fingerprints.select(F.col(fp).alias("a"), F.explode(masks).alias("m")).select("a", F.col("a").bitwiseXOR(F.col("m")).alias("variant"))
    least = F.min("a").over(Window.partitionBy("variant"))
    return variants.withColumn("b", least).filter("a <> b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed long), component_id (the least doc_id that links reach, itself included).

    Rows are kept as they are: a repeated doc_id gives repeated rows. Null and empty texts have
    fingerprint 0 and link like any other. A null doc_id takes part in links, and is never a component's
    least id; a component of none but null ids has a null component_id. An empty table gives an empty
    result. Texts of any length are read whole. Other columns of ``docs``, whatever their names, are not read.
    """
    prints = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(with_fingerprint(prints, "text", "fp", width, seed).select("doc_id", "fp"), "prints")
    # copies fall together here, before anything is compared
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(distinct, "fp", radius))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    component = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(component, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component: that of its least doc_id.

    Of rows with that same doc_id, the one with the least text stays (null first). Rows with a null
    doc_id stay, as nothing names them. Columns and their order are those of ``docs``.
    """
    return keep_least(docs, near_duplicates(docs, doc_id, text, **how), doc_id, text)


def keep_least(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """keep_one for components that are found already: ``found`` has (doc_id, component_id)."""
    first = found.groupBy("component_id").agg(F.min("doc_id").alias("keep")).filter("keep is not null").select("keep")
    # the columns of docs travel in a struct, so that no name of theirs meets one of ours
    moved = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[doc_id].alias("id"), docs[text].alias("body"))
    kept = moved.join(first, F.col("id") == F.col("keep"), "left_semi")
    order = Window.partitionBy("id").orderBy(F.col("body").asc_nulls_first(), F.xxhash64("doc"))
    one = kept.withColumn("row", F.row_number().over(order)).filter("row = 1").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
    return one.unionByName(docs.filter(F.col(doc_id).isNull()))
