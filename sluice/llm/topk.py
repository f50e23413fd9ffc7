"""Exact top-k inner products by columnar branch and bound.

Candidates stand in vertical layout, a row for each dimension. Inner products grow by one block of
dimensions after another; what the other dimensions can still add is bounded by the product of both
vectors' remaining norms (Cauchy-Schwarz), and candidates that cannot reach the k-th best score any more are
compacted away before the next block. Scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.cluster import materialize

#: Queries of one broadcast: bounds its size, whatever the number of queries.
QUERY_ROWS = 4096
#: Candidates of one step: bounds a task's memory.
CHUNK_ROWS = 8192
#: Below this, sums of products are exact in double precision.
_EXACT = float(1 << 53)
SCALE = 256


def whole(x: float) -> int:
    """floor(256 x) of a finite number, of any size."""
    return int(x) * SCALE if abs(x) >= _EXACT else math.floor(SCALE * x)


def beyond(score: int) -> str:
    """A text that orders scores as their numbers do, for those about as large as a long and beyond; empty for others."""
    if abs(score) < 1 << 62:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):06d}{digits}"
    return f"{999_999 - len(digits):06d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def small(vector, width: int) -> bool:
    """Whether inner products of such vectors of ``width`` components are exact in doubles."""
    return not len(vector) or float(np.abs(vector).max()) * SCALE + 1 <= math.sqrt(_EXACT / max(1, width))


def quantise(vectors: list) -> list[np.ndarray]:
    """floor(256 x) of each component, as doubles with whole values, for small vectors."""
    return [np.floor(SCALE * np.asarray(v, dtype=np.float64)) for v in vectors]


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows padded with zeros: a component that a vector does not have adds nothing."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


class Best:
    """The k best (score, id) per query: greater scores first, then lesser ids. Counts the products of components that were made for them."""

    def __init__(self, n: int, k: int):
        self.k, self.found, self.products = k, [[] for _ in range(n)], 0
        self.floor = np.full(n, -np.inf)

    def add(self, q: int, scores: list[int], ids: list[int]) -> None:
        self.found[q] = sorted([*self.found[q], *zip([-s for s in scores], ids, strict=True)])[: self.k]
        if len(self.found[q]) == self.k:
            self.floor[q] = float(-self.found[q][-1][0])


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best, places: np.ndarray | None = None, block: int = 8) -> None:
    """Add the best of these candidates to ``best``, exactly; ``places``: of the queries in it. All components are whole numbers and small.

    After each block of dimensions a candidate's score lies within the product of both remaining norms of what it has so far. The k-th greatest of the
    lower ends, or the k-th best score found before, is a floor: candidates whose upper end is below it are compacted away.
    """
    if not len(queries) or not len(vectors):
        return
    places = np.arange(len(queries)) if places is None else places
    # the dimensions in which the candidates have most of their mass stand first, so that little remains soon
    order = np.argsort(-(vectors**2).sum(axis=0), kind="stable")
    queries, columns = queries[:, order], np.ascontiguousarray(vectors[:, order].T)
    starts = list(range(0, max(queries.shape[1], 1), block))
    rest_q = np.sqrt(np.stack([(queries[:, s + block :] ** 2).sum(axis=1) for s in starts]))
    rest_v = np.sqrt(np.stack([(columns[s + block :] ** 2).sum(axis=0) for s in starts]))
    k = best.k
    for q in range(len(queries)):
        alive, part, place = np.flatnonzero(ids != query_ids[q]), 0.0, places[q]
        part = np.zeros(len(alive))
        for b, s in enumerate(starts):
            part = part + queries[q, s : s + block] @ (columns[s : s + block] if len(alive) == len(ids) else columns[s : s + block, alive])
            best.products += len(alive) * min(block, queries.shape[1] - s)
            room = rest_q[b, q] * rest_v[b, alive] * (1 + 1e-9) + 1e-6
            floor = best.floor[place]
            if len(alive) >= k:
                floor = max(floor, np.partition(part - room, len(part) - k)[len(part) - k])
            keep = part + room >= floor
            if not keep.all():
                alive, part = alive[keep], part[keep]
            if not len(alive):
                break
        if len(alive):
            if len(alive) > k:  # the k best, and all that tie with the last of them
                keep = part >= np.partition(part, len(part) - k)[len(part) - k]
                alive, part = alive[keep], part[keep]
            best.add(place, [int(round(x)) for x in part], [int(x) for x in ids[alive]])


def search_large(queries: list[list[int]], query_ids: list[int], places: list[int], vectors: list[list[int]], ids: list[int], best: Best) -> None:
    """The same for components so large that doubles lose digits: Python's integers, one pair at a time."""
    for row, own, place in zip(queries, query_ids, places, strict=True):
        others = [i for i in range(len(vectors)) if ids[i] != own]
        best.add(place, [sum(a * b for a, b in zip(row, vectors[i], strict=False)) for i in others], [int(ids[i]) for i in others])


def _block_search(candidates: DataFrame, ids: np.ndarray, vectors: list[np.ndarray], k: int) -> DataFrame:
    """The k best of each partition for these queries: (query, query_id, vec_id, score); at most k rows a query and partition."""
    shared = candidates.sparkSession.sparkContext.broadcast((ids, vectors))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, rows = shared.value
        best, every = Best(len(rows), k), list(range(len(rows)))
        wholes: dict[int, list[int]] = {}

        def exact(places: list[int]) -> list[list[int]]:
            wholes.update((i, [whole(x) for x in rows[i]]) for i in places if i not in wholes)
            return [wholes[i] for i in places]

        for batch in batches:
            for s in range(0, len(batch), CHUNK_ROWS):
                part = batch.iloc[s : s + CHUNK_ROWS]
                found, found_ids = part["embedding"].tolist(), part["vec_id"].to_numpy(dtype=np.int64)
                width = max([len(v) for v in [*found, *rows]], default=0)
                fits, fits_q = np.array([small(v, width) for v in found], dtype=bool), [i for i in every if small(rows[i], width)]
                odd_q, odd = [i for i in every if i not in set(fits_q)] if len(fits_q) < len(rows) else [], np.flatnonzero(~fits)
                take = np.flatnonzero(fits)
                search(_matrix(quantise([rows[i] for i in fits_q]), width), query_ids[fits_q], _matrix(quantise([found[i] for i in take]), width), found_ids[take], best, np.array(fits_q, dtype=int))
                # only pairs with a large vector are multiplied one by one
                if len(odd):
                    large = [[whole(x) for x in found[i]] for i in odd]
                    search_large(exact(fits_q), [int(query_ids[i]) for i in fits_q], fits_q, large, [int(found_ids[i]) for i in odd], best)
                if odd_q:
                    search_large(exact(odd_q), [int(query_ids[i]) for i in odd_q], odd_q, [[whole(x) for x in v] for v in found], [int(i) for i in found_ids], best)
        top = 2**63 - 1
        out = [(q, int(query_ids[q]), i, max(-top - 1, min(top, -s)), beyond(-s)) for q, f in enumerate(best.found) for s, i in f]
        yield pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score", "beyond"])

    return candidates.mapInPandas(of, "query long, query_id long, vec_id long, score long, beyond string")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest integer inner products of each row whose id is divisible by ``every``.

    Components are floor(256 x). Candidates are all rows but those with the query's own id; ties go to the
    lesser id; fewer candidates than ``k``: all of them. Rows with a null id take no part, nor do vectors
    that are null or hold null or non-finite components. Vectors of other lengths count as padded with zeros. Rows
    that repeat a query's id are queries of their own with results of their own; repeated candidates
    are found as often as they stand there. Scores beyond a long are cut to its range, after ranking.

    Columns of any other names are not read. An empty table gives an empty result. Queries go to all candidates in blocks of QUERY_ROWS, one pass over the candidates for each.
    """
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).filter(F.coalesce(good, F.lit(False)))
    queries = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    found = []
    for b in range(blocks):
        taken = queries.filter(home == b).toPandas().sort_values("vec_id", kind="stable")
        part = _block_search(rows, taken["vec_id"].to_numpy(dtype=np.int64), taken["embedding"].tolist(), k).withColumn("block", F.lit(b))
        found.append(materialize(part, "nearest") if blocks > 1 else part)
    all_found = found[0]
    for part in found[1:]:
        all_found = all_found.union(part)
    order = Window.partitionBy("block", "query", "query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return all_found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
