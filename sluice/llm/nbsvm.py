"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, and a linear hinge-loss model on top.

Features are indicators of n-grams over two streams of a text: its words (1 and 2 words) and the shapes of
its words (1 to 3), where a shape keeps upper and lower case, digits and symbols in order and says nothing of
their number, and a word equal to the one before has the shape "=". To these come
indicators of how large a share each shape has, and of the share of different words and lines.
All are 64-bit numbers; the model holds those that enough training rows have.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.cluster import materialize
from sluice.llm import bounded_batches
from sluice.llm.labelled import logistic, remainder, sigmoid, training_rows

MEMO_WORDS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = zlib.crc32(b"=") & 0xFFFF


def shape(word: str) -> str:
    """THE!! -> A!, Word -> Aa, 12.5 -> 0.0"""
    kind = lambda c: "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
    return "".join(k for k, _ in groupby(map(kind, word)))


class _Codes(dict):
    """word -> hash of the word (32 bits) and of its shape (16 bits)."""

    def __missing__(self, word):
        code = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 16 | zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) & 0xFFFF
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = code
        return code


@lru_cache(maxsize=1)
def _codes() -> _Codes:
    return _Codes()


def _tag(tag: int, code: np.ndarray) -> np.ndarray:
    """Numbers of one kind, spread over 60 bits, with the kind on top."""
    return (code * _MIX >> np.uint64(4)) | np.uint64(tag << 60)


def features(text: str | None, words_too: bool = True) -> np.ndarray:
    """The features of a whole text, sorted, each once. A text without words has the one that says so."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return _tag(15, np.zeros(1, dtype=np.uint64))
    code = np.fromiter(map(_codes().__getitem__, words), dtype=np.uint64, count=n)
    word, shapes = code >> np.uint64(16), code & np.uint64(0xFFFF)
    shapes[1:][word[1:] == word[:-1]] = _REPEAT
    used, count = np.unique(shapes, return_counts=True)
    share = np.minimum(7, np.floor(-np.log2(count / n))).astype(np.uint64)
    out = [_tag(1, used), _tag(4, used << np.uint64(3) | share)]
    two = shapes[:-1] << np.uint64(16) | shapes[1:]
    out += [_tag(2, two), _tag(3, two[:-1] << np.uint64(16) | shapes[2:])]
    different = np.unique(word)
    lines = text.split("\n")
    whole = [10 * len(different) // n, 16 + 10 * len(set(lines)) // len(lines), 32 + n.bit_length(), 64 + min(15, len(text) // n), 96 + (n // len(lines)).bit_length()]
    out.append(_tag(5, np.array(whole, dtype=np.uint64)))
    if words_too:
        out += [_tag(6, different), _tag(7, word[:-1] << np.uint64(32) ^ word[1:])]
    return np.unique(np.concatenate(out))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, cost: np.ndarray, epochs: int = 30, tolerance: float = 0.01, seed: int = 7) -> np.ndarray:
    """Weights of an L2-regularised linear model with hinge loss; row i has values[i] at columns rows[i], y[i] is 1 or -1 and costs cost[i]."""
    w, alpha, rng = np.zeros(width), np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([v @ v for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            g = y[i] * (w[rows[i]] @ values[i]) - 1
            pg = min(g, 0) if alpha[i] == 0 else max(g, 0) if alpha[i] == cost[i] else g
            worst = max(worst, abs(pg))
            if pg:
                old = alpha[i]
                alpha[i] = min(max(old - g / norm[i], 0.0), cost[i])
                w[rows[i]] += (alpha[i] - old) * y[i] * values[i]
        if worst < tolerance:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Feature numbers in order, with the weight of each (log-count ratio times hinge-loss weight), and the two numbers that turn a margin into a probability."""

    ids: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        if not len(self.ids):
            return 0.0
        at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
        hit = self.ids[at] == found
        return float(self.weights[at[hit]].sum() / np.sqrt(max(1, hit.sum())))

    def score(self, found: np.ndarray) -> float:
        return float(sigmoid(np.array(self.slope * self.margin(found) + self.offset)))


def _fit(docs: list[np.ndarray], y: np.ndarray, width: int, min_docs: int, cost: float, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """The columns that enough rows have, and their weights; rows are lists of columns below ``width``."""
    by_class = np.zeros((2, width))
    for d, t in zip(docs, y, strict=True):
        by_class[t, d] += 1
    keep = by_class.sum(axis=0) >= min_docs
    place = (np.cumsum(keep) - 1).astype(np.int32)
    rows = [place[d[keep[d]]] for d in docs]
    by_class = by_class[:, keep] + smooth
    ratio = np.log(by_class[1] / by_class[1].sum()) - np.log(by_class[0] / by_class[0].sum())
    values = [(ratio[r] / np.sqrt(max(1, len(r)))).astype(np.float32) for r in rows]
    share = y.mean()
    costs = np.where(y == 1, cost * 0.5 / share, cost * 0.5 / (1 - share))
    w = dual_coordinate_descent(rows, values, np.where(y == 1, 1.0, -1.0), len(ratio), costs)
    return np.flatnonzero(keep), w * ratio


def fit(docs: list[np.ndarray], y: np.ndarray, known: np.ndarray | None = None, min_docs: int = 5, cost: float = 1.0, smooth: float = 1.0, folds: int = 4) -> Model:
    """Fit on lists of features and 0/1 labels. With ``known``, the lists hold places in that sorted array of features instead.

    One class only, or no row: a model that gives that class's share (0.5 without rows).
    """
    y = np.asarray(y, dtype=int)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, float(np.log(share / (1 - share))))
    if known is None:
        known = np.unique(np.concatenate(docs))
        docs = [np.searchsorted(known, d).astype(np.int32) for d in docs]
    margins, fold = np.zeros(len(y)), np.random.default_rng(11).integers(0, folds, len(y))
    for k in range(folds):  # margins of rows that the model has not seen, for the probabilities
        inside = np.flatnonzero(fold != k)
        if len(set(y[inside].tolist())) < 2:
            continue
        part = Model(*_fit([docs[i] for i in inside], y[inside], len(known), min_docs, cost, smooth), 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = part.margin(docs[i])
    offset, slope = logistic(np.stack([np.ones(len(y)), margins], axis=1), y, ridge=1e-3)
    at, weights = _fit(docs, y, len(known), min_docs, cost, smooth)
    return Model(known[at], weights, max(0.0, float(slope)), float(offset))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", n: int = 5, held_out: int = 0, max_rows: int = 12_000, words_too: bool = True, min_docs: int = 5, **how) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out remainder.

    Executors make the features and count in how many rows each stands; what reaches the driver is only those that
    ``min_docs`` rows have, as small numbers.
    """

    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([features(x, words_too).view(np.int64) for x in s])

    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, n, held_out, max_rows)
    rows = materialize(rows.select("doc_id", "label", of("text").alias("found")), "features")
    often = rows.select(F.explode("found").alias("f")).groupBy("f").count().filter(F.col("count") >= min_docs).select("f").toPandas()
    known = np.sort(often["f"].to_numpy(dtype=np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<int>")
    def number(found: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in found:
            out = []
            for x in s:
                x = np.asarray(x, dtype=np.int64).view(np.uint64)
                at = np.minimum(np.searchsorted(shared.value, x), max(0, len(shared.value) - 1))
                out.append(np.sort(at[shared.value[at] == x]).astype(np.int32) if len(shared.value) else np.zeros(0, np.int32))
            yield pd.Series(out)

    got = rows.select("doc_id", "label", number("found").alias("found")).toPandas().sort_values(["doc_id", "label"], kind="stable")
    return fit([np.asarray(x, dtype=np.int32) for x in got["found"]], got["label"].to_numpy(), known, min_docs=min_docs, **how)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score", words_too: bool = True) -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text; null counts as the empty text, which has a score too.

    The model goes to the executors by broadcast; its size is bounded by the training rows, whatever the corpus.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([shared.value.score(features(x, words_too)) for x in s], dtype="float64")

    return docs.withColumn(into, of(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, n: int = 5, held_out: int = 0, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows with a null doc_id are not held out."""
    model = train(docs, labels, n=n, held_out=held_out, **how)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", n) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
