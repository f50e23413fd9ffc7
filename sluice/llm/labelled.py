"""Bounded samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.cluster import materialize


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def training_rows(docs: DataFrame, labels: DataFrame, label: str, n: int, held_out: int, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled documents outside the held-out remainder.

    Which rows: those with the least hashes of their id, so that the choice is the same on every run
    and favours no range of ids. Null labels and ids are left out; of several labels of one id the
    greatest counts. The bound makes the broadcast of the chosen ids, and what the driver fits on, bounded.
    """
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    given = given.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder("doc_id", n) != held_out))
    chosen = given.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(rows.join(F.broadcast(chosen), "doc_id"), "training")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100, prior: tuple[float, ...] = ()) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the ridge draws them to ``prior`` (zeros), column 0, the intercept, only slightly.

    Each step is halved until the loss falls: classes that one number parts, where full steps overshoot, end well too.
    """
    toward = np.array(prior, dtype=float) if prior else np.zeros(x.shape[1])
    w, penalty = toward.copy(), np.full(x.shape[1], float(ridge))
    penalty[0] = 1e-3 * max(ridge, 1e-3)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (penalty * (v - toward) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (y - p) - penalty * (w - toward)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), slope)
        while np.abs(step).max() > 1e-9 and not (after := loss(w + step)) < now:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        w, now = w + step, after
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
