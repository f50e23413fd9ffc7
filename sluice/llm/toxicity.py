"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insults and threats (with a weight), targets, negations, verbs of reporting, others.
Small transducers rewrite the symbols of a clause one after another; each is a finite automaton,
and so is their composition, which is built state by state as texts need it. A clause's
matches are its insults and threats with what the grammar says of them (aimed at someone, negated,
reported). Clauses are scored by their matches, and a document by the scores of its clauses.

Besides a few English words, the insults are learned: from the documents' labels come
weights for words and for word beginnings, by how much more often toxic documents have them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.cluster import materialize, release
from sluice.llm import bounded_batches
from sluice.llm.labelled import logistic, remainder, sigmoid, training_rows

# Word classes of the grammar (English, German, French, Spanish function words).
INSULTS = {"idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "clowns"}
THREATS = {"kill", "hurt", "destroy", "beat", "punch", "stab", "murder"}
TARGETS = {"you", "your", "he", "she", "they", "him", "her", "them", "du", "dich", "dir", "ihr", "tu", "toi", "vous", "usted", "ustedes"}
NEGATIONS = {"not", "never", "isn", "aren", "don", "nicht", "kein", "keine", "jamais", "nunca"}
REPORTS = {"said", "says", "claimed", "claims", "called", "calls", "wrote", "quoted", "sagte", "dijo"}
SEED_WEIGHT = 4.0

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n|]+")
MIN_STEM = 3
LEAST_WEIGHT = 1.0
#: Log odds from which an entry may be a stem.
STRONG = 1.5
#: Where the coefficients of `evidence` are drawn to: with few labelled rows they stay near it.
PRIOR = (-4.0, 0.8, 0.5, 1.0)
MEMO_WORDS = 300_000


class Transducer:
    """A deterministic transducer: (state, symbol) -> (state, symbol out). What has no arc goes back to the start, unchanged."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str]], default: dict[int, int]):
        self.arcs, self.default = arcs, default

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (self.default.get(state, 0), symbol))


def within(trigger: str, marks: dict[str, str], reach: int) -> Transducer:
    """After ``trigger``, each of the next ``reach`` symbols is rewritten by ``marks``; ``reach`` counts down state by state."""
    arcs: dict[tuple[int, str], tuple[int, str]] = {}
    default = {k: k - 1 for k in range(1, reach + 1)}
    for state in range(reach + 1):
        arcs[state, trigger] = (reach, trigger)
        if state:
            arcs |= {(state, a): (state - 1, b) for a, b in marks.items()}
    return Transducer(arcs, default)


class Composition:
    """Transducers in a row, as one automaton over tuples of their states."""

    def __init__(self, *parts: Transducer):
        self.parts, self.table = parts, {}
        self.start = (0,) * len(parts)

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str]:
        key = (state, symbol)
        if key not in self.table:
            out, after = symbol, []
            for part, s in zip(self.parts, state, strict=True):
                s, out = part.step(s, out)
                after.append(s)
            self.table[key] = (tuple(after), out)
        return self.table[key]

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for symbol in symbols:
            state, seen = self.step(state, symbol)
            out.append(seen)
        return out


#: Symbols: I insult, K threat, T target, N negation, R report, w any other word. What the grammar writes: J aimed insult,
#: L aimed threat, i and k negated, j and l reported. The order of the parts is the order of their rules.
GRAMMAR = (
    within("N", {"I": "i", "K": "k"}, 3),
    within("R", {"I": "j", "K": "l"}, 6),
    within("T", {"I": "J", "K": "L"}, 4),
)
#: From right to left: "you" after the insult or threat aims it as well.
BACKWARD = (within("T", {"I": "J", "K": "L"}, 2),)
FACTOR = {"I": 1.0, "J": 1.25, "K": 0.25, "L": 1.0, "i": 0.25, "k": 0.0, "j": 0.4, "l": 0.4}


@dataclass
class Lexicon:
    """Weights of words ("word$") and of word beginnings; the most specific entry of a word decides."""

    weights: dict[str, float]
    memo: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def weight(self, word: str) -> float:
        """The word's weight as an insult, 0 if it is none."""
        found = self.memo.get(word)
        if found is None:
            found = self.weights.get(word + "$")
            if found is None and len(word) > MIN_STEM:
                found = next((w for k in range(len(word) - 1, MIN_STEM - 1, -1) if (w := self.weights.get(word[:k])) is not None), None)
            if found is None:
                found = SEED_WEIGHT if word in INSULTS else 0.0
            found = found if found >= LEAST_WEIGHT else 0.0
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = found
        return found

    def __getstate__(self):
        return {"weights": self.weights, "memo": {}}


_forward, _backward = Composition(*GRAMMAR), Composition(*BACKWARD)


Match = tuple[str, str, float]


def matches(text: str | None, lexicon: Lexicon) -> list[list[Match]]:
    """For each clause of a whole text that has any: (word, kind, weight) of its insults and threats; kind is a symbol that the grammar writes."""
    low = (text or "").lower()
    if not any(lexicon.weight(w) or w in THREATS for w in set(_WORD.findall(low))):
        return []
    out = []
    for clause in _CLAUSE.split(low):
        words = _WORD.findall(clause)
        weights = [lexicon.weight(w) for w in words]
        if not any(weights) and not THREATS.intersection(words):
            continue
        symbols = ["I" if x else "K" if w in THREATS else "T" if w in TARGETS else "N" if w in NEGATIONS else "R" if w in REPORTS else "w" for w, x in zip(words, weights, strict=True)]
        seen = _backward.run(_forward.run(symbols)[::-1])[::-1]
        out.append([(w, s, x or SEED_WEIGHT) for w, s, x in zip(words, seen, weights, strict=True) if s in FACTOR])
    return out


def clause_score(clause: list[Match]) -> float:
    """The strongest match of a clause and half of its other different words, each after its factor: an aimed insult counts for more, a negated or reported one for less."""
    best: dict[str, float] = {}
    for word, kind, weight in clause:
        best[word] = max(best.get(word, 0.0), FACTOR[kind] * weight)
    top = max(best.values(), default=0.0)
    return top + 0.5 * (sum(best.values()) - top)


def evidence(clauses: list[list[Match]]) -> list[float]:
    """Intercept, the strongest clause, the sum over clauses, number of clauses that stand for something. Clauses with the same matches, such as those of a repeated line, count once."""
    scores = [clause_score(c) for c in {tuple(c): c for c in clauses}.values()]
    return [1.0, max(scores, default=0.0), math.log1p(sum(scores)), math.log1p(sum(x >= 1 for x in scores))]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray

    def score(self, text: str | None) -> float:
        return float(sigmoid(np.array(evidence(matches(text, self.lexicon)) @ self.coefficients)))


def _counts(rows: DataFrame, size: dict[tuple[int, int], int]) -> pd.DataFrame:
    """(entry, fold, toxic, docs): in how many training documents of either label each word and word beginning stands."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text, label, fold in zip(batch["text"], batch["label"], batch["fold"], strict=True):
                words = set(_WORD.findall(text.lower()))
                entries = {w + "$" for w in words}.union(*({w[:k] for k in range(MIN_STEM, min(len(w), 12))} for w in words))
                seen.update((e, int(fold), int(label)) for e in entries)
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["entry", "fold", "toxic", "docs"])

    summed = rows.mapInPandas(of, "entry string, fold int, toxic int, docs long").groupBy("entry").agg(*[F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("docs"))).alias(f"n{f}{t}") for f in (0, 1) for t in (0, 1)])
    summed = materialize(summed.na.fill(0).filter("n00 + n01 + n10 + n11 >= 5"), "entries")
    # only entries that begin as one does which may be strong in a half or in all reach the driver: no other one is in a lexicon
    odds = lambda c, t, fs: F.log((t + 0.5) / (sum(size[f, 1] for f in fs) + 1)) - F.log((c + 0.5) / (sum(size[f, 0] for f in fs) + 1))
    strong = (odds(F.col("n00"), F.col("n01"), [0]) >= STRONG) | (odds(F.col("n10"), F.col("n11"), [1]) >= STRONG) | (odds(F.col("n00") + F.col("n10"), F.col("n01") + F.col("n11"), [0, 1]) >= STRONG)
    begin = F.substring("entry", 1, MIN_STEM)
    near = summed.filter(strong & (F.col("n01") + F.col("n11") >= 5)).select(begin.alias("begin")).distinct()
    return summed.withColumn("begin", begin).join(near, "begin", "left_semi").drop("begin").toPandas()  # bounded by the training rows


def learn(entries, clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int, min_docs: int = 5) -> Lexicon:
    """Weights by smoothed log odds, of entries under a stem that toxic documents have far more often than chance gives.

    Entries of such a stem that tell nothing stay as well, with their weight: the most specific entry decides.
    """
    seen = clean + toxic
    keep = seen >= min_docs
    entries, clean, toxic, seen = np.asarray(entries, dtype=object)[keep], clean[keep], toxic[keep], seen[keep]
    weight = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    share = n_toxic / max(1, n_toxic + n_clean)
    expected = seen * share
    chi = (toxic - expected) ** 2 / np.maximum(1e-9, expected * (1 - share))
    strong = {e for e, w, c, t in zip(entries, weight, chi, toxic, strict=True) if w >= STRONG and c >= 30 and t >= min_docs}
    # a beginning whose evidence comes from one continuation says no more than that one: the stem is where words part
    most: dict[str, float] = {}
    for e, t in zip(entries, toxic, strict=True):
        up = e[:-2] if e.endswith("$") else e[:-1]  # a word's longest beginning is one letter shorter
        most[up] = max(most.get(up, 0.0), float(t))
    strong -= {e for e, t in zip(entries, toxic, strict=True) if most.get(e, 0.0) >= 0.9 * t}
    under = lambda e: e in strong or any(e[:k] in strong for k in range(MIN_STEM, len(e)))
    return Lexicon({e: float(w) if e in strong else min(float(w), 1.0) for e, w in zip(entries, weight, strict=True) if under(e)})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", n: int = 3, held_out: int = 1, max_rows: int = 15_000) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out remainder.

    Two halves of the rows give a lexicon each; either half's matches are found by the other's, so that the
    scores are fitted on matches such as unseen documents have. No row of either label: the grammar with English seeds alone.
    """
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, n, held_out, max_rows).withColumn("fold", remainder("doc_id", 997) % 2)
    total = {(f, t): 0 for f in (0, 1) for t in (0, 1)} | {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    counts = _counts(rows, total)
    c = {f"{f}{t}": counts[f"n{f}{t}"].to_numpy(dtype=float) for f in (0, 1) for t in (0, 1)}
    size = {f"{f}{t}": total.get((f, t), 0) for f in (0, 1) for t in (0, 1)}
    half = [learn(counts["entry"], c[f"{f}0"], c[f"{f}1"], size[f"{f}0"], size[f"{f}1"]) for f in (0, 1)]
    whole = learn(counts["entry"], c["00"] + c["10"], c["01"] + c["11"], size["00"] + size["10"], size["01"] + size["11"])
    halves = docs.sparkSession.sparkContext.broadcast(half)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "found": [evidence(matches(t, halves.value[1 - f])) for t, f in zip(batch["text"], batch["fold"], strict=True)]})

    got = rows.mapInPandas(of, "label int, found array<double>").toPandas()
    halves.destroy()
    del counts, c
    release(docs.sparkSession)
    if got["label"].nunique() < 2:
        return Model(whole, np.array(PRIOR))
    x, y = np.array(got["found"].tolist()), got["label"].to_numpy(dtype=float)
    return Model(whole, logistic(x, y, ridge=1.0, prior=PRIOR))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability that its whole text is toxic; null counts as the empty text, which has a score too."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([shared.value.score(x) for x in s], dtype="float64")

    return docs.withColumn(into, of(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, n: int = 3, held_out: int = 1, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows with a null doc_id are not held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, n=n, held_out=held_out, **how))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", n) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
