"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are compared as sequences of words. The CGK walk reads a sequence with a random pace: at step j it
emits the word under its pointer, and moves on or stays by a random bit that j and the word decide. Sequences
of small edit distance fall into step again after an edit, so their walks agree in many places. Each
table samples a few steps of the walk as its key; a window is a candidate for an item if a key is
equal. Candidates are verified by exact edit distance between the item and the best part of the text.

A window is walked only if it can hold an item at all: an item of n words within k edits leaves at least
n - 2 - 3 k of its word triples in the window (each edit breaks three at most), so windows with fewer triples of the
benchmark are passed over without loss.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import bounded_batches

_WORD = re.compile(r"\w+")
#: Items of one pass over the documents: bounds what is broadcast, whatever the benchmark's size.
ITEMS_PER_PASS = 20_000
SIMILARITY = 0.8
RECALL = 0.98
#: Steps that a table's key samples, and the share of steps at which walks of sequences at the limit of edits are taken to agree.
SAMPLED, AGREE = 3, 0.4
#: Independent walks that the tables are spread over, for items of LONG words or fewer: where one walk does not fall into step again, another
#: one does. Longer items fall out of step more often and have more of both (recall at the limit, by length and kind of edit: see the tests).
WALKS, LONG = 12, 40
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def tables_needed(recall: float = RECALL, agree: float = AGREE, sampled: int = SAMPLED) -> int:
    """Tables after which a pair whose walks agree at this share of steps has shared a key with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))


def parts_needed(n: int) -> int:
    """How many times WALKS an item of n words needs, and its tables as well."""
    return max(1, math.ceil((n / LONG) ** 1.5))


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end): the part of ``text`` with the least edit distance to ``item``, the first such to end."""
    m = len(text)
    row, start = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    for i, word in enumerate(item.tolist(), 1):
        change = row[:-1] + (text != word)
        drop = row[1:] + 1
        take_drop = drop < change
        cell = np.concatenate([[i], np.where(take_drop, drop, change)])
        begin = np.concatenate([[0], np.where(take_drop, start[1:], start[:-1])])
        # a step along the text costs one edit: the least of cell[j'] + (j - j') over j' <= j
        shifted = cell - np.arange(m + 1)
        low = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == low, np.arange(m + 1), 0))
        row, start = low + np.arange(m + 1), begin[source]
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


@dataclass
class Group:
    """Items of lengths so close that they share their sampled steps."""

    shortest: int
    longest: int
    tables: list[np.ndarray]
    keys: list[np.ndarray]
    owners: list[np.ndarray]
    walks: int


class Index:
    """The benchmark's words, triples and tables. Items without words are never found."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 20):
        self.similarity, self.rng = similarity, np.random.default_rng(seed)
        listed = [(i, words(t)) for i, t in items]
        listed = [(i, w) for i, w in listed if w]
        self.ids = [i for i, _ in listed]
        self.vocabulary = {w: k for k, w in enumerate(sorted({x for _, w in listed for x in w}), 1)}
        self.items = [np.array([self.vocabulary[x] for x in w], dtype=np.int64) for _, w in listed]
        self.size = len(self.vocabulary) + 2  # 0: any other word; the last one: beyond the end
        steps = 2 * max((len(w) for w in self.items), default=0) + 1
        self.walks = WALKS * parts_needed(max((len(w) for w in self.items), default=0))
        # walk w moves on at step j after a word if the top bit of word_hash * step_hash[w, j] is set
        self.word_hash = self.rng.integers(0, 1 << 63, size=self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.step_hash = self.rng.integers(0, 1 << 63, size=(self.walks, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.triples = np.unique(np.concatenate([self._triple(w) for w in self.items] or [np.zeros(0, np.int64)]))
        self.lengths = sorted({len(w) for w in self.items})
        self.groups = self._groups(tables_needed(recall))

    def _triple(self, w: np.ndarray) -> np.ndarray:
        return (w[:-2] * self.size + w[1:-1]) * self.size + w[2:]

    def walk(self, text: np.ndarray, starts: np.ndarray, steps: int, walk: int = 0) -> np.ndarray:
        """(steps, starts): the words that a walk from each start emits. ``text`` ends with the word beyond the end."""
        at, out = starts.copy(), np.empty((steps, len(starts)), dtype=np.int64)
        for j in range(steps):
            out[j] = text[at]
            at = np.minimum(at + ((self.word_hash[out[j]] * self.step_hash[walk, j]) >> np.uint64(63)).astype(np.int64), len(text) - 1)
        return out

    @staticmethod
    def _key(walked: np.ndarray, steps: np.ndarray) -> np.ndarray:
        key = np.zeros(walked.shape[1], dtype=np.uint64)
        for j in steps:
            key = (key ^ walked[j].astype(np.uint64)) * _MULTIPLY
            key ^= key >> np.uint64(29)
        return key

    def _groups(self, tables: int) -> list[Group]:
        out, by_length = [], sorted(range(len(self.items)), key=lambda k: len(self.items[k]))
        while by_length:
            n = len(self.items[by_length[0]])
            members = [k for k in by_length if len(self.items[k]) <= max(n + 1, 1.3 * n)]
            by_length = by_length[len(members) :]
            parts = parts_needed(len(self.items[members[-1]]))
            # within n steps no walk has left its item, so equal texts share all keys of every other table
            reach = [n if t % 2 == 0 else max(n, int(1.6 * n)) for t in range(tables * parts)]
            sampled = [np.sort(self.rng.choice(r, size=min(SAMPLED, r), replace=False)) for r in reach]
            # the items in one text, each with as many words beyond the end after it as its walk may take
            apart = [np.append(self.items[k], np.full(max(reach) + 1, self.size - 1)) for k in members]
            text, starts, walks = np.concatenate(apart), np.cumsum([0, *map(len, apart[:-1])]), WALKS * parts
            keys, owners = [None] * len(sampled), [None] * len(sampled)
            for t in sorted(range(len(sampled)), key=lambda t: t % walks):  # one walk at a time in memory
                if t < walks:
                    walked = self.walk(text, starts, max(reach), t)
                key = self._key(walked, sampled[t])
                order = np.argsort(key, kind="stable")
                keys[t], owners[t] = key[order], np.array(members)[order]
            out.append(Group(n, len(self.items[members[-1]]), sampled, keys, owners, walks))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' words as numbers, in one array with a word beyond the end after each text; where each text starts."""
        look, parts, starts, at = self.vocabulary.get, [], [], 0
        for t in texts:
            w = words(t)
            parts.append(np.fromiter(map(look, w, repeat(0)), dtype=np.int64, count=len(w)))
            parts.append(np.array([self.size - 1]))
            starts.append(at)
            at += len(w) + 1
        return np.concatenate(parts or [np.zeros(0, np.int64)]), np.array([*starts, at], dtype=np.int64)

    def _admitted(self, text: np.ndarray, bounds: np.ndarray, shortest: int, longest: int) -> np.ndarray:
        """Starts of windows that may hold an item of these lengths."""
        k, need = edits_allowed(longest, self.similarity), min(n - 2 - 3 * edits_allowed(n, self.similarity) for n in range(shortest, longest + 1))
        if need >= 1:
            hits, width = self.hits, longest + k - 2
        else:  # too short for triples to tell: single words
            need, hits, width = max(1, shortest - edits_allowed(shortest, self.similarity)), self.known, longest + k
        if len(hits) < need:
            return np.zeros(0, np.int64)
        first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
        near = last - first < width
        first, last = first[near], last[near]
        if not len(first):
            return first
        # windows from last - width + 1 to first, within the text
        low = np.maximum(last - width + 1, bounds[np.searchsorted(bounds, first, side="right") - 1])
        mark = np.zeros(len(text) + 1, dtype=np.int64)
        np.add.at(mark, low, 1)
        np.add.at(mark, first + 1, -1)
        return np.flatnonzero(np.cumsum(mark)[:-1] > 0)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, edits, start, end) in words: for each text and item, the best part within the allowed edits."""
        text, bounds = self.encode(texts)
        if len(text) < 1 or not self.items:
            return []
        inside = (text > 0) & (text < self.size - 1)
        self.known = np.flatnonzero(inside)
        at = np.flatnonzero(inside[:-2] & inside[1:-1] & inside[2:]) if len(text) > 2 else np.zeros(0, np.int64)
        if len(at) and len(self.triples):
            code = (text[at] * self.size + text[at + 1]) * self.size + text[at + 2]
            place = np.minimum(np.searchsorted(self.triples, code), len(self.triples) - 1)
            held = self.triples[place] == code
            at, code = at[held], code[held]
        else:
            at = code = at[:0]
        self.hits, self.hit_codes = at, code
        candidates: dict[tuple[int, int], list[int]] = {}
        for g in self.groups:
            starts = self._admitted(text, bounds, g.shortest, g.longest)
            if not len(starts):
                continue
            for t in sorted(range(len(g.tables)), key=lambda t: t % g.walks):  # one walk at a time in memory
                steps, keys, owners = g.tables[t], g.keys[t], g.owners[t]
                if t < g.walks:
                    walked = self.walk(text, starts, int(max(s.max() for s in g.tables[t :: g.walks])) + 1, t)
                key = self._key(walked, steps)
                low, high = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
                for i in np.flatnonzero(high > low).tolist():
                    d = int(np.searchsorted(bounds, starts[i], side="right")) - 1
                    for owner in owners[low[i] : high[i]].tolist():
                        candidates.setdefault((d, owner), []).append(int(starts[i]))
        out = []
        for (d, owner), places in candidates.items():
            found = self._verify(text, int(bounds[d]), int(bounds[d + 1]) - 1, self.items[owner], sorted(set(places)))
            if found:
                out.append((d, self.ids[owner], found[0], found[1] - int(bounds[d]), found[2] - int(bounds[d])))
        return out

    def _may_hold(self, text: np.ndarray, a: int, b: int, item: np.ndarray) -> bool:
        """Whether text[a:b] has as many of the item's triples and words as the allowed edits leave at least; where it has not, no part of it is within them."""
        n, k = len(item), edits_allowed(len(item), self.similarity)
        need = n - 2 - 3 * k
        if need >= 1:
            low, high = np.searchsorted(self.hits, (a, b - 2))
            if high <= low or np.isin(self._triple(item), self.hit_codes[low:high]).sum() < need:
                return False
        return bool(np.isin(item, text[a:b]).sum() >= n - k)

    def _verify(self, text: np.ndarray, begin: int, end: int, item: np.ndarray, places: list[int]) -> tuple[int, int, int] | None:
        n, k = len(item), edits_allowed(len(item), self.similarity)
        for p in places:
            if p + n <= end and np.array_equal(text[p : p + n], item):
                return 0, p, p + n
        best, low = None, 0
        while low < len(places):  # places close to one another are verified together
            high = low
            while high + 1 < len(places) and places[high + 1] - places[high] <= n:
                high += 1
            a, b = max(begin, places[low] - n - k), min(end, places[high] + 2 * (n + k))
            low = high + 1
            if not self._may_hold(text, a, b, item):
                continue
            edits, s, e = best_match(item, text[a:b])
            if edits <= k and (best is None or edits < best[0]):
                best = (edits, a + s, a + e)
        return best


def _indexes(benchmark: DataFrame, similarity: float, recall: float) -> Iterator[Index]:
    """An index for each block of items; null ids are left out, as nothing names them."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    blocks = max(1, -(-rows.count() // ITEMS_PER_PASS))
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas().sort_values(["item_id", "text"])
        yield Index(list(zip(part["item_id"].tolist(), part["text"].tolist(), strict=True)), similarity, recall)


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, edits, similarity, start_word, end_word) for each row of ``docs`` and each item that it holds.

    An item counts as held if some part of the text is within floor((1 - similarity) n) word edits of its n
    words. Null or empty texts hold nothing; repeated rows give repeated matches; a null doc_id stays null. An empty
    benchmark gives an empty result. Other columns are not read.
    """
    schema = "doc_id string, item_id long, edits int, similarity double, start_word int, end_word int"
    rows, found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), None
    bounded_batches(docs.sparkSession)
    for index in _indexes(benchmark, similarity, recall):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def of(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ix, lengths = shared.value, {i: len(w) for i, w in zip(shared.value.ids, shared.value.items, strict=True)}
            for batch in batches:
                for s in range(0, len(batch), 500):
                    part = batch.iloc[s : s + 500]
                    ids = part["doc_id"].tolist()
                    got = [(ids[d], i, e, 1 - e / lengths[i], a, b) for d, i, e, a, b in ix.find(part["text"].tolist())]
                    yield pd.DataFrame(got, columns=["doc_id", "item_id", "edits", "similarity", "start_word", "end_word"])

        one = rows.mapInPandas(of, schema)
        found = one if found is None else found.union(one)
    kind = docs.schema["doc_id"].dataType
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns as they are. No shuffle: each row is judged by itself."""
    bounded_batches(docs.sparkSession)
    for index in _indexes(benchmark, similarity, recall):
        docs = docs.filter(~_holds(docs.sparkSession.sparkContext.broadcast(index))("text"))
    return docs


def _holds(shared):
    """A function of texts: whether they hold an item of this index."""

    @F.pandas_udf("boolean")
    def holds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = np.zeros(len(s), dtype=bool)
            for k in range(0, len(s), 500):
                for d, *_ in shared.value.find(s.iloc[k : k + 500].tolist()):
                    out[k + d] = True
            yield pd.Series(out)

    return holds
