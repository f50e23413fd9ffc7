"""Token ids of documents, written to plane files in doc_id order and read back."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.cluster import materialize, shared_path
from sluice.llm import bitplanes, bounded_batches

END_ID = 2
#: Words that a worker remembers; beyond it, it forgets all of them and starts again.
MEMO_WORDS = 400_000
_PLAIN = re.compile(r"[\x20-\x7e\n\r\t]*\Z")
_LATIN_WORD = re.compile(r"(?:(?!<\|)[!-~À-ÖØ-öø-ÿ])+\Z")
_LATIN_TEXT = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*\Z")
# what the tokenizer's own pre-tokenizer splits words into, for the letters above, in lower case
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for the 256 bytes in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space, word by word, each word encoded once.

    The tokenizer's normaliser and splitter never look across a blank or line feed, so a text's ids are those of its
    blank-separated words, joined. Words of ASCII and Latin-1 letters go straight to the tokenizer's model, and whole
    texts of such words are split into its pieces at once; all others take its whole way.
    """

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        self.letters = _byte_letters()
        model, letters = self.tokenizer.model, self.letters

        class Pieces(dict):
            def __missing__(self, piece):
                ids = b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(piece.encode().decode("latin-1").translate(letters))])
                if len(self) >= memo:
                    self.clear()
                self[piece] = ids
                return ids

        pieces, whole = Pieces(), self.tokenizer

        class Words(dict):
            def __missing__(self, word):
                if _LATIN_WORD.match(word):
                    ids = b"".join(map(pieces.__getitem__, _PIECE.findall(word.lower())))
                else:
                    ids = np.array(whole.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
                if len(self) >= memo:
                    self.clear()
                self[word] = ids
                return ids

        self.words, self.pieces = Words(), pieces

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if _LATIN_TEXT.match(text) and "<|" not in text:  # no piece holds a blank: all words at once
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, shards: int | None = None, order: list[str] | None = None, **how) -> DataFrame:
    """Write the ids of all rows to plane files under ``path`` in ascending doc_id order, or that of the columns ``order``; returns (shard, path, n_docs, n_ids, start).

    ``tokenizer``: the file of a tokenizer that drops white space. Every document's ids end with
    ``end_id``. Null texts count as empty; null doc_ids come first; rows of one doc_id are in order of
    text. An empty table writes no file. ``start``: the ids in all shards before. Shards are ranges of
    doc_id, as many as there are shuffle partitions unless given; ``how`` goes to the file writer (block, unit, level).
    """
    spark = docs.sparkSession
    path = (path or shared_path(spark, "tokens")).rstrip("/")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        enc = encoder(tokenizer)

        def rows():
            for batch in chain([first], batches):
                yield from zip(batch["doc_id"], batch["text"], strict=True)

        ids = ((None if pd.isna(d) else int(d), np.frombuffer(enc.encode(t or "") + end, dtype="<u4")) for d, t in rows())
        name = f"{path}/shard-{shard:06d}.planes"
        n_docs, n_ids = bitplanes.write_file(name, ids, **how)
        yield pd.DataFrame({"shard": [shard], "path": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    bounded_batches(docs.sparkSession)
    # as text, so that no null turns integers into floating-point numbers on the way
    by = order or [doc_id]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"by{k}") for k, c in enumerate(by)])
    keys = [F.col(f"by{k}").asc_nulls_first() for k in range(len(by))]
    dealt = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys, F.col("text").asc_nulls_first())
    written = materialize(dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(write, "shard int, path string, n_docs long, n_ids long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read plane files back: per document doc_id, start, n_tokens, ids_crc32, and its ids if asked.

    ``files``: what write_tokens returns. Each file is read by one task, chunk by chunk.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                rows, held = [], 0
                for doc_id, ids in bitplanes.read_file(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), *([ids.astype(np.int64)] if with_ids else [])))
                    start, held = start + len(ids), held + len(ids)
                    if len(rows) >= 10_000 or held >= 1 << 22:
                        yield _frame(rows, with_ids)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, with_ids)

    spark = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "start").repartition(n, "path").mapInPandas(read, schema)


def _frame(rows: list[tuple], with_ids: bool) -> pd.DataFrame:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    out = pd.DataFrame(rows, columns=names)
    out["doc_id"] = pd.array(out["doc_id"].tolist(), dtype="Int64") if out["doc_id"].isna().any() else out["doc_id"].astype("int64")
    return out
