"""Chat formatting by prefix-target expansion: an example for every assistant turn.

An example is a conversation up to and with one assistant turn; that reply alone is trainable. The
examples of a conversation are prefixes of one formatted text, so they are kept as spans of it until the
last step, and nothing of quadratic size is shuffled.

The template of a turn is ``### role: text</turn>`` and a line feed. In texts and roles, a backslash goes
before every ``###``, ``</turn>`` and backslash (in roles before a colon, too); unescape takes it away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "### ", ": ", "</turn>"
TARGET_ROLE = "assistant"
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*): ((?:\\(?:\\|###|</turn>)|(?!\\|</turn>)[\s\S])*)</turn>\n")


def escape(text: str) -> str:
    """A text in which no control string stands as it is."""
    return re.sub(r"(\\|###|</turn>)", r"\\\1", text)


def unescape(text: str) -> str:
    """The text again; the reverse of escape."""
    return _ESCAPED.sub(r"\1", text)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text. Raises on anything that the template does not write."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _escape(c: Column, role: bool = False) -> Column:
    return F.regexp_replace(c, r"(\\|###|</turn>" + "|:" * role + ")", r"\\$1")


def expand(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = TARGET_ROLE, keep_tail: bool = True) -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, is_last, loss_start, loss_end, text.

    ``text`` holds the turns up to the example's reply; its code points [loss_start, loss_end) are trainable:
    the escaped reply, without the template. With ``keep_tail``, a conversation that does not end in a
    reply has a last example with all its turns and an empty span, so that no turn is lost; ``is_last``
    marks the example that holds the whole conversation. Turns are in order of turn, then role and text,
    nulls first; repeated rows are turns of their own. Null roles and texts count as empty; all rows with a null
    conv_id are one conversation. No rows: no examples. Other columns are not read. A conversation
    has to fit a row, as its last example does.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    turns = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), _escape(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    turns = turns.withColumn("part", F.concat(F.lit(HEAD), _escape(F.col("role"), True), F.lit(MIDDLE), "body", F.lit(END + "\n")))
    # offsets as running sums: linear, and sorted on disk if need be
    turns = turns.withColumns({"place": F.row_number().over(order), "end": F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    stop = F.col("end") - len(END) - 1
    span = F.when(F.col("role") == target_role, F.struct(F.col("place").alias("n"), (stop - F.length("body")).alias("a"), stop.alias("b"), F.col("end").alias("end")))
    whole = turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "").alias("whole"),
        F.array_sort(F.collect_list(span)).alias("spans"), F.count("*").alias("n"), F.sum(F.length("part")).alias("length"),
    )
    tail = F.struct(F.col("n").cast("int").alias("n"), F.col("length").alias("a"), F.col("length").alias("b"), F.col("length").alias("end"))
    complete = F.coalesce(F.try_element_at("spans", F.lit(-1))["n"] == F.col("n"), F.lit(False))
    spans = whole.withColumn("spans", F.when(complete, F.col("spans")).otherwise(F.concat("spans", F.array(tail)))) if keep_tail else whole
    examples = spans.select("conv_id", "whole", "n", F.posexplode("spans").alias("example", "s"))
    return examples.select("conv_id", "example", F.col("s.n").cast("long").alias("n_turns"), (F.col("s.n") == F.col("n")).alias("is_last"), F.col("s.a").alias("loss_start"), F.col("s.b").alias("loss_end"), F.expr("substring(whole, 1, int(s.end))").alias("text"))


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples hold, parsed from their texts, per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for c, k, last, a, b, text in zip(batch["conv_id"], batch["example"], batch["is_last"], batch["loss_start"], batch["loss_end"], batch["text"], strict=True):
                n, digest = None, None
                if last:
                    turns = parse(text)
                    n, digest = len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((c, k, n, digest, unescape(text[a:b]), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "example", "n_turns", "turns_sha256", "reply", "chars"])
            yield out.astype({"n_turns": "Int64"})

    parsed = examples.select(F.col("conv_id").cast("string").alias("conv_id"), "example", "is_last", "loss_start", "loss_end", "text").mapInPandas(read, "conv_id string, example int, n_turns long, turns_sha256 string, reply string, chars long")
    replies = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "")
    found = parsed.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), replies.alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    kind = examples.schema["conv_id"].dataType
    return found.select(F.col("conv_id").cast(kind).alias("conv_id"), "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")
