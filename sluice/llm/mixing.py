"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source with c of a round's L slots has weight c / L. Its block j is released at floor(j L / c) and due at
ceil((j + 1) L / c); each slot goes to the released block with the earliest deadline. On one resource with weights
that sum to one this meets every deadline, so that no source is ever a whole block ahead of or behind its weight.

A schedule repeats round by round, as long as all sources have blocks left. When one runs out, its
weight goes to the others in their proportions. There are two more kinds of round for each source at most: the
one in which it runs out, and those after it. So the schedule of N rows is a table of a few
rounds, and a row's place in the mixture is arithmetic on its place in its source. No row is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bounds of the round table, by parameter: tickets of a round, and sources with tickets of their own.
MAX_TICKETS = 10_000
#: Rows of a source that one task numbers.
ROWS_PER_BUCKET = 50_000


def rounds(counts: list[int], tickets: list[int]) -> list[tuple[int, int, list[int]]]:
    """(first round, blocks before it, blocks of each source in it): the kinds of round, in order, for sources of ``counts`` blocks."""
    marks = {0}
    for n, a in zip(counts, tickets, strict=True):
        marks |= {n // a, n // a + 1}
    out = []
    for q in sorted(marks):
        now = [min(a, max(0, n - q * a)) for n, a in zip(counts, tickets, strict=True)]
        if any(now):
            out.append((q, sum(min(n, q * a) for n, a in zip(counts, tickets, strict=True)), now))
    return out


# Earliest deadline first over one round, as a fold over its slots: the state is how many blocks each source has had, and who got each slot.
_FOLD = """
aggregate(
  sequence(0, length - 1),
  named_struct('done', transform(share, x -> 0L), 'picks', cast(array() as array<struct<source: int, j: bigint>>)),
  (state, t) -> transform(
    array(array_min(transform(
      filter(sequence(0, size(share) - 1), g -> state.done[g] < share[g] and (state.done[g] * length) div share[g] <= t),
      g -> named_struct('due', ((state.done[g] + 1) * length + share[g] - 1) div share[g], 'source', g))).source),
    p -> named_struct(
      'done', transform(state.done, (x, g) -> if(g = p, x + 1, x)),
      'picks', concat(state.picks, array(named_struct('source', p, 'j', state.done[p])))))[0]
).picks
"""


def slots(spark, kinds: list[tuple[int, int, list[int]]]) -> DataFrame:
    """(kind, first, before, length, source, j, slot): the slot of block j of each source in each kind of round."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(q).cast("long").alias("first"), F.lit(b).cast("long").alias("before"), F.lit(sum(c)).cast("long").alias("length"), F.array(*[F.lit(x).cast("long") for x in c]).alias("share")) for k, (q, b, c) in enumerate(kinds)])
    table = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    return table.select("kind", "first", "before", "length", F.posexplode(F.expr(_FOLD)).alias("slot", "pick")).select("kind", "first", "before", "length", F.col("pick.source").alias("source"), F.col("pick.j").alias("j"), "slot")


def mix(docs: DataFrame, tickets: dict[str, int], rest: int = 1, source: str = "source", doc_id: str = "doc_id", block_rows: int = 1, seed: int = 17, into: str = "position", in_block: str = "place_in_block") -> DataFrame:
    """All rows of ``docs`` with the position of their block in the mixture and their place in the block.

    ``tickets``: each source's share of a round, as whole numbers; ``rest``: that of all other sources and nulls together. Rows of a source
    stand in an order that ``seed`` shuffles; ``block_rows`` of them make a block (the last one of a source may be short). Rows that are equal in
    all columns keep an arbitrary order among themselves. Texts of any length are moved, not looked at. An empty table gives an empty result. The two
    new columns replace columns of these names; all others stay, whatever their names.

    A source may hold any share of the rows: it is numbered in buckets of its shuffled order, whose sizes are summed first.
    """
    if block_rows < 1 or rest < 1 or any(a < 1 for a in tickets.values()):
        raise ValueError("tickets and block_rows are whole numbers from 1")
    if sum(tickets.values()) + rest > MAX_TICKETS:
        raise ValueError(f"a round has {MAX_TICKETS} tickets at most")
    names, given, spark = sorted(tickets), [], docs.sparkSession
    given = [tickets[n] for n in names] + [rest]
    listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    place = F.array_position(listed, F.coalesce(F.col(source).cast("string"), F.lit("")))
    group = F.when(F.col(source).isNull() | (place == 0), F.lit(len(names))).otherwise((place - 1).cast("int"))
    # the columns of docs travel in a struct, so that no name of theirs meets one of ours; rows that share an id stand apart by what else is in them
    whole = F.struct(*[docs[c] for c in docs.columns])
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), whole)

    sized = docs.groupBy(group.alias("g")).count().collect()  # a row for each entry of tickets at most
    rows = {r["g"]: r["count"] for r in sized}
    counts = [-(-rows.get(g, 0) // block_rows) for g in range(len(given))]
    bits = max(4, (max(rows.values(), default=0) // ROWS_PER_BUCKET).bit_length())
    bucket = F.shiftrightunsigned(order, 64 - bits)
    kinds = rounds(counts, given)
    if not kinds:
        return docs.withColumns({into: F.lit(0).cast("long"), in_block: F.lit(0).cast("long")}).limit(0)

    numbered = docs.select(whole.alias("doc"), group.alias("__g"), order.alias("__h"), F.shiftrightunsigned(order, 64 - bits).alias("__b"))
    sizes = docs.groupBy(group.alias("__g"), bucket.alias("__b")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__g", "__b", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__h")) - 1
    numbered = numbered.withColumn("__rank", rank).join(sizes, ["__g", "__b"]).withColumn("__rank", F.col("__rank") + F.col("__before"))

    share = F.element_at(F.array(*[F.lit(a).cast("long") for a in given]), F.col("__g") + 1)
    block = F.floor(F.col("__rank") / block_rows).cast("long")
    kind = F.size(F.filter(F.array(*[F.lit(q).cast("long") for q, _, _ in kinds]), lambda q: q <= F.col("__round"))) - 1
    numbered = numbered.withColumn("__block", block).withColumn("__round", F.floor(F.col("__block") / share).cast("long"))
    numbered = numbered.withColumns({"__kind": kind, "__j": F.col("__block") - F.col("__round") * share})
    table = slots(spark, kinds).select(F.col("kind").alias("__kind"), F.col("source").alias("__g"), F.col("j").alias("__j"), "first", "before", "length", "slot")
    table = table.select("__kind", "__g", "__j", F.struct("first", "before", "length", "slot").alias("__s"))
    placed = numbered.join(table, ["__kind", "__g", "__j"])
    s = F.col("__s")
    placed = placed.withColumns({into: s["before"] + (F.col("__round") - s["first"]) * s["length"] + s["slot"], in_block: F.col("__rank") - F.col("__block") * block_rows})
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in (into, in_block)]
    return placed.select(*kept, into, in_block)
