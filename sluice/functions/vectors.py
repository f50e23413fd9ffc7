"""Vector functions as Column builders. Of vectors of different lengths, the components beyond the shorter one do not count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to this length a constant vector becomes plain arithmetic, which whole-stage codegen compiles; beyond it, a fold.
#: Planning and compiling 64 components took 6 to 8 s a query; with the fold the same queries take 1 to 2 s over 10,000 rows.
UNROLL = 16

Vector = Column | Sequence[float]


def to_vector(c: Column, kind: T.DataType) -> Column:
    """A column of vectors as arrays of doubles: arrays, text like "[1, 2]" or "1,2", or little-endian 32-bit floats."""
    if isinstance(kind, T.StringType):
        inner = F.regexp_replace(c, r"^\s*\[|\]\s*$", "")
        return F.when(F.trim(inner) == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double")))
    if isinstance(kind, T.BinaryType):
        # bytes to sign, exponent and fraction: no function reads floats out of binary
        def at(k: Column) -> Column:
            byte = lambda j: F.conv(F.hex(F.substring(c, k * 4 + (j + 1), 1)), 16, 10).cast("long")
            bits = byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
            exponent, fraction = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit(0x7FFFFF))
            size = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-149))).otherwise((fraction + 0x800000) * F.pow(F.lit(2.0), exponent - 150))
            return F.when(F.shiftright(bits, 31) == 1, -size).otherwise(size)

        n = F.floor(F.octet_length(c) / 4).cast("int")
        return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at))
    return c.cast("array<double>")


def _sum(a: Column, b: Vector, term) -> Column:
    """The sum of term(x, y) over the components of both; null if either is null."""
    if isinstance(b, Column):
        n = F.least(F.size(a), F.size(b))
        pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), term)
        total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
        return F.when(a.isNotNull() & b.isNotNull(), total)
    if not b:
        return F.when(a.isNotNull(), F.lit(0.0))
    if len(b) > UNROLL:
        return _sum(a, F.array(*[F.lit(float(y)) for y in b]), term)
    # a component that the row's vector lacks is null and adds nothing
    terms = [F.coalesce(term(F.get(a, F.lit(k)).cast("double"), F.lit(float(y))), F.lit(0.0)) for k, y in enumerate(b)]
    return F.when(a.isNotNull(), _balanced(terms))


def _balanced(terms: list[Column]) -> Column:
    """The sum from left to right, as a tree that is not too deep for the analyser."""
    while len(terms) > 1:
        terms = [reduce(lambda x, y: x + y, terms[k : k + 8]) for k in range(0, len(terms), 8)]
    return terms[0]


def dot_product(a: Column, b: Vector) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def l2_distance(a: Column, b: Vector) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan_distance(a: Column, b: Vector) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def cosine_similarity(a: Column, b: Vector) -> Column:
    """From -1 to 1; 0 if either vector is empty or has norm 0."""
    squares = _sum(a, b, lambda x, y: x * x) * _sum(a, b, lambda x, y: F.when(x.isNotNull(), y * y))
    ratio = dot_product(a, b) / F.sqrt(squares)
    return F.when(squares > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))).when(squares.isNotNull(), F.lit(0.0))


def cosine_distance(a: Column, b: Vector) -> Column:
    return 1.0 - cosine_similarity(a, b)


#: Every name of each function in the query language.
BY_NAME = {
    "cosine_similarity": cosine_similarity, "cos_sim": cosine_similarity, "similarity": cosine_similarity,
    "cosine_distance": cosine_distance, "cos_dist": cosine_distance,
    "l2_distance": l2_distance, "euclidean_distance": l2_distance, "vector_distance": l2_distance,
    "dot_product": dot_product, "inner_product": dot_product,
    "manhattan_distance": manhattan_distance, "l1_distance": manhattan_distance,
}

#: Metrics of a vector search: function, and whether greater is nearer.
METRICS = {
    "cosine": (cosine_similarity, True), "cos": (cosine_similarity, True),
    "dot": (dot_product, True), "dot_product": (dot_product, True),
    "l2": (l2_distance, False), "euclidean": (l2_distance, False),
    "manhattan": (manhattan_distance, False), "l1": (manhattan_distance, False),
}
