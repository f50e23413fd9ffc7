"""Scalar rules of the query language, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that count as no value when text is turned into another type, fixed values.
NULL_TEXTS = ("", "NULL", "NONE", "N/A", "NA", "NAN", "\\N", "NIL", "-")
TRUE_TEXTS = ("true", "1", "yes", "t", "y", "on")
FALSE_TEXTS = ("false", "0", "no", "f", "n", "off")

#: Type names of the language.
TYPES = {
    "int": T.IntegerType(), "int32": T.IntegerType(), "int64": T.LongType(), "bigint": T.LongType(), "float32": T.FloatType(),
    "float": T.DoubleType(), "float64": T.DoubleType(), "double": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "string": T.StringType(), "text": T.StringType(), "timestamp": T.TimestampType(),
    "vector": T.ArrayType(T.FloatType()), "embedding": T.ArrayType(T.FloatType()),
}


def safe_divide(a: Column, b: Column) -> Column:
    """True division; null by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null by zero."""
    divisor = F.when(b != 0, b)
    rest = a % divisor
    return F.when((rest != 0) & ((rest < 0) != (divisor < 0)), rest + divisor).otherwise(rest)


def add(a: Column, b: Column, a_text: bool, b_text: bool) -> Column:
    """Sum of numbers; joined text if either side is text."""
    return F.concat(a.cast("string"), b.cast("string")) if a_text or b_text else a + b


def trim_all(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_length(c: Column) -> Column:
    return F.length(c.cast("string")).cast("long")


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def compare(op: str, a: Column, b: Column, a_kind: T.DataType, b_kind: T.DataType, a_literal: bool = False, b_literal: bool = False) -> Column:
    """A comparison. Text against a number: a literal takes the other side's type, two columns compare as text."""
    a_text, b_text = isinstance(a_kind, T.StringType), isinstance(b_kind, T.StringType)
    if a_text != b_text and not isinstance(a_kind, T.NullType) and not isinstance(b_kind, T.NullType):
        text, other, kind = (a, b, b_kind) if a_text else (b, a, a_kind)
        text_literal, other_literal = (a_literal, b_literal) if a_text else (b_literal, a_literal)
        if text_literal and not other_literal:
            text = text.try_cast(kind)
        else:
            other = other.cast("string")
        a, b = (text, other) if a_text else (other, text)
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def cast_value(c: Column, kind: T.DataType) -> Column:
    """Text as a value of another type: what is no value of it becomes null, and nothing raises."""
    if isinstance(kind, T.StringType):
        return F.when(c != "\\N", c)
    text = F.trim(c)
    known = F.when(~F.upper(text).isin(*NULL_TEXTS), text)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        whole = known.try_cast("double")
        fits = F.when(~F.isnan(whole) & (F.abs(whole) < 9.3e18), F.when(whole >= 0, F.floor(whole)).otherwise(F.ceil(whole)))
        return F.coalesce(known.try_cast(kind), fits.try_cast(kind))
    if isinstance(kind, T.BooleanType):
        return F.when(known.isNull(), F.lit(None).cast("boolean")).otherwise(F.lower(known).isin(*TRUE_TEXTS))
    if isinstance(kind, T.ArrayType):
        from sluice.functions.vectors import to_vector

        return to_vector(known, T.StringType()).cast(kind)
    if isinstance(kind, T.TimestampType):
        micros = known.try_cast("double").try_cast("bigint")
        return F.coalesce(F.timestamp_micros(micros), known.try_cast("timestamp"))
    return known.try_cast(kind)
