"""The vector and scalar functions as temporary SQL functions, for plain Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PAIR = "zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> {})"
_TOTAL = "aggregate(" + _PAIR + ", 0D, (s, v) -> s + v)"
_SQUARES = f"{_TOTAL.format('x * x')} * {_TOTAL.format('y * y')}"
_COSINE = f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN {_SQUARES} > 0 THEN greatest(-1D, least(1D, {_TOTAL.format('x * y')} / sqrt({_SQUARES}))) ELSE 0D END"

#: Body of each function of two vectors.
BODIES = {
    "dot_product": _TOTAL.format("x * y"), "inner_product": _TOTAL.format("x * y"),
    "l2_distance": f"sqrt({_TOTAL.format('(x - y) * (x - y)')})", "euclidean_distance": f"sqrt({_TOTAL.format('(x - y) * (x - y)')})", "vector_distance": f"sqrt({_TOTAL.format('(x - y) * (x - y)')})",
    "manhattan_distance": _TOTAL.format("abs(x - y)"), "l1_distance": _TOTAL.format("abs(x - y)"),
    "cosine_similarity": _COSINE, "cos_sim": _COSINE, "similarity": _COSINE, "cosine_distance": f"1D - {_COSINE}", "cos_dist": f"1D - {_COSINE}",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session."""
    for name, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION l2_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (s, v) -> s + v * v))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION floor_mod(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN a - b * floor(try_divide(a, b))")
