"""Vector arithmetic over ARRAY<FLOAT> columns, carried out in DOUBLE inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """v / |v|; a zero or non-finite norm is an error. The norm is bound first, so that it is worked out once and not per component."""
    safe = lambda n: F.when((n > 0) & (n < F.lit(float("inf"))), n).otherwise(F.raise_error(F.lit("zero-norm or non-finite vector")).cast("double"))
    return F.transform(F.transform(F.array(norm(v)), safe), lambda n: F.transform(v, lambda x: x / n))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance(similarity: Column) -> Column:
    """Cosine distance, kept within 0 and 2."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - similarity))


def weighted_sum(rows: Column) -> Column:
    """Sum of w * v over an array of (w, v) structs, in the array's order."""
    zero = F.transform(rows[0]["v"], lambda x: F.lit(0.0))
    return F.aggregate(rows, zero, lambda acc, r: F.zip_with(acc, r["v"], lambda s, x: s + r["w"] * x))


def occupancy(v: Column, above: float) -> Column:
    """Share of components whose magnitude is above a bound (grids.pixel_occupancy has the one over pixels)."""
    return F.size(F.filter(v, lambda x: F.abs(x) > above)) / F.size(v)


def token_slice(tokens: Column, special: int) -> Column:
    """Patch tokens after the leading class and register tokens."""
    return F.slice(tokens, F.lit(special + 1), F.greatest(F.size(tokens) - special, F.lit(0)))


def storage_floats(v: Column) -> Column:
    """Vectors as they are stored, in single precision."""
    return v.cast("array<float>")
