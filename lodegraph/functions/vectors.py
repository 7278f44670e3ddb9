"""Vectors of floats and their distances, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import types as T
from ..plans.values import Val, null
from . import register


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero where a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


#: By metric, the distance that searches sort by.
METRICS = {"cosine": lambda a, b: F.lit(1.0) - cosine(a, b), "euclidean": squared, "l2": squared, "dot": lambda a, b: -dot(a, b)}


@register("vecf32")
def vecf32(xs: Val) -> Val:
    if xs.type == T.NULL:
        return null(T.VEC)
    if xs.type == T.VEC:
        return xs
    if T.kind(xs.type) != "list" or xs.type[1] not in (T.INT, T.FLOAT, T.NULL):
        raise T.TypeProblem("vecf32() takes a list of numbers")
    made = xs.col.cast("array<float>")
    bad = F.exists(made, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return Val(F.when(bad, F.raise_error(F.lit("vecf32(): an element is not finite")).cast("array<float>")).otherwise(made), T.VEC)


def _pair(name: str, fn):
    @register(*name.split())
    def build(a: Val, b: Val) -> Val:
        if a.type != T.VEC or b.type != T.VEC:
            return null(T.FLOAT)
        wrong = F.raise_error(F.lit("vectors differ in length")).cast("double")
        return Val(F.when(F.size(a.col) != F.size(b.col), wrong).when(a.col.isNotNull() & b.col.isNotNull(), fn(a.col, b.col)), T.FLOAT)


_pair("similarity vec.cosineSimilarity", cosine)
_pair("vec.cosineDistance", lambda a, b: F.lit(1.0) - cosine(a, b))
_pair("vec.euclideanDistance", lambda a, b: F.sqrt(squared(a, b)))
