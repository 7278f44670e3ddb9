"""List functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import types as T
from ..plans.values import Val, lit, null
from . import register

RANGE_MOST = 1_000_000


def elements(v: Val, what: str):
    """Element type of a list value."""
    if T.kind(v.type) == "list":
        return v.type[1]
    if v.type == T.VEC:
        return T.FLOAT
    raise T.TypeProblem(f"{what} takes a list")


@register("head")
def head(xs: Val) -> Val:
    return null() if xs.type == T.NULL else Val(F.get(xs.col, F.lit(0)), elements(xs, "head()"))


@register("last")
def last(xs: Val) -> Val:
    return null() if xs.type == T.NULL else Val(F.try_element_at(xs.col, F.lit(-1)), elements(xs, "last()"))


@register("tail")
def tail(xs: Val) -> Val:
    return null() if xs.type == T.NULL else Val(F.slice(xs.col, 2, F.greatest(F.size(xs.col), F.lit(1))), T.lst(elements(xs, "tail()")))


@register("size", "length")
def size(x: Val) -> Val:
    k = T.kind(x.type)
    if x.type == T.STR:
        return Val(F.length(x.col).cast("bigint"), T.INT)
    if k == "list" or x.type == T.VEC:
        return Val(F.when(x.col.isNotNull(), F.size(x.col).cast("bigint")), T.INT)
    if k == "map":
        return Val(F.when(x.col.isNotNull(), F.lit(len(x.type[1]))).cast("bigint"), T.INT)
    if k == "path":
        return Val(F.when(x.col.isNotNull(), F.size(x.col["rels"]).cast("bigint")), T.INT)
    if x.type == T.NULL:
        return null(T.INT)
    raise T.TypeProblem(f"size() of {T.NAMES[k]}")


@register("isEmpty")
def is_empty(x: Val) -> Val:
    return null() if x.type == T.NULL else Val(size(x).col == 0, T.BOOL)


@register("range")
def range_(a: Val, b: Val, step: Val | None = None) -> Val:
    s = lit(1) if step is None else step
    if any(v.type not in (T.INT, T.NULL) for v in (a, b, s)):
        raise T.TypeProblem("range() takes integers")
    if any(v.type == T.NULL for v in (a, b, s)):
        return null(T.lst(T.INT))
    if s.literal and s.value == 0:
        raise T.TypeProblem("range()'s step must not be zero")
    n = F.floor((b.col - a.col) / s.col)
    long = F.raise_error(F.lit(f"range() gives at most {RANGE_MOST} numbers")).cast("array<bigint>")
    zero = F.raise_error(F.lit("range()'s step must not be zero")).cast("array<bigint>")
    empty = F.array().cast("array<bigint>")
    away = ((s.col > 0) & (a.col > b.col)) | ((s.col < 0) & (a.col < b.col))
    return Val(F.when(s.col == 0, zero).when(away, empty).when(n >= RANGE_MOST, long).otherwise(F.sequence(a.col, b.col, s.col)), T.lst(T.INT))


@register("list.dedup")
def dedup(xs: Val) -> Val:
    return null() if xs.type == T.NULL else Val(F.array_distinct(xs.col), xs.type)


@register("list.sort")
def sort(xs: Val, ascending: Val | None = None) -> Val:
    if xs.type == T.NULL:
        return null()
    elements(xs, "list.sort()")
    if ascending is None:
        return Val(F.sort_array(xs.col), xs.type)
    return Val(F.when(ascending.col, F.sort_array(xs.col)).otherwise(F.sort_array(xs.col, asc=False)), xs.type)


def _at(i: Column, n: Column, last: int = 0) -> Column:
    """Index from the front; negative ones count from the end."""
    return F.when(i < 0, i + n + last).otherwise(i)


@register("list.remove")
def remove(xs: Val, i: Val, n: Val | None = None) -> Val:
    if xs.type == T.NULL:
        return null()
    size_ = F.size(xs.col).cast("bigint")
    at, k = _at(i.col, size_), F.lit(1) if n is None else n.col
    fine = (at >= 0) & (at < size_) & (k > 0)
    rest = F.filter(xs.col, lambda x, j: (j < at) | (j >= at + k))
    return Val(F.when(fine, rest).otherwise(xs.col), xs.type)


def _splice(xs: Column, at: Column, ys: Column) -> Column:
    n = F.size(xs)
    return F.concat(F.slice(xs, F.lit(1), at.cast("int")), ys, F.slice(xs, at.cast("int") + 1, F.greatest(n - at.cast("int"), F.lit(0))))


@register("list.insert")
def insert(xs: Val, i: Val, v: Val, dups: Val | None = None) -> Val:
    if xs.type == T.NULL:
        return null()
    if v.type == T.NULL:
        return xs
    kind = T.lst(T.unify(elements(xs, "list.insert()"), v.type))
    a, x = T.convert(xs.col, xs.type, kind), T.convert(v.col, v.type, kind[1])
    size_ = F.size(a).cast("bigint")
    at = _at(i.col, size_, 1)
    fine = (at >= 0) & (at <= size_) & x.isNotNull()
    if dups is not None:
        fine = fine & (dups.col | ~F.coalesce(F.array_contains(a, x), F.lit(False)))
    return Val(F.when(fine, _splice(a, at, F.array(x))).otherwise(a), kind)


@register("list.insertListElements")
def insert_list(xs: Val, ys: Val, i: Val, dups: Val | None = None) -> Val:
    if xs.type == T.NULL:
        return null()
    if ys.type == T.NULL:
        return xs
    kind = T.unify(xs.type, ys.type)
    a, b = T.convert(xs.col, xs.type, kind), T.convert(ys.col, ys.type, kind)
    size_ = F.size(a).cast("bigint")
    at = _at(i.col, size_, 1)
    if dups is not None:
        b = F.when(dups.col, b).otherwise(F.filter(F.array_distinct(b), lambda y: ~F.coalesce(F.array_contains(a, y), F.lit(False))))
    return Val(F.when((at >= 0) & (at <= size_) & b.isNotNull(), _splice(a, at, b)).otherwise(a), kind)
