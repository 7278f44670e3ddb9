"""Conversions between types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import types as T
from ..plans.values import Val, lit, null
from . import register
from .temporal import text_of


def float_text(c: Column) -> Column:
    """Shortest digits, without exponent, whole numbers without point."""
    plain = c.cast("string")
    digits = F.when((F.abs(c) < 1e38) & (c % 1 == 0), c.try_cast("decimal(38,0)").cast("string"))
    small = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,30)").cast("string"), "0+$", ""), r"\.$", "")
    exact = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    return (
        F.when(F.isnan(c), F.lit("NaN"))
        .when(c == float("inf"), F.lit("inf"))
        .when(c == float("-inf"), F.lit("-inf"))
        .when((c == 0) & (plain == "-0.0"), F.lit("-0"))
        .when(digits.isNotNull(), digits)
        .when(~plain.contains("E"), plain)
        .otherwise(F.coalesce(F.when(F.abs(c) < 1, small), exact, plain))
    )


def display(v: Val) -> Column:
    """Text of a scalar, as ``+`` and toString give it."""
    if v.type == T.FLOAT:
        return float_text(v.col)
    if v.type in T.TEMPORAL:
        return text_of(v)
    if T.kind(v.type) == "list" or v.type == T.VEC:
        kind = T.FLOAT if v.type == T.VEC else v.type[1]
        inner = F.transform(v.col, lambda x: F.coalesce(display(Val(x.cast("double") if v.type == T.VEC else x, kind)), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
    if T.kind(v.type) == "map":
        return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(k + ": "), F.coalesce(display(Val(v.col[k], t)), F.lit("null"))) for k, t in v.type[1])), F.lit("}"))
    if v.type == T.POINT:
        return F.concat(F.lit("point({latitude: "), float_text(v.col["latitude"]), F.lit(", longitude: "), float_text(v.col["longitude"]), F.lit("})"))
    return v.col.cast("string")


@register("toString", "toStringOrNull")
def to_string(v: Val) -> Val:
    if T.kind(v.type) in ("node", "rel", "path"):
        raise T.TypeProblem("toString() takes no entity")
    return null(T.STR) if v.type == T.NULL else Val(display(v), T.STR)


def _integer(v: Val, strict: bool) -> Val:
    if v.type == T.INT:
        return v
    if v.type == T.FLOAT:
        whole = F.when(v.col >= 0, F.floor(v.col)).otherwise(F.ceil(v.col))
        bad = F.isnan(v.col) | (F.abs(v.col) >= 2.0**63)
        other = F.raise_error(F.lit("toInteger(): out of range")).cast("bigint") if strict else F.lit(None).cast("bigint")
        return Val(F.when(bad, other).otherwise(whole.cast("bigint")), T.INT)
    if v.type == T.STR:
        s = F.btrim(v.col, F.lit(" \t\n\r\f\x0b"))
        return Val(F.when(s.rlike(r"\A[+-]?[0-9]+\z"), s.try_cast("bigint")), T.INT)
    if v.type == T.BOOL:
        return Val(v.col.cast("bigint"), T.INT)
    return null(T.INT)


register("toInteger")(lambda v: _integer(v, True))
register("toIntegerOrNull")(lambda v: _integer(v, False))


@register("toFloat", "toFloatOrNull")
def to_float(v: Val) -> Val:
    if T.numeric(v.type):
        return Val(v.col.cast("double"), T.FLOAT)
    if v.type == T.STR:
        s = F.btrim(v.col, F.lit(" \t\n\r\f\x0b"))
        fine = s.rlike(r"(?i)\A[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)\z")
        return Val(F.when(fine, s.try_cast("double")), T.FLOAT)
    return null(T.FLOAT)


@register("toBoolean", "toBooleanOrNull")
def to_boolean(v: Val) -> Val:
    if v.type == T.BOOL:
        return v
    if v.type == T.STR:
        s = F.lower(F.btrim(v.col, F.lit(" \t\n\r\f\x0b")))
        return Val(F.when(s == "true", True).when(s == "false", False), T.BOOL)
    if v.type == T.INT:
        return Val(v.col != 0, T.BOOL)
    return null(T.BOOL)


def _each(name: str, one, kind):
    @register(name)
    def build(xs: Val) -> Val:
        if xs.type == T.NULL:
            return null(T.lst(kind))
        if T.kind(xs.type) != "list":
            raise T.TypeProblem(f"{name}() takes a list")
        return Val(F.transform(xs.col, lambda x: one(Val(x, xs.type[1])).col.cast(T.ddl(kind))), T.lst(kind))


_each("toStringList", to_string, T.STR)
_each("toIntegerList", lambda v: _integer(v, False), T.INT)
_each("toFloatList", to_float, T.FLOAT)
_each("toBooleanList", to_boolean, T.BOOL)


@register("coalesce")
def coalesce(*vs: Val) -> Val:
    kind = T.NULL
    for v in vs:
        kind = T.unify(kind, v.type)
    return null() if kind == T.NULL else Val(F.coalesce(*(T.convert(v.col, v.type, kind) for v in vs)), kind)


@register("exists")
def exists(v: Val) -> Val:
    return Val(v.col.isNotNull(), T.BOOL)


@register("typeOf")
def type_of(v: Val) -> Val:
    return Val(F.when(v.col.isNull(), F.lit("Null")).otherwise(F.lit(T.NAMES[T.kind(v.type)])), T.STR) if v.type != T.NULL else lit("Null")
