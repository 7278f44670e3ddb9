"""Numeric functions: always of floats, with IEEE results instead of errors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..plans import types as T
from ..plans.values import Val, lit, null
from . import register


def as_float(v: Val):
    return v.col.cast("double")


def _one(*names: str):
    def wrap(fn):
        def build(x: Val) -> Val:
            return Val(fn(as_float(x)), T.FLOAT) if T.numeric(x.type) else null(T.FLOAT)

        register(*names)(build)
        return fn

    return wrap


_one("abs")(F.abs)
_one("ceil")(lambda x: F.when(F.abs(x) < 2.0**52, F.ceil(x).cast("double")).otherwise(x))
_one("floor")(lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
_one("sqrt")(F.sqrt)
_one("exp")(F.exp)
_one("round")(lambda x: F.round(x, 0))


def _log(ln):
    return lambda x: F.when(x > 0, ln(x)).when(x == 0, F.lit(-math.inf)).when(x.isNull(), F.lit(None).cast("double")).otherwise(F.lit(math.nan))


_one("log")(_log(F.ln))
_one("log10")(_log(F.log10))
_one("sin")(F.sin)
_one("cos")(F.cos)
_one("tan")(F.tan)
_one("cot")(lambda x: F.when(F.tan(x) == 0, F.lit(math.inf)).otherwise(F.cot(x)))
_one("asin")(F.asin)
_one("acos")(F.acos)
_one("atan")(F.atan)
_one("degrees")(F.degrees)
_one("radians")(F.radians)
_one("haversin")(lambda x: (F.lit(1.0) - F.cos(x)) / 2.0)
#: Zero has the sign of its sign bit: 0.0 gives 1.0.
_one("sign")(lambda x: F.when(F.isnan(x), x).when(x < 0, F.lit(-1.0)).when((x == 0) & (x.cast("string") == "-0.0"), F.lit(-1.0)).when(x.isNotNull(), F.lit(1.0)))


@register("pow")
def power(a: Val, b: Val) -> Val:
    if not (T.numeric(a.type) and T.numeric(b.type)):
        return null(T.FLOAT)
    return Val(F.pow(as_float(a), as_float(b)), T.FLOAT)


@register("atan2")
def atan2(a: Val, b: Val) -> Val:
    if not (T.numeric(a.type) and T.numeric(b.type)):
        return null(T.FLOAT)
    return Val(F.atan2(as_float(a), as_float(b)), T.FLOAT)


@register("e")
def e() -> Val:
    return lit(math.e)


@register("pi")
def pi() -> Val:
    return lit(math.pi)


@register("rand")
def rand() -> Val:
    return Val(F.rand(), T.FLOAT)


@register("randomUUID")
def random_uuid() -> Val:
    return Val(F.expr("uuid()"), T.STR)


@register("timestamp")
def timestamp() -> Val:
    return Val(F.unix_millis(F.current_timestamp()), T.INT)
