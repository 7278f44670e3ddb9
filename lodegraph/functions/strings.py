"""String functions; arguments of other types give null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import types as T
from ..plans.values import Val, lit, null
from . import register

#: Java's class of Unicode white space.
_WHITE = r"[\s\p{Z}\x85\x1c-\x1f]"
PATTERN_BYTES = 1024


def _text(*names: str):
    def wrap(fn):
        register(*names)(lambda x: Val(fn(x.col), T.STR) if x.type == T.STR else null(T.STR))

    return wrap


_text("toLower", "lower")(F.lower)
_text("toUpper", "upper")(F.upper)
_text("trim")(lambda c: F.regexp_replace(c, f"^{_WHITE}+|{_WHITE}+$(?![\\s\\S])", ""))
_text("ltrim")(lambda c: F.regexp_replace(c, f"^{_WHITE}+", ""))
_text("rtrim")(lambda c: F.regexp_replace(c, f"{_WHITE}+\\z", ""))


@register("reverse")
def reverse(x: Val) -> Val:
    if x.type == T.STR or T.kind(x.type) == "list":
        return Val(F.reverse(x.col), x.type)
    return null(T.STR)


def count(n: Val, what: str) -> Column:
    """A non-negative int, else an error."""
    if n.type == T.NULL:
        return F.lit(None).cast("bigint")
    if n.type != T.INT:
        raise T.TypeProblem(f"{what} must be an integer")
    if n.literal:
        if n.value < 0:
            raise T.TypeProblem(f"{what} must not be negative")
        return n.col
    return F.when(n.col < 0, F.raise_error(F.lit(f"{what} must not be negative")).cast("bigint")).otherwise(n.col)


def _int(c: Column) -> Column:
    return F.least(c, F.lit(2**31 - 2)).cast("int")


def _part(s: Column, start: Column, length: Column) -> Column:
    return F.substring(s, start, length)


@register("left")
def left(s: Val, n: Val) -> Val:
    return Val(_part(s.col, F.lit(1), _int(count(n, "left()'s length"))), T.STR) if s.type == T.STR else null(T.STR)


@register("right")
def right(s: Val, n: Val) -> Val:
    if s.type != T.STR:
        return null(T.STR)
    size = F.length(s.col)
    k = F.least(_int(count(n, "right()'s length")), size)
    return Val(_part(s.col, size - k + 1, k), T.STR)


@register("substring")
def substring(s: Val, start: Val, length: Val | None = None) -> Val:
    if s.type != T.STR:
        return null(T.STR)
    n = F.lit(2**31 - 2) if length is None else _int(count(length, "substring()'s length"))
    return Val(_part(s.col, _int(count(start, "substring()'s start")) + 1, n), T.STR)


def _quoted(v: Val) -> Column:
    """A Java pattern for a literal string."""
    return F.lit(re.sub(r"([^\w])", r"\\\1", v.value)) if v.literal else F.regexp_replace(v.col, r"([^\p{L}\p{N}_])", r"\\$1")


@register("split")
def split(s: Val, sep: Val) -> Val:
    if s.type != T.STR or sep.type != T.STR:
        return null(T.lst(T.STR))
    chars = F.concat(F.array(F.lit("")), F.regexp_extract_all(s.col, F.lit(r"([\s\S])"), F.lit(1)), F.array(F.lit("")))
    return Val(F.when(sep.col == "", chars).otherwise(F.split(s.col, _quoted(sep), -1)), T.lst(T.STR))


@register("replace")
def replace(s: Val, a: Val, b: Val) -> Val:
    if any(v.type != T.STR for v in (s, a, b)):
        return null(T.STR)
    each = F.concat(b.col, F.array_join(F.transform(F.regexp_extract_all(s.col, F.lit(r"([\s\S])"), F.lit(1)), lambda c: F.concat(c, b.col)), ""))
    return Val(F.when(a.col == "", each).otherwise(F.replace(s.col, a.col, b.col)), T.STR)


@register("string.join")
def join(xs: Val, sep: Val | None = None) -> Val:
    if xs.type == T.NULL:
        return null(T.STR)
    if T.kind(xs.type) != "list" or xs.type[1] not in (T.STR, T.NULL):
        raise T.TypeProblem("string.join() takes a list of strings")
    gap = F.lit("") if sep is None else sep.col
    strings = xs.col.cast("array<string>")
    bad = F.exists(strings, lambda x: x.isNull())
    return Val(F.when(bad, F.raise_error(F.lit("string.join(): an element is not a string")).cast("string")).otherwise(F.call_function("array_join", strings, gap)), T.STR)


def pattern(v: Val) -> str:
    if not v.literal or not isinstance(v.value, str):
        raise T.TypeProblem("a regular expression must be a literal or parameter")
    if len(v.value.encode()) > PATTERN_BYTES:
        raise T.TypeProblem(f"a regular expression has at most {PATTERN_BYTES} bytes")
    return v.value


@register("string.matchRegex")
def match_regex(s: Val, p: Val) -> Val:
    kind = T.lst(T.lst(T.STR))
    if s.type != T.STR or p.type != T.STR:
        return Val(F.array().cast(T.ddl(kind)), kind)
    source = pattern(p)
    groups = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", source)).groups
    found = [F.regexp_extract_all(s.col, F.lit(f"({source})"), F.lit(g + 1 if g else 1)) for g in range(groups + 1)]
    zipped = F.transform(found[0], lambda x, i: F.array(x, *(F.coalesce(F.get(f, i), F.lit("")) for f in found[1:])))
    return Val(F.coalesce(zipped, F.array().cast(T.ddl(kind))), kind)


@register("string.replaceRegex")
def replace_regex(s: Val, p: Val, r: Val | None = None) -> Val:
    if s.type != T.STR or p.type != T.STR or (r is not None and r.type != T.STR):
        return null(T.STR)
    new = lit("") if r is None else r
    quoted = F.regexp_replace(new.col, r"([\\$])", r"\\$1")
    return Val(F.regexp_replace(s.col, F.lit(pattern(p)), quoted), T.STR)
