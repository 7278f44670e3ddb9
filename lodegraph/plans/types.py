"""Static types of query values, and the Spark types that carry them.

Scalars are named by strings; ``("list", t)``, ``("map", fields)``, ``("node",
fields)``, ``("rel", fields)`` and ``("path", node, rel)`` nest. Fields are
``(name, type)`` pairs; those of nodes and relationships are properties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

INT, FLOAT, STR, BOOL, NULL = "int", "float", "str", "bool", "null"
DATE, TIME, DATETIME, DURATION, POINT, VEC = "date", "time", "datetime", "duration", "point", "vec"
TEMPORAL = (DATE, TIME, DATETIME, DURATION)
_DDL = {INT: "bigint", FLOAT: "double", STR: "string", BOOL: "boolean", NULL: "void", DATE: "date", TIME: "bigint", DATETIME: "timestamp_ntz", DURATION: "bigint", POINT: "struct<latitude:double,longitude:double>", VEC: "array<float>"}
#: Names that ``typeOf`` reports.
NAMES = {INT: "Integer", FLOAT: "Float", STR: "String", BOOL: "Boolean", NULL: "Null", DATE: "Date", TIME: "Time", DATETIME: "Datetime", DURATION: "Duration", POINT: "Point", VEC: "Vectorf32", "list": "List", "map": "Map", "node": "Node", "rel": "Edge", "path": "Path"}


class TypeProblem(ValueError):
    """A query whose static types don't fit."""


def kind(t) -> str:
    return t if isinstance(t, str) else t[0]


def lst(t):
    return ("list", t)


def numeric(t) -> bool:
    return t in (INT, FLOAT)


def _fields(fields) -> str:
    return ",".join(f"`{k}`:{ddl(t) if t != NULL else 'string'}" for k, t in fields) or "`_`:string"


def ddl(t) -> str:
    k = kind(t)
    if k == "list":
        return f"array<{ddl(t[1])}>"
    if k == "map":
        return f"struct<{_fields(t[1])}>"
    if k == "node":
        return f"struct<`id`:bigint,`labels`:array<string>,`properties`:struct<{_fields(t[1])}>>"
    if k == "rel":
        return f"struct<`id`:bigint,`src`:bigint,`dst`:bigint,`type`:string,`properties`:struct<{_fields(t[1])}>>"
    if k == "path":
        return f"struct<`nodes`:array<{ddl(t[1])}>,`rels`:array<{ddl(t[2])}>>"
    return _DDL[t]


def of_spark(dt: S.DataType):
    if isinstance(dt, (S.LongType, S.IntegerType, S.ShortType, S.ByteType)):
        return INT
    if isinstance(dt, (S.DoubleType, S.FloatType, S.DecimalType)):
        return FLOAT
    if isinstance(dt, S.BooleanType):
        return BOOL
    if isinstance(dt, S.DateType):
        return DATE
    if isinstance(dt, (S.TimestampType, S.TimestampNTZType)):
        return DATETIME
    if isinstance(dt, S.ArrayType):
        return VEC if isinstance(dt.elementType, S.FloatType) else lst(of_spark(dt.elementType))
    if isinstance(dt, S.StructType):
        return ("map", tuple((f.name, of_spark(f.dataType)) for f in dt.fields))
    if isinstance(dt, S.NullType):
        return NULL
    return STR


def unify(a, b):
    """The type that holds values of both."""
    if a == b or b == NULL:
        return a
    if a == NULL:
        return b
    if {a, b} == {INT, FLOAT}:
        return FLOAT
    if kind(a) == kind(b) == "list":
        return lst(unify(a[1], b[1]))
    if {kind(a), kind(b)} == {VEC, "list"}:
        return lst(FLOAT)
    if kind(a) == kind(b) and kind(a) in ("node", "rel", "map"):
        fields = dict(a[1])
        for k, t in b[1]:
            fields[k] = unify(fields.get(k, NULL), t)
        return (kind(a), tuple(fields.items()))
    raise TypeProblem(f"{NAMES[kind(a)]} and {NAMES[kind(b)]} in one column")


def convert(c: Column, a, b) -> Column:
    """A column of type ``a`` as one of type ``b`` (from ``unify``)."""
    if a == b:
        return c
    if a == NULL:
        return c.cast(ddl(b))
    if kind(a) == "list" and kind(b) == "list":
        return F.transform(c, lambda x: convert(x, a[1], b[1]))
    if kind(a) in ("node", "rel", "map") and kind(a) == kind(b):
        have = dict(a[1])
        inner = c if kind(a) == "map" else c["properties"]
        made = F.struct(*((convert(inner[k], have[k], t) if k in have else F.lit(None).cast(ddl(t))).alias(k) for k, t in b[1])) if b[1] else inner  # without fields on either side
        if kind(a) == "map":
            return F.when(c.isNotNull(), made)
        head = ("id", "labels") if kind(a) == "node" else ("id", "src", "dst", "type")
        return F.when(c.isNotNull(), F.struct(*(c[h].alias(h) for h in head), made.alias("properties")))
    return c.cast(ddl(b))
