"""Values of expressions: a column, its static type, and what it is bound to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import types as T


@dataclass(frozen=True)
class NodeB:
    """A node variable: its id's column, tables it may be in, property columns."""

    id: str
    tables: tuple[int, ...]
    props: dict = field(default_factory=dict)  # key -> column

    def columns(self) -> list[str]:
        return [self.id, *self.props.values()]


@dataclass(frozen=True)
class RelB:
    id: str
    src: str
    dst: str
    tables: tuple[int, ...]
    props: dict = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [self.id, self.src, self.dst, *self.props.values()]


@dataclass(frozen=True)
class ValB:
    column: str
    type: object

    def columns(self) -> list[str]:
        return [self.column]


@dataclass(frozen=True)
class Val:
    col: Column
    type: object
    entity: NodeB | RelB | None = None
    literal: bool = False
    value: object = None


def lit(x) -> Val:
    if x is None:
        return Val(F.lit(None), T.NULL, literal=True)
    if isinstance(x, bool):
        return Val(F.lit(x), T.BOOL, literal=True, value=x)
    if isinstance(x, int):
        if not -(2**63) <= x < 2**63:
            raise T.TypeProblem("integer too large")
        return Val(F.lit(x).cast("bigint"), T.INT, literal=True, value=x)
    if isinstance(x, float):
        return Val(F.lit(x), T.FLOAT, literal=True, value=x)
    if isinstance(x, str):
        return Val(F.lit(x), T.STR, literal=True, value=x)
    if isinstance(x, (list, tuple)):
        return listed([lit(v) for v in x], list(x))
    if isinstance(x, dict):
        return mapped([(k, lit(v)) for k, v in x.items()], x)
    raise T.TypeProblem(f"a parameter of type {type(x).__name__}")


def listed(items: list[Val], value=None) -> Val:
    kind = T.NULL
    for v in items:
        kind = T.unify(kind, v.type)
    if not items:
        return Val(F.array().cast("array<string>") if kind == T.NULL else F.array(), T.lst(T.NULL), literal=True, value=[])
    col = F.array(*(T.convert(v.col, v.type, kind) for v in items))
    return Val(col, T.lst(kind), literal=value is not None, value=value)


def mapped(items: list[tuple[str, Val]], value=None) -> Val:
    fields = dict(items)  # of a key given twice the last stays
    if not fields:
        return Val(F.struct(F.lit(None).cast("string").alias("_")), ("map", ()), literal=True, value={})
    return Val(F.struct(*(v.col.alias(k) for k, v in fields.items())), ("map", tuple((k, v.type) for k, v in fields.items())), literal=value is not None, value=value)


def null(t=T.NULL) -> Val:
    return Val(F.lit(None).cast(T.ddl(t)) if t != T.NULL else F.lit(None), t)
