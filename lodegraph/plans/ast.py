"""Syntax trees of queries."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    pass


@dataclass
class Lit(Expr):
    value: object


@dataclass
class Var(Expr):
    name: str


@dataclass
class Param(Expr):
    name: str


@dataclass
class Prop(Expr):
    base: Expr
    key: str


@dataclass
class Index(Expr):
    base: Expr
    at: Expr


@dataclass
class Slice(Expr):
    base: Expr
    lo: Expr | None
    hi: Expr | None


@dataclass
class Un(Expr):
    op: str
    x: Expr


@dataclass
class Bin(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass
class IsNull(Expr):
    x: Expr
    negated: bool


@dataclass
class HasLabels(Expr):
    x: Expr
    labels: list[str]


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]
    distinct: bool = False
    star: bool = False


@dataclass
class Case(Expr):
    subject: Expr | None
    whens: list[tuple[Expr, Expr]]
    other: Expr | None


@dataclass
class ListLit(Expr):
    items: list[Expr]


@dataclass
class MapLit(Expr):
    items: list[tuple[str, Expr]]


@dataclass
class MapProjection(Expr):
    name: str
    items: list[tuple[str, Expr | None]]  # ("*", None): all properties


@dataclass
class ListComp(Expr):
    var: str
    source: Expr
    where: Expr | None
    out: Expr | None


@dataclass
class Quantifier(Expr):
    kind: str
    var: str
    source: Expr
    where: Expr | None


@dataclass
class Reduce(Expr):
    acc: str
    init: Expr
    var: str
    source: Expr
    body: Expr


@dataclass
class LabelExpr:
    op: str  # name, and, or, not
    args: list = field(default_factory=list)

    def test(self, labels: frozenset[str]) -> bool:
        if self.op == "name":
            return self.args[0] in labels
        if self.op == "not":
            return not self.args[0].test(labels)
        return (all if self.op == "and" else any)(a.test(labels) for a in self.args)


@dataclass
class NodePat:
    var: str | None
    labels: LabelExpr | None
    props: list[tuple[str, Expr]]


@dataclass
class RelPat:
    var: str | None
    types: LabelExpr | None
    props: list[tuple[str, Expr]]
    direction: str  # out, in, both
    low: int | None = None
    high: int | None = None
    variable: bool = False


@dataclass
class Quantified:
    inner: "Pattern"
    low: int
    high: int


@dataclass
class Pattern:
    nodes: list[NodePat]
    rels: list[RelPat | Quantified]
    path: str | None = None
    restrictor: str | None = None
    selector: tuple[str, int] | None = None  # ("any"|"all"|"k", k)


@dataclass
class PatternPredicate(Expr):
    pattern: Pattern


@dataclass
class Exists(Expr):
    patterns: list[Pattern]
    where: Expr | None


@dataclass
class PatternComp(Expr):
    pattern: Pattern
    where: Expr | None
    out: Expr


@dataclass
class ShortestPath(Expr):
    pattern: Pattern


@dataclass
class Item:
    expr: Expr
    name: str


@dataclass
class Projection:
    items: list[Item]
    star: bool = False
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None


@dataclass
class Match:
    patterns: list[Pattern]
    where: Expr | None
    optional: bool


@dataclass
class With:
    projection: Projection


@dataclass
class Return:
    projection: Projection


@dataclass
class Unwind:
    source: Expr
    var: str


@dataclass
class CallProc:
    name: str
    args: list[Expr] | None
    yields: list[tuple[str, str]] | None
    where: Expr | None


@dataclass
class CallSub:
    query: "Query"


@dataclass
class Query:
    parts: list[list]
    unions: list[bool]  # True: UNION ALL
