"""Expression trees to Spark columns, by static types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import functions as library
from ..functions import convert, lists, strings, temporal
from ..model import PropertyGraph
from . import ast as A
from . import types as T
from .values import NodeB, RelB, Val, lit, listed, mapped, null

library.load()

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}


def no_properties() -> Column:
    """The properties of an entity that has none to show."""
    return F.struct(F.lit(None).cast("string").alias("_"))


def has_aggregate(e) -> bool:
    return any(isinstance(x, A.Call) and x.name.lower() in AGGREGATES for x in walk(e))


def walk(e):
    """All nodes of a tree (dataclasses, lists and tuples)."""
    if isinstance(e, (list, tuple)):
        for x in e:
            yield from walk(x)
    elif hasattr(e, "__dataclass_fields__"):
        yield e
        for f in e.__dataclass_fields__:
            yield from walk(getattr(e, f))


def rebuilt(e, change: Callable):
    """A tree with ``change(node)`` in place of nodes for which it isn't None."""
    if isinstance(e, list):
        return [rebuilt(x, change) for x in e]
    if isinstance(e, tuple):
        return tuple(rebuilt(x, change) for x in e)
    if hasattr(e, "__dataclass_fields__"):
        new = change(e)
        if new is not None:
            return new
        return type(e)(**{f: rebuilt(getattr(e, f), change) for f in e.__dataclass_fields__})
    return e


def conjuncts(e: A.Expr | None) -> list[A.Expr]:
    if e is None:
        return []
    if isinstance(e, A.Bin) and e.op == "AND":
        return conjuncts(e.a) + conjuncts(e.b)
    return [e]


def equal(a: Val, b: Val) -> Column:
    """Loose equality: null with null, false between types."""
    if T.NULL in (a.type, b.type):
        return F.lit(None).cast("boolean")
    if T.numeric(a.type) and T.numeric(b.type):
        if a.type == b.type == T.INT:
            return a.col == b.col
        x, y = a.col.cast("double"), b.col.cast("double")
        return F.when(F.isnan(x) | F.isnan(y), F.lit(False)).otherwise(x == y)
    ka, kb = T.kind(a.type), T.kind(b.type)
    if ka == kb and ka in ("node", "rel"):
        return identity(a) == identity(b)
    no = F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if ka != kb and {ka, kb} != {"list", T.VEC}:
        return no
    try:
        kind = T.unify(a.type, b.type)
    except T.TypeProblem:
        return no
    x, y = T.convert(a.col, a.type, kind), T.convert(b.col, b.type, kind)
    if T.kind(kind) == "list":
        return F.when(F.exists(x, lambda v: v.isNull()), F.lit(False)).otherwise(x == y)
    return x == y


def identity(v: Val) -> Column:
    """What an entity is compared and grouped by."""
    return v.col if v.entity is not None else v.col["id"]


def less(op: str, a: Val, b: Val) -> Column:
    fits = T.numeric(a.type) and T.numeric(b.type) or a.type == b.type and a.type in (T.STR, T.BOOL, *T.TEMPORAL)
    if not fits:
        return F.lit(None).cast("boolean")
    x, y = (a.col, b.col) if a.type == b.type else (a.col.cast("double"), b.col.cast("double"))
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if T.FLOAT in (a.type, b.type):
        return F.when(F.isnan(x.cast("double")) | F.isnan(y.cast("double")), F.lit(False)).otherwise(out)
    return out


class Exprs:
    """Compiles expressions in a scope of bindings and lambda variables."""

    def __init__(self, graph: PropertyGraph, params: dict, scope: dict, local: dict[str, Val] | None = None):
        self.graph, self.params, self.scope, self.local = graph, params, scope, local or {}

    def inside(self, **local: Val) -> "Exprs":
        return Exprs(self.graph, self.params, self.scope, self.local | local)

    def __call__(self, e: A.Expr) -> Val:
        method = getattr(self, "_" + type(e).__name__.lower(), None)
        if method is None:
            raise T.TypeProblem(f"{type(e).__name__} can't stand here")
        return method(e)

    def boolean(self, e: A.Expr) -> Column:
        """As a condition: what isn't boolean counts as null."""
        v = self(e)
        return v.col if v.type == T.BOOL else F.lit(None).cast("boolean")

    # entities
    def bound(self, b) -> Val:
        if isinstance(b, NodeB):
            return Val(F.col(b.id), ("node", self._fields("node", b)), entity=b)
        if isinstance(b, RelB):
            return Val(F.col(b.id), ("rel", self._fields("edge", b)), entity=b)
        return Val(F.col(b.column), b.type)

    def _fields(self, entity: str, b) -> tuple:
        types = self.graph.property_types(entity, b.tables)
        return tuple((k, types[k]) for k in sorted(b.props))

    def whole(self, v: Val) -> Column:
        """A value as one column: of an entity, a struct."""
        b = v.entity
        if b is None:
            return v.col
        props = F.struct(*(F.col(b.props[k]).alias(k) for k, _ in v.type[1])) if v.type[1] else no_properties()
        if isinstance(b, NodeB):
            made = F.struct(F.col(b.id).alias("id"), self.graph.labels_of(F.col(b.id), b.tables).alias("labels"), props.alias("properties"))
        else:
            made = F.struct(F.col(b.id).alias("id"), F.col(b.src).alias("src"), F.col(b.dst).alias("dst"), self.graph.type_of(F.col(b.id), b.tables).alias("type"), props.alias("properties"))
        return F.when(F.col(b.id).isNotNull(), made)

    def value(self, e: A.Expr) -> Val:
        v = self(e)
        return v if v.entity is None else Val(self.whole(v), v.type)

    # leaves
    def _lit(self, e: A.Lit) -> Val:
        return lit(e.value)

    def _param(self, e: A.Param) -> Val:
        if e.name not in self.params:
            raise T.TypeProblem(f"parameter ${e.name} is missing")
        return lit(self.params[e.name])

    def _var(self, e: A.Var) -> Val:
        if e.name in self.local:
            return self.local[e.name]
        if e.name not in self.scope:
            raise T.TypeProblem(f"variable {e.name} is not defined")
        return self.bound(self.scope[e.name])

    def _prop(self, e: A.Prop) -> Val:
        return self.property(self(e.base), e.key)

    def property(self, v: Val, key: str) -> Val:
        k = T.kind(v.type)
        if v.entity is not None:
            types = self.graph.property_types("node" if k == "node" else "edge", v.entity.tables)
            if key not in v.entity.props:
                return null(types.get(key, T.NULL))
            return Val(F.col(v.entity.props[key]), types[key])
        if k in ("node", "rel"):
            kinds = dict(v.type[1])
            return Val(v.col["properties"][key], kinds[key]) if key in kinds else null()
        if k == "map":
            kinds = dict(v.type[1])
            return Val(v.col[key], kinds[key]) if key in kinds else null()
        if v.type == T.POINT:
            return Val(v.col[key], T.FLOAT) if key in ("latitude", "longitude") else null()
        if v.type in T.TEMPORAL:
            return temporal.component(v, key)
        if v.type == T.NULL:
            return null()
        raise T.TypeProblem(f"{T.NAMES[k]} has no properties")

    # operators
    def _un(self, e: A.Un) -> Val:
        if e.op == "NOT":
            return Val(~self.boolean(e.x), T.BOOL)
        v = self(e.x)
        if v.type == T.NULL:
            return v
        if not T.numeric(v.type):
            raise T.TypeProblem("- of what isn't a number")
        return Val(-v.col, v.type)

    def _isnull(self, e: A.IsNull) -> Val:
        c = self(e.x).col
        return Val(c.isNotNull() if e.negated else c.isNull(), T.BOOL)

    def _haslabels(self, e: A.HasLabels) -> Val:
        v = self(e.x)
        if v.type == T.NULL:
            return null(T.BOOL)
        labels = self._labels(v)
        out = F.lit(True)
        for name in e.labels:
            out = out & F.array_contains(labels, name)
        return Val(F.when(labels.isNotNull(), out), T.BOOL)

    def _labels(self, v: Val) -> Column:
        if T.kind(v.type) == "rel":
            return F.array(self._type(v))
        if T.kind(v.type) != "node":
            raise T.TypeProblem("labels of what isn't a node")
        return self.graph.labels_of(v.col, v.entity.tables) if v.entity is not None else v.col["labels"]

    def _type(self, v: Val) -> Column:
        if T.kind(v.type) != "rel":
            raise T.TypeProblem("type() takes a relationship")
        return self.graph.type_of(v.col, v.entity.tables) if v.entity is not None else v.col["type"]

    def _bin(self, e: A.Bin) -> Val:
        op = e.op
        if op in ("AND", "OR", "XOR"):
            a, b = self.boolean(e.a), self.boolean(e.b)
            return Val(a & b if op == "AND" else a | b if op == "OR" else a != b, T.BOOL)
        a, b = self(e.a), self(e.b)
        if op == "=":
            return Val(equal(a, b), T.BOOL)
        if op == "<>":
            return Val(~equal(a, b), T.BOOL)
        if op in ("<", "<=", ">", ">="):
            return Val(less(op, a, b), T.BOOL)
        if op in ("STARTS", "ENDS", "CONTAINS"):
            if a.type != T.STR or b.type != T.STR:
                return null(T.BOOL)
            fn = {"STARTS": F.startswith, "ENDS": F.endswith, "CONTAINS": F.contains}[op]
            return Val(fn(a.col, b.col), T.BOOL)
        if op == "=~":
            if a.type != T.STR or b.type != T.STR:
                return null(T.BOOL)
            return Val(F.regexp_like(a.col, F.lit(f"\\A(?:{strings.pattern(b)})\\z")), T.BOOL)
        if op == "IN":
            return self.contained(a, b)
        return self.arithmetic(op, a, b)

    def contained(self, x: Val, xs: Val) -> Val:
        if T.kind(xs.type) != "list" and xs.type != T.VEC:
            return null(T.BOOL)
        kind = xs.type[1] if xs.type != T.VEC else T.FLOAT
        empty = F.size(xs.col) == 0
        if x.type == T.NULL:
            return Val(F.when(empty, F.lit(False)), T.BOOL)
        if xs.literal and xs.value is not None and kind == x.type and kind in (T.INT, T.STR) and None not in xs.value:
            return Val(x.col.isin(list(xs.value)), T.BOOL)
        found = F.exists(xs.col, lambda v: equal(x, Val(v, kind))) if kind != T.NULL else F.exists(xs.col, lambda v: F.lit(None).cast("boolean"))
        return Val(F.when(empty, F.lit(False)).otherwise(found), T.BOOL)

    def arithmetic(self, op: str, a: Val, b: Val) -> Val:
        la, lb = (T.kind(v.type) == "list" for v in (a, b))
        if op == "+" and (la or lb):
            return self._append(a, b, la, lb)
        if T.NULL in (a.type, b.type):
            return null()
        if op == "+" and T.STR in (a.type, b.type):
            return Val(F.concat(convert.display(a), convert.display(b)), T.STR)
        if a.type in T.TEMPORAL and b.type == T.DURATION and op in ("+", "-"):
            return temporal.shifted(a, b, 1 if op == "+" else -1)
        if a.type == T.DURATION and b.type in T.TEMPORAL and op == "+":
            return temporal.shifted(b, a, 1)
        if not (T.numeric(a.type) and T.numeric(b.type)):
            raise T.TypeProblem(f"{T.NAMES[T.kind(a.type)]} {op} {T.NAMES[T.kind(b.type)]}")
        ints = a.type == b.type == T.INT
        if op == "^":
            return Val(F.pow(a.col.cast("double"), b.col.cast("double")), T.FLOAT)
        x, y = (a.col, b.col) if ints else (a.col.cast("double"), b.col.cast("double"))
        kind = T.INT if ints else T.FLOAT
        if op == "+":
            return Val(x + y, kind)
        if op == "-":
            return Val(x - y, kind)
        if op == "*":
            return Val(x * y, kind)
        if ints:
            if op == "/":
                return Val(F.call_function("div", x, y), T.INT)
            return Val(x % y, T.INT)
        nan = F.isnan(x) | F.isnan(y)
        if op == "/":
            below = (y.cast("string") == "-0.0") != (x < 0)
            zero = F.when((x == 0) | nan, F.lit(float("nan"))).when(below, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
            zero = F.when(x.isNotNull(), zero)
            return Val(F.when(y == 0, zero).otherwise(F.try_divide(x, y)), T.FLOAT)
        return Val(F.when(y == 0, F.when(x.isNotNull(), F.lit(float("nan")))).otherwise(F.try_mod(x, y)), T.FLOAT)

    def _append(self, a: Val, b: Val, la: bool, lb: bool) -> Val:
        if T.NULL in (a.type, b.type):
            return null()
        ea, eb = a.type[1] if la else a.type, b.type[1] if lb else b.type
        kind = T.unify(ea, eb)
        part = lambda v, is_list, t: T.convert(v.col, v.type, T.lst(kind)) if is_list else F.array(T.convert(self.whole(v), t, kind))
        return Val(F.concat(part(a, la, ea), part(b, lb, eb)), T.lst(kind))

    # containers
    def _index(self, e: A.Index) -> Val:
        v, i = self(e.base), self(e.at)
        k = T.kind(v.type)
        if k == "list" or v.type == T.VEC:
            if i.type not in (T.INT, T.NULL):
                raise T.TypeProblem("a list is indexed by integers")
            at = F.when(i.col < 0, F.size(v.col) + i.col).otherwise(i.col) if i.type == T.INT else F.lit(None)
            got = F.get(v.col, F.when((at >= 0) & (at < F.size(v.col)), at).cast("int"))
            return Val(got.cast("double") if v.type == T.VEC else got, T.FLOAT if v.type == T.VEC else v.type[1])
        if k in ("map", "node", "rel"):
            if not isinstance(i.value, str):
                raise T.TypeProblem("a map is indexed by a literal key")
            return self.property(v, i.value)
        if v.type == T.NULL:
            return null()
        raise T.TypeProblem(f"{T.NAMES[k]} can't be indexed")

    def _slice(self, e: A.Slice) -> Val:
        v = self(e.base)
        if v.type == T.NULL:
            return v
        text = v.type == T.STR
        if not text and T.kind(v.type) != "list" and v.type != T.VEC:
            raise T.TypeProblem("a slice of what is no list or string")
        n = (F.length(v.col) if text else F.size(v.col)).cast("bigint")

        def edge(x: A.Expr | None, other: Column) -> Column:
            if x is None:
                return other
            c = self(x)
            at = c.col if c.type == T.INT else F.lit(None).cast("bigint")
            return F.when(at < 0, F.greatest(at + n, F.lit(0))).when(at > n, n).otherwise(at)

        lo, hi = edge(e.lo, F.lit(0).cast("bigint")), edge(e.hi, n)
        size = F.when(hi > lo, hi - lo).when(hi <= lo, F.lit(0)).cast("int")
        cut = F.substring(v.col, (lo + 1).cast("int"), size) if text else F.slice(v.col, (lo + 1).cast("int"), size)
        return Val(F.when(size.isNotNull(), cut), v.type)

    def _listlit(self, e: A.ListLit) -> Val:
        items = [self.value(x) for x in e.items]
        known = [v.value for v in items] if all(v.literal for v in items) else None
        return listed(items, known)

    def _maplit(self, e: A.MapLit) -> Val:
        items = [(k, self.value(x)) for k, x in e.items]
        return mapped(items, {k: v.value for k, v in items} if all(v.literal for _, v in items) else None)

    def _mapprojection(self, e: A.MapProjection) -> Val:
        base, items = self(A.Var(e.name)), []
        for k, x in e.items:
            if k == "*" and x is None:
                items += [(f, self.property(base, f)) for f, _ in (base.type[1] if T.kind(base.type) in ("node", "rel", "map") else ())]
            else:
                items.append((k, self.value(x)))
        out = mapped(items)
        return Val(F.when(base.col.isNotNull(), out.col), out.type)

    def _source(self, e: A.Expr) -> Val:
        v = self(e)
        if v.type == T.VEC:
            return Val(v.col.cast("array<double>"), T.lst(T.FLOAT))
        if T.kind(v.type) != "list" and v.type != T.NULL:
            raise T.TypeProblem("expected a list")
        return v

    def _listcomp(self, e: A.ListComp) -> Val:
        v = self._source(e.source)
        if v.type == T.NULL:
            return v
        kind, col = v.type[1], v.col
        item = lambda x: self.inside(**{e.var: Val(x, kind)})
        if e.where is not None:
            col = F.filter(col, lambda x: F.coalesce(item(x).boolean(e.where), F.lit(False)))
        if e.out is None:
            return Val(col, v.type)
        seen: list = []

        def out(x):
            r = item(x).value(e.out)
            seen.append(r.type)
            return r.col

        made = F.transform(col, out)
        return Val(made, T.lst(seen[0]))

    def _quantifier(self, e: A.Quantifier) -> Val:
        v = self._source(e.source)
        if v.type == T.NULL:
            return null(T.BOOL)
        kind = v.type[1]
        test = lambda x: self.inside(**{e.var: Val(x, kind)}).boolean(e.where if e.where is not None else A.Var(e.var))
        if e.kind == "ANY":
            out = F.exists(v.col, test)
        elif e.kind == "ALL":
            out = F.forall(v.col, test)
        elif e.kind == "NONE":
            out = ~F.exists(v.col, test)
        else:
            out = F.when(v.col.isNotNull(), F.size(F.filter(v.col, lambda x: F.coalesce(test(x), F.lit(False)))) == 1)
        return Val(out, T.BOOL)

    def _reduce(self, e: A.Reduce) -> Val:
        v, first = self._source(e.source), self.value(e.init)
        if v.type == T.NULL:
            return v
        kind, item = first.type, v.type[1]
        for _ in range(3):  # the accumulator's type may widen
            seen: list = []

            def step(acc, x):
                r = self.inside(**{e.acc: Val(acc, kind), e.var: Val(x, item)}).value(e.body)
                seen.append(r.type)
                return T.convert(r.col, r.type, T.unify(kind, r.type)).cast(T.ddl(T.unify(kind, r.type)))

            made = F.aggregate(v.col, T.convert(first.col, first.type, kind).cast(T.ddl(kind)), step)
            wider = T.unify(kind, seen[0])
            if wider == kind:
                return Val(made, kind)
            kind = wider
        raise T.TypeProblem("reduce(): the type of its accumulator does not settle")

    def _case(self, e: A.Case) -> Val:
        subject = self(e.subject) if e.subject is not None else None
        tests = [equal(subject, self(w)) if subject is not None else self.boolean(w) for w, _ in e.whens]
        values = [self.value(t) for _, t in e.whens] + [self.value(e.other) if e.other is not None else null()]
        kind = T.NULL
        for v in values:
            kind = T.unify(kind, v.type)
        cols = [T.convert(v.col, v.type, kind) for v in values]
        out = F.when(tests[0], cols[0])
        for t, c in zip(tests[1:], cols[1:-1]):
            out = out.when(t, c)
        return Val(out.otherwise(cols[-1]), kind)

    # functions
    def _call(self, e: A.Call) -> Val:
        name = e.name.lower()
        if name in AGGREGATES:
            raise T.TypeProblem(f"{e.name}() can't stand here")
        special = getattr(self, "fn_" + name.replace(".", "_"), None)
        if special is not None:
            return special(*e.args)
        builder = library.REGISTRY.get(name)
        if builder is None:
            raise T.TypeProblem(f"unknown function {e.name}()")
        args = [self(x) for x in e.args]
        try:
            return builder(*args)
        except TypeError as problem:
            if "argument" in str(problem):
                raise T.TypeProblem(f"{e.name}(): {problem}") from None
            raise

    def fn_id(self, x):
        v = self(x)
        return null(T.INT) if v.type == T.NULL else Val(identity(v), T.INT)

    def fn_labels(self, x):
        v = self(x)
        return null(T.lst(T.STR)) if v.type == T.NULL else Val(self._labels(v), T.lst(T.STR))

    def fn_type(self, x):
        v = self(x)
        return null(T.STR) if v.type == T.NULL else Val(self._type(v), T.STR)

    def fn_haslabels(self, x, names):
        v, n = self(x), self(names)
        if v.type == T.NULL:
            return null(T.BOOL)
        if T.kind(n.type) != "list" or n.type[1] not in (T.STR, T.NULL):
            raise T.TypeProblem("hasLabels() takes a list of strings")
        labels = self._labels(v)
        return Val(F.when(labels.isNotNull(), F.forall(n.col.cast("array<string>"), lambda x: F.array_contains(labels, x))), T.BOOL)

    def fn_keys(self, x):
        v = self(x)
        k = T.kind(v.type)
        if v.type == T.NULL:
            return null(T.lst(T.STR))
        if k not in ("node", "rel", "map"):
            raise T.TypeProblem("keys() of what has none")
        if k == "map":
            return Val(F.when(v.col.isNotNull(), F.array(*(F.lit(f) for f, _ in v.type[1])).cast("array<string>")), T.lst(T.STR))
        names = F.array(*(F.when(self.property(v, f).col.isNotNull(), F.lit(f)) for f, _ in v.type[1])).cast("array<string>")
        return Val(F.when(v.col.isNotNull(), F.filter(names, lambda c: c.isNotNull())), T.lst(T.STR))

    def fn_properties(self, x):
        v = self(x)
        if v.type == T.NULL or T.kind(v.type) == "map":
            return v
        if T.kind(v.type) not in ("node", "rel"):
            raise T.TypeProblem("properties() of what has none")
        made = mapped([(f, self.property(v, f)) for f, _ in v.type[1]])
        return Val(F.when(v.col.isNotNull(), made.col), made.type)

    def fn_nodes(self, x):
        return self._of_path(x, "nodes", 1)

    def fn_relationships(self, x):
        return self._of_path(x, "rels", 2)

    def _of_path(self, x, field: str, at: int):
        v = self(x)
        if v.type == T.NULL:
            return v
        if T.kind(v.type) != "path":
            raise T.TypeProblem(f"{field} of what is no path")
        return Val(v.col[field], T.lst(v.type[at]))

    def fn_exists(self, x):
        return Val(self(x).col.isNotNull(), T.BOOL)

    def fn_size(self, x):
        return lists.size(self(x))

    def fn_startnode(self, x):
        return self._end(x, "src")

    def fn_endnode(self, x):
        return self._end(x, "dst")

    def _end(self, x, side: str):
        v = self(x)
        if v.type == T.NULL:
            return v
        if T.kind(v.type) != "rel":
            raise T.TypeProblem("an end of what is no relationship")
        node_id = F.col(getattr(v.entity, side)) if v.entity is not None else v.col[side]
        made = F.struct(node_id.alias("id"), self.graph.labels_of(node_id).alias("labels"), no_properties().alias("properties"))
        return Val(F.when(node_id.isNotNull(), made), ("node", ()))
