"""Clauses to DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph
from . import ast as A
from . import types as T
from .expressions import AGGREGATES, Exprs, conjuncts, has_aggregate, identity, rebuilt, walk
from .match import Matcher, Rows, has_subquery, variables
from .values import NodeB, RelB, Val, ValB, null

#: Functions that read an entity but none of its properties.
_ENTITY_ONLY = {"count", "id", "labels", "type", "indegree", "outdegree", "haslabels", "startnode", "endnode", "exists", "size", "length"}


@dataclass
class Demand:
    """Property keys that a query asks of each variable."""

    direct: dict[str, set[str]]
    bare: set[str]
    keys: set[str]
    whole: bool

    @classmethod
    def of(cls, query: A.Query) -> "Demand":
        out = cls({}, set(), set(), False)
        for part in query.parts:
            for i, clause in enumerate(part):
                out._clause(clause, final=i == len(part) - 1)
        return out

    def _clause(self, c, final: bool) -> None:
        if isinstance(c, (A.With, A.Return)):
            p = c.projection
            end = isinstance(c, A.Return) and final
            if p.star and end:
                self.whole = True
                self.bare.add("*")
            for item in p.items:
                if isinstance(item.expr, A.Var) and not end and item.expr.name == item.name:
                    continue
                self._visit(item.expr, end)
            for e in (*[o for o, _ in p.order], p.where):
                self._visit(e, False)
        elif isinstance(c, A.CallSub):
            for part in c.query.parts:
                for i, x in enumerate(part):
                    # an inner RETURN hands variables on under their names
                    self._clause(A.With(x.projection) if isinstance(x, A.Return) else x, final=False)
        else:
            self._visit(c, False)

    def _visit(self, e, end: bool) -> None:
        if isinstance(e, (list, tuple)):
            for x in e:
                self._visit(x, end)
        elif isinstance(e, A.Prop):
            self.keys.add(e.key)
            if isinstance(e.base, A.Var):
                self.direct.setdefault(e.base.name, set()).add(e.key)
            else:
                self._visit(e.base, False)
        elif isinstance(e, A.Var):
            self.bare.add(e.name)
            self.whole |= end
        elif isinstance(e, A.Index) and isinstance(e.at, A.Lit) and isinstance(e.at.value, str):
            self.keys.add(e.at.value)
            self._visit(e.base, False)
        elif isinstance(e, A.MapProjection):
            self.bare.add(e.name)
            for k, x in e.items:
                if k == "*" and x is None:
                    self.whole = True
                else:
                    self._visit(x, end)
        elif isinstance(e, A.Call):
            name = e.name.lower()
            if name in ("keys", "properties"):
                self.whole = True
            skip = name in _ENTITY_ONLY
            for x in e.args:
                if not (skip and isinstance(x, A.Var)):
                    self._visit(x, end and name in ("collect", "head", "last", "coalesce", "nodes", "relationships", "tail", "reverse"))
        elif isinstance(e, (A.IsNull, A.HasLabels)) and isinstance(e.x, A.Var):
            pass
        elif isinstance(e, A.Bin) and e.op in ("=", "<>"):
            for x in (e.a, e.b):
                if not isinstance(x, A.Var):
                    self._visit(x, False)
        elif isinstance(e, (A.NodePat, A.RelPat)):
            for k, x in e.props:
                self._visit(x, False)
        elif hasattr(e, "__dataclass_fields__"):
            for f in e.__dataclass_fields__:
                self._visit(getattr(e, f), end)

    def of_var(self, name: str) -> set[str] | None:
        if name in self.bare or "*" in self.bare:
            return None if self.whole else self.keys
        return self.direct.get(name, set())


def constant(e: A.Expr | None, params: dict, what: str) -> int | None:
    """A non-negative whole number known before the query runs."""
    if e is None:
        return None

    def value(x):
        if isinstance(x, A.Lit):
            return x.value
        if isinstance(x, A.Param) and x.name in params:
            return params[x.name]
        if isinstance(x, A.Un) and x.op == "-":
            return -value(x.x)
        if isinstance(x, A.Bin) and x.op in "+-*/%":
            a, b = value(x.a), value(x.b)
            return {"+": a + b, "-": a - b, "*": a * b}.get(x.op) if x.op in "+-*" else a // b if x.op == "/" else a % b
        if isinstance(x, A.Call) and x.name.lower() == "tointeger":
            return int(value(x.args[0]))
        raise T.TypeProblem(f"{what} must be a constant")

    n = value(e)
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise T.TypeProblem(f"{what} must be a non-negative integer")
    return n


class Planner(Matcher):
    """Turns a query's tree into rows; ``run`` gives the final DataFrame."""

    def __init__(self, graph: PropertyGraph, params: dict | None = None):
        super().__init__(graph, params or {})
        self._demand = Demand({}, set(), set(), False)
        self._outer: list[str] = []  # columns of the outer row, inside CALL {}
        self._path_use = False

    def demand(self, var: str | None) -> set[str] | None:
        return self._demand.of_var(var) if var else set()

    def path_keys(self, p: A.Pattern) -> set[str] | None:
        if not p.path:
            return None
        if p.path not in self._demand.bare and not self._path_use:
            return set()
        if self._demand.whole:
            return set(self.graph.property_types("node")) | set(self.graph.property_types("edge"))
        return self._demand.keys

    # whole queries
    def run(self, query: A.Query) -> DataFrame:
        self._demand = Demand.of(query)
        self._path_use = any(isinstance(x, A.Call) and x.name.lower() in ("nodes", "relationships") for x in walk(query))
        return self.output(self.query(query, self.unit()))

    def query(self, query: A.Query, rows: Rows) -> Rows:
        out = None
        for i, part in enumerate(query.parts):
            got = self.single(part, rows)
            if out is None:
                out = got
                continue
            if len(out.scope) != len(got.scope):
                raise T.TypeProblem("the parts of a UNION have as many columns each")
            a, b = self.values(out), self.values(got)
            got_named = Rows(b.df, dict(zip(a.scope, b.scope.values())))
            out = self.union_rows([a, got_named])
            if not query.unions[i - 1]:
                out = replace(out, df=out.df.dropDuplicates([*self._outer, *(c for x in out.scope.values() for c in x.columns())]))
        return out

    def _carried(self, rows: Rows) -> list[str]:
        return self._outer

    def values(self, rows: Rows) -> Rows:
        """Entities as structs in single columns."""
        e = self.exprs(rows.scope)
        cols, scope = [], {}
        for name, b in rows.scope.items():
            if isinstance(b, ValB):
                cols.append(F.col(b.column))
                scope[name] = b
            else:
                v, c = e.bound(b), self.fresh(name)
                cols.append(e.whole(v).alias(c))
                scope[name] = ValB(c, v.type)
        return Rows(rows.df.select(*self._outer, *cols), scope)

    def output(self, rows: Rows) -> DataFrame:
        out = self.values(rows)
        return out.df.select(*(F.col(b.column).cast("string").alias(n) if b.type == T.NULL else F.col(b.column).alias(n) for n, b in out.scope.items()))

    def single(self, part: list, rows: Rows) -> Rows:
        for i, clause in enumerate(part):
            ahead = part[i + 1] if i + 1 < len(part) else None
            if isinstance(clause, A.Match):
                short = self._counted(part, i, rows)
                if short is not None:
                    return short
                factored = self._factored(clause, ahead, rows)
                rows = factored if factored is not None else self.match_clause(rows, clause, ahead)
            elif isinstance(clause, (A.With, A.Return)):
                rows = self.project(rows, clause.projection)
            elif isinstance(clause, A.Unwind):
                rows = self.unwind(rows, clause)
            elif isinstance(clause, A.CallSub):
                rows = self.subquery(rows, clause.query)
            elif isinstance(clause, A.CallProc):
                from ..operators.procedures import call

                rows = call(self, rows, clause)
            else:
                raise T.TypeProblem(f"{type(clause).__name__} can't stand here")
        return rows

    # MATCH
    def match_clause(self, rows: Rows, m: A.Match, ahead) -> Rows:
        if not m.optional:
            return self.match(rows, m.patterns, m.where, self._reach_only(m, ahead))
        new = [v for v in dict.fromkeys(x for p in m.patterns for x in self._names(p)) if v not in rows.scope]
        found, keys = self.correlated(rows, m.patterns, m.where)
        cols = [c for v in new for c in found.scope[v].columns()]
        right = found.df.select(*(F.col(c).alias(k) for c, k in keys.values()), *dict.fromkeys(cols))
        on = reduce(lambda a, b: a & b, (F.col(mine).eqNullSafe(F.col(k)) for mine, (_, k) in keys.items()), F.lit(True))
        df = rows.df.join(right, on, "left").drop(*(k for _, k in keys.values()))
        return Rows(df, rows.scope | {v: found.scope[v] for v in new})

    @staticmethod
    def _names(p: A.Pattern) -> list[str]:
        out = [x.var for x in walk([p.nodes, p.rels]) if isinstance(x, (A.NodePat, A.RelPat)) and x.var]
        return [*out, *([p.path] if p.path else [])]

    def _reach_only(self, m: A.Match, ahead) -> bool:
        """Whether only the distinct ends of the clause's patterns are seen."""
        if not isinstance(ahead, (A.With, A.Return)) or len(m.patterns) != 1:
            return False
        p = ahead.projection
        counts = [x for x in walk(p.items) if isinstance(x, A.Call) and x.name.lower() in AGGREGATES]
        return p.distinct and not counts or bool(counts) and all(x.distinct for x in counts)

    def correlated(self, rows: Rows, patterns: list[A.Pattern], where: A.Expr | None) -> tuple[Rows, dict[str, tuple[str, str]]]:
        """Match patterns for the rows: what was found, and by column of the rows
        the column found and a fresh name for it. Where only node variables of
        the patterns are shared, they are matched from the graph itself; else
        from the distinct values of what is shared."""
        shared = [v for v in rows.scope if v in variables([patterns, where])]
        nodes = {x.var for x in walk(patterns) if isinstance(x, A.NodePat) and x.var}
        plain = all(isinstance(rows.scope[v], NodeB) and v in nodes for v in shared)
        variable = any(isinstance(x, A.RelPat) and x.variable for x in walk(patterns)) or any(p.selector for p in patterns)
        nested = has_subquery([where, patterns])
        if shared and plain and not variable and not nested:
            saved, self._outer = self._outer, []
            found = self.match(self.unit(), patterns, where)
            self._outer = saved
            keys = {}
            for v in shared:
                found = self._narrow(found, found.scope[v], rows.scope[v])
                keys[rows.scope[v].id] = (found.scope[v].id, self.fresh("k"))
            return found, keys
        scope = {v: rows.scope[v] for v in shared}
        cols = list(dict.fromkeys(c for b in scope.values() for c in b.columns()))
        heads = [b.id if not isinstance(b, ValB) else b.column for b in scope.values()]
        if not cols:
            saved, self._outer = self._outer, []
            found = self.match(self.unit(), patterns, where)
            self._outer = saved
            return found, {}
        base = Rows(rows.df.select(*cols).dropDuplicates(heads), scope)
        saved, self._outer = self._outer, []
        found = self.match(base, patterns, where)
        self._outer = saved
        return found, {h: (h, self.fresh("k")) for h in heads}

    def _narrow(self, found: Rows, got: NodeB, outer: NodeB) -> Rows:
        if set(got.tables) <= set(outer.tables):
            return found
        return found.where(self._in_tables(F.col(got.id), outer.tables))

    def filter(self, rows: Rows, e: A.Expr) -> Rows:
        """WHERE; patterns and EXISTS become semi and anti joins."""
        for c in conjuncts(e):
            inner, kind = (c.x, "left_anti") if isinstance(c, A.Un) and c.op == "NOT" else (c, "left_semi")
            if isinstance(inner, (A.PatternPredicate, A.Exists)):
                patterns, where = ([inner.pattern], None) if isinstance(inner, A.PatternPredicate) else (inner.patterns, inner.where)
                found, keys = self.correlated(rows, patterns, where)
                right = found.df.select(*(F.col(c).alias(k) for c, k in keys.values())) if keys else found.df.select(F.lit(1).alias(self.fresh("k"))).limit(1)
                on = reduce(lambda a, b: a & b, (F.col(mine) == F.col(k) for mine, (_, k) in keys.items()), F.lit(True))
                rows = replace(rows, df=rows.df.join(right, on, kind))
            else:
                rows, c = self.lift(rows, c)
                rows = rows.where(self.exprs(rows.scope).boolean(c))
        return rows

    # subqueries inside expressions
    def lift(self, rows: Rows, e):
        """Join what an expression's subqueries give, and put variables for them."""
        if not has_subquery(e):
            return rows, e
        state = {"rows": rows}

        def change(x):
            r = state["rows"]
            if isinstance(x, (A.PatternPredicate, A.Exists)):
                patterns, where = ([x.pattern], None) if isinstance(x, A.PatternPredicate) else (x.patterns, x.where)
                state["rows"], v = self._flag(r, patterns, where)
                return v
            if isinstance(x, A.PatternComp):
                state["rows"], v = self._gathered(r, x)
                return v
            if isinstance(x, A.ShortestPath):
                state["rows"], v = self._shortest_value(r, x)
                return v
            if isinstance(x, A.Call) and x.name.lower() in ("indegree", "outdegree"):
                state["rows"], v = self._degree(r, x)
                return v
            return None

        out = rebuilt(e, change)
        return state["rows"], out

    def _attach(self, rows: Rows, found: DataFrame, keys: dict, name: str, kind, default: Column) -> tuple[Rows, A.Var]:
        on = reduce(lambda a, b: a & b, (F.col(mine).eqNullSafe(F.col(k)) for mine, (_, k) in keys.items()), F.lit(True))
        df = rows.df.join(found, on, "left").drop(*(k for _, k in keys.values()))
        df = df.withColumn(name, F.coalesce(F.col(name), default))
        var = "§" + name
        return Rows(df, rows.scope | {var: ValB(name, kind)}), A.Var(var)

    def _flag(self, rows: Rows, patterns, where) -> tuple[Rows, A.Var]:
        found, keys = self.correlated(rows, patterns, where)
        name = self.fresh("there")
        right = found.df.select(*(F.col(c).alias(k) for c, k in keys.values())).distinct() if keys else found.df.limit(1).select()
        return self._attach(rows, right.select("*", F.lit(True).alias(name)), keys, name, T.BOOL, F.lit(False))

    def _gathered(self, rows: Rows, x: A.PatternComp) -> tuple[Rows, A.Var]:
        inner = A.With(A.Projection([A.Item(x.out, "v")]))
        refers = A.Bin("=", x.out, x.out) if variables(x.out) & set(rows.scope) else None
        shared = [v for v in rows.scope if v in variables([x.pattern, x.where, refers])]
        nodes = {n.var for n in x.pattern.nodes if n.var}
        found, keys = self.correlated(rows, [x.pattern], x.where) if all(v in nodes or v not in variables(x.out) for v in shared) else self._correlated_with(rows, x, shared)
        found, out = self.lift(found, inner.projection.items[0].expr)
        v = self.exprs(found.scope).value(out)
        name = self.fresh("list")
        grouped = found.df.select(*(F.col(c).alias(k) for c, k in keys.values()), v.col.alias(name))
        grouped = grouped.groupBy(*(k for _, k in keys.values())).agg(F.collect_list(F.struct(F.col(name).alias("v"))).alias(name))
        grouped = grouped.withColumn(name, F.transform(name, lambda s: s["v"]))
        kind = T.lst(v.type)
        return self._attach(rows, grouped, keys, name, kind, F.array().cast(T.ddl(kind) if v.type != T.NULL else "array<string>"))

    def _correlated_with(self, rows: Rows, x: A.PatternComp, shared: list[str]):
        probe = A.IsNull(A.ListLit([A.Var(v) for v in shared]), True)
        return self.correlated(rows, [x.pattern], probe if x.where is None else A.Bin("AND", x.where, probe))

    def _shortest_value(self, rows: Rows, x: A.ShortestPath) -> tuple[Rows, A.Var]:
        path = "§path" + self.fresh("p")
        p = replace(x.pattern, path=path, selector=("any", 1))
        if any(not n.var or n.var not in rows.scope for n in p.nodes):
            raise T.TypeProblem("shortestPath() stands between bound nodes")
        found, keys = self.correlated(rows, [p], None)
        b = found.scope[path]
        name = self.fresh("path")
        right = found.df.select(*(F.col(c).alias(k) for c, k in keys.values()), F.col(b.column).alias(name))
        return self._attach(rows, right, keys, name, b.type, F.lit(None).cast(T.ddl(b.type)))

    def _degree(self, rows: Rows, x: A.Call) -> tuple[Rows, A.Var]:
        """Degrees, counted before they are joined."""
        rows, arg = self.lift(rows, x.args[0])
        v = self.exprs(rows.scope)(arg)
        if T.kind(v.type) != "node":
            raise T.TypeProblem(f"{x.name}() takes a node")
        names: set[str] | None = None
        for a in x.args[1:]:
            w = self.exprs({})(a).value
            names = (names or set()) | set(w if isinstance(w, list) else [w])
        side = "dst" if x.name.lower() == "indegree" else "src"
        tables = self.graph.edge_tables(lambda t: names is None or bool(t & names))
        name, key = self.fresh("degree"), self.fresh("k")
        right = self.graph.edge_frame(tables, []).groupBy(F.col(side).alias(key)).agg(F.count(F.lit(1)).alias(name))
        at = self.fresh("at")
        rows = replace(rows, df=rows.df.withColumn(at, identity(v)))
        return self._attach(rows, right, {at: (key, key)}, name, T.INT, F.lit(0).cast("bigint"))

    # counts over expansions
    def _counted(self, part: list, i: int, rows: Rows) -> Rows | None:
        """``MATCH chain RETURN count(*)``: the last hop's edges are counted by
        near end before they are joined, so the longest expansion never is."""
        m = part[i]
        if m.optional or len(m.patterns) != 1 or i + 2 != len(part) or not isinstance(part[i + 1], A.Return):
            return None
        p, proj = m.patterns[0], part[i + 1].projection
        if p.selector or p.path or p.restrictor or len(p.rels) < 2 or not all(isinstance(r, A.RelPat) and not r.variable for r in p.rels) or not rows.unit or self._outer:
            return None
        if len(proj.items) != 1 or proj.star or proj.order or proj.skip or proj.limit or proj.items[0].expr != A.Call("count", [], star=True):
            return None
        seen = variables(m.where)
        for nodes, rels in ((p.nodes, p.rels), (p.nodes[::-1], [replace(r, direction={"out": "in", "in": "out", "both": "both"}[r.direction]) for r in p.rels[::-1]])):
            last, rel, near = nodes[-1], rels[-1], nodes[-2]
            names = [n.var for n in nodes[:-1] if n.var]
            if last.props or rel.props or last.var and (last.var in names or last.var in seen) or rel.var and rel.var in seen:
                continue
            every = self._tables(near)
            edges, b, a, z, _, far_in = self._edges(A.RelPat(None, rel.types, [], rel.direction), rel.direction, every, self._tables(last))
            others = {t for r in rels[:-1] for t in self.graph.edge_tables(lambda types, r=r: r.types is None or r.types.test(types))}
            if set(b.tables) & others:
                continue
            if set(far_in) - set(self._tables(last)):
                edges = edges.where(self._in_tables(F.col(z), self._tables(last)))
            var = near.var or "§near"
            head = replace(p, nodes=[*nodes[:-2], replace(near, var=var)], rels=rels[:-1])
            found = self.match(rows, [head], m.where)
            n = self.fresh("n")
            counted = edges.groupBy(a).agg(F.count(F.lit(1)).alias(n))
            ends = found.df.groupBy(F.col(found.scope[var].id).alias("_near")).agg(F.count(F.lit(1)).alias("_m"))
            total, name = self.fresh("count"), proj.items[0].name
            df = ends.join(counted, F.col("_near") == F.col(a)).agg(F.coalesce(F.sum(F.col("_m") * F.col(n)), F.lit(0)).cast("bigint").alias(total))
            return Rows(df, {name: ValB(total, T.INT)})
        return None

    # UNWIND
    def _factored(self, m: A.Match, ahead, rows: Rows) -> Rows | None:
        """Comma patterns of which aggregates see no more than how many rows there
        are: each is counted by what the others and the projection read of it and
        the counts are multiplied, so that the patterns' product is never made."""
        if m.optional or len(m.patterns) < 2 or not rows.unit or self._outer or not isinstance(ahead, (A.With, A.Return)) or ahead.projection.star:
            return None
        items = ahead.projection.items
        calls = [x for x in walk(items) if isinstance(x, A.Call) and x.name.lower() in AGGREGATES]
        if not calls or not all(x.distinct or x.name.lower() in ("count", "min", "max") for x in calls):
            return None
        if any(p.selector or p.path or not all(isinstance(r, A.RelPat) for r in p.rels) for p in m.patterns):
            return None
        nodes = [{n.var for n in p.nodes if n.var} for p in m.patterns]
        names = [own | {r.var for r in p.rels if r.var} for own, p in zip(nodes, m.patterns)]
        shared = {v for i, own in enumerate(names) for other in names[i + 1 :] for v in own & other}
        if any(shared & own - of for own, of in zip(names, nodes)) or any(variables([p.nodes, p.rels]) - own for p, own in zip(m.patterns, names)):
            return None
        wheres: list[list[A.Expr]] = [[] for _ in m.patterns]
        for e in conjuncts(m.where):
            at = next((i for i, own in enumerate(names) if self._free(e) <= own), None)
            if at is None or has_subquery(e):
                return None
            wheres[at].append(e)
        left = list(range(len(names)))
        made: Rows | None = None
        while left:
            at = next((i for i in left if made is not None and names[i] & set(made.scope)), left[0])
            left.remove(at)
            on = [v for v in made.scope if v in names[at]] if made is not None else []
            base = Rows(made.df.select(*dict.fromkeys(c for v in on for c in made.scope[v].columns())).distinct(), {v: made.scope[v] for v in on}) if on else self.unit()
            where = reduce(lambda a, b: A.Bin("AND", a, b), wheres[at]) if wheres[at] else None
            found = self.match(base, [m.patterns[at]], where)
            seen = variables(items) | {v for i in left for v in names[i]}
            kept = {v: b for v, b in found.scope.items() if v in seen and v not in on}
            keys = {v: self.fresh("k") for v in on}
            by = [*(F.col(made.scope[v].id).alias(k) for v, k in keys.items()), *(F.col(c) for c in dict.fromkeys(c for b in kept.values() for c in b.columns()))]
            n = self.fresh("n")
            counted = found.df.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) if by else found.df.agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 0)
            if made is None:
                made = Rows(counted, kept, weight=n)
                continue
            both = reduce(lambda a, b: a & b, (F.col(made.scope[v].id) == F.col(k) for v, k in keys.items()), F.lit(True))
            df, times = made.df.join(counted, both) if keys else made.df.crossJoin(counted), self.fresh("n")
            made = Rows(df.withColumn(times, F.col(made.weight) * F.col(n)).drop(made.weight, n, *keys.values()), made.scope | kept, weight=times)
        return made

    def unwind(self, rows: Rows, c: A.Unwind) -> Rows:
        rows, source = self.lift(rows, c.source)
        v = self.exprs(rows.scope).value(source)
        name = self.fresh(c.var)
        if v.type == T.NULL:
            return Rows(rows.df.where(F.lit(False)).withColumn(name, F.lit(None).cast("string")), rows.scope | {c.var: ValB(name, T.NULL)})
        if T.kind(v.type) == "list":
            col, kind = v.col, v.type[1]
        elif v.type == T.VEC:
            col, kind = v.col.cast("array<double>"), T.FLOAT
        else:
            col, kind = F.when(v.col.isNotNull(), F.array(v.col)), v.type
        if kind == T.NULL:
            col = col.cast("array<string>")
        return Rows(rows.df.select("*", F.explode(col).alias(name)), rows.scope | {c.var: ValB(name, kind)})

    # CALL { }
    def subquery(self, rows: Rows, query: A.Query) -> Rows:
        imports: list[str] = []
        parts = []
        for part in query.parts:
            first = part[0]
            if isinstance(first, A.With) and not rows.unit and all(isinstance(i.expr, A.Var) and i.expr.name in rows.scope and i.name == i.expr.name for i in first.projection.items):
                p = first.projection
                if p.distinct or p.order or p.skip or p.limit or p.where:
                    raise T.TypeProblem("an importing WITH takes variables alone")
                imports += [v for v in (list(rows.scope) if p.star else [x.name for x in p.items]) if v not in imports]
                parts.append(part[1:])
            elif isinstance(first, A.With) and any(isinstance(x, A.Var) and x.name in rows.scope for x in walk(first)):
                raise T.TypeProblem("an importing WITH takes variables alone")
            else:
                parts.append(part)
        if not isinstance(parts[0][-1], A.Return):
            return rows  # reads and returns nothing
        scope = {v: rows.scope[v] for v in imports}
        heads = [b.id if not isinstance(b, ValB) else b.column for b in scope.values()]
        saved = self._outer
        if heads:
            keys = {h: self.fresh("k") for h in heads}
            cols = list(dict.fromkeys(c for b in scope.values() for c in b.columns()))
            distinct = rows.df.select(*cols).dropDuplicates(heads).select("*", *(F.col(h).alias(k) for h, k in keys.items()))
            self._outer = list(keys.values())
            base, self._outer_base = self._outer_base, distinct.select(*keys.values())
            got = self.query(A.Query(parts, query.unions), Rows(distinct, scope))
            self._outer_base = base
        else:
            keys = {}
            self._outer = []
            got = self.query(A.Query(parts, query.unions), self.unit())
        self._outer = saved
        clash = set(got.scope) & set(rows.scope) - {v for v in imports if got.scope.get(v) == rows.scope[v]}
        if set(got.scope) & set(rows.scope):
            raise T.TypeProblem(f"CALL returns a name that is bound already: {', '.join(sorted(clash or set(got.scope) & set(rows.scope)))}")
        # imported columns that pass through get fresh names
        cols, fresh = [], {}
        for c in dict.fromkeys(c for b in got.scope.values() for c in b.columns()):
            fresh[c] = self.fresh("o")
            cols.append(F.col(c).alias(fresh[c]))
        right = got.df.select(*keys.values(), *cols)
        on = reduce(lambda a, b: a & b, (F.col(h).eqNullSafe(F.col(k)) for h, k in keys.items()), F.lit(True))
        df = (rows.df.join(right, on) if keys else rows.df.crossJoin(right)).drop(*keys.values())
        return Rows(df, rows.scope | {n: self._renamed(b, fresh) for n, b in got.scope.items()})

    @staticmethod
    def _renamed(b, names: dict[str, str]):
        if isinstance(b, ValB):
            return ValB(names[b.column], b.type)
        props = {k: names[c] for k, c in b.props.items()}
        if isinstance(b, NodeB):
            return NodeB(names[b.id], b.tables, props)
        return RelB(names[b.id], names[b.src], names[b.dst], b.tables, props)

    # WITH and RETURN
    def project(self, rows: Rows, p: A.Projection) -> Rows:
        items = [A.Item(A.Var(n), n) for n in rows.scope if not n.startswith("§")] if p.star else []
        items += p.items
        if len({i.name for i in items}) < len(items):
            raise T.TypeProblem("two columns have one name")
        if p.star and not items:
            raise T.TypeProblem("* with nothing bound")
        by_expr = lambda e: rebuilt(e, lambda x: next((A.Var(i.name) for i in items if x == i.expr and not isinstance(x, (A.Var, A.Lit))), None))
        grouped = any(has_aggregate(i.expr) for i in items)
        order = [(by_expr(e), up) for e, up in p.order]
        if grouped:
            rows, scope = self._aggregate(rows, items)
            seen = scope
        else:
            rows, lifted = self.lift(rows, [i.expr for i in items])
            e, scope, new = self.exprs(rows.scope), {}, []
            for item, x in zip(items, lifted):
                v = e(x)
                if v.entity is not None:
                    scope[item.name] = v.entity
                elif isinstance(x, A.Var) and isinstance(rows.scope.get(x.name), ValB):
                    scope[item.name] = rows.scope[x.name]
                else:
                    c = self.fresh(item.name)
                    new.append(v.col.alias(c))
                    scope[item.name] = ValB(c, v.type)
            rows = replace(rows, df=rows.df.select("*", *new), unit=False)
            seen = scope if p.distinct else rows.scope | scope
        if p.distinct:
            heads = [b.column if isinstance(b, ValB) else b.id for b in scope.values()]
            rows = replace(rows, df=rows.df.select(*self._outer, *dict.fromkeys(c for b in scope.values() for c in b.columns())).dropDuplicates([*self._outer, *dict.fromkeys(heads)]))
        elif p.where is not None:
            rows = self._where(rows, scope, p.where)
        sorting: list[Column] = []
        if order:
            rows, exprs = self.lift(replace(rows, scope=seen), [e for e, _ in order])
            x = self.exprs(rows.scope)
            for e, (_, up) in zip(exprs, order):
                v = x(e)
                c = identity(v) if T.kind(v.type) in ("node", "rel") else v.col
                sorting.append(c.asc_nulls_first() if up else c.desc_nulls_last())
        skip, limit = constant(p.skip, self.params, "SKIP"), constant(p.limit, self.params, "LIMIT")
        df = rows.df
        if self._outer and (skip or limit is not None):
            name = self.fresh("row")
            df = df.withColumn(name, F.row_number().over(Window.partitionBy(*self._outer).orderBy(*(sorting or [F.lit(1)]))))
            df = df.where((F.col(name) > (skip or 0)) & ((F.col(name) <= (skip or 0) + limit) if limit is not None else F.lit(True))).drop(name)
        else:
            if sorting:
                df = df.orderBy(*sorting)
            if skip:
                df = df.offset(skip)
            if limit is not None:
                df = df.limit(limit)
        df = df.select(*self._outer, *dict.fromkeys(c for b in scope.values() for c in b.columns()))
        rows = Rows(df, scope)
        if p.distinct and p.where is not None:
            rows = self._where(rows, scope, p.where)
        return rows

    def _where(self, rows: Rows, scope: dict, e: A.Expr) -> Rows:
        kept = rows.scope
        out = self.filter(Rows(rows.df, scope), e)
        return Rows(out.df, kept)

    def _aggregate(self, rows: Rows, items: list[A.Item]) -> tuple[Rows, dict]:
        weight = rows.weight
        keys = [i for i in items if not has_aggregate(i.expr)]
        mixed = [i for i in items if has_aggregate(i.expr)]
        rows, lifted = self.lift(rows, [i.expr for i in keys])
        e, scope, group, first = self.exprs(rows.scope), {}, [], []
        new: list[Column] = []
        for item, x in zip(keys, lifted):
            v = e(x)
            if v.entity is not None:
                scope[item.name] = v.entity
                group.append(v.entity.id)
                first += [c for c in v.entity.columns() if c != v.entity.id]
            else:
                c = self.fresh(item.name)
                new.append(v.col.alias(c))
                scope[item.name] = ValB(c, v.type)
                group.append(c)
        calls: list[A.Call] = []
        for i in mixed:
            for x in walk(i.expr):
                if isinstance(x, A.Call) and x.name.lower() in AGGREGATES:
                    if any(has_aggregate(a) for a in x.args):
                        raise T.TypeProblem("an aggregate inside an aggregate")
                    if x not in calls:
                        calls.append(x)
        aggs: list[Column] = []
        defaults: dict[str, Column] = {}
        local: dict[str, Val] = {}
        for n, call in enumerate(calls):
            rows, args = self.lift(rows, call.args)
            e = self.exprs(rows.scope)
            name = self.fresh(call.name)
            col, kind, empty, extra = self._reducer(e, call, args, name, weight)
            new += extra
            aggs.append(col.alias(name))
            defaults[name] = empty
            local[f"§agg{n}"] = Val(F.col(name), kind)
        df = rows.df.select("*", *new)
        replaced = [rebuilt(i.expr, lambda x: A.Var(f"§agg{calls.index(x)}") if isinstance(x, A.Call) and x in calls else next((A.Var(k.name) for k in keys if x == k.expr), None)) for i in mixed]
        # variables beside aggregates that aren't keys are those of the group's first row
        loose = {v for x in replaced for v in variables(x) if v in rows.scope and v not in scope}
        for v in loose:
            first += rows.scope[v].columns()
        outer = self._outer
        by = list(dict.fromkeys([*outer, *group]))
        firsts = [F.first(c).alias(c) for c in dict.fromkeys(first) if c not in by]
        if outer and not group:
            made = df.groupBy(*by).agg(*aggs, *firsts)
            made = self._outer_rows(made, defaults)
        else:
            made = df.groupBy(*by).agg(*aggs, *firsts) if by else df.agg(*aggs, *firsts)
        inner = Exprs(self.graph, self.params, {v: rows.scope[v] for v in loose} | scope, local)
        out = []
        for item, x in zip(mixed, replaced):
            v = inner.value(x)
            c = self.fresh(item.name)
            out.append(v.col.alias(c))
            scope[item.name] = ValB(c, v.type)
        made = made.select("*", *out)
        scope = {i.name: scope[i.name] for i in items}
        return Rows(made, scope), scope

    def _outer_rows(self, made: DataFrame, defaults: dict[str, Column]) -> DataFrame:
        """An aggregate without keys has a row for each outer row, even if that
        row found nothing."""
        base = self._outer_base
        if base is None:
            return made
        return base.join(made, self._outer, "left").select(*self._outer, *(F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults and defaults[c] is not None else F.col(c) for c in made.columns if c not in self._outer))

    _outer_base: DataFrame | None = None

    def _reducer(self, e: Exprs, call: A.Call, args: list, name: str, weight: str | None = None) -> tuple[Column, object, Column | None, list[Column]]:
        """(aggregate, type, value over no rows, columns to project before);
        ``weight``: the column that holds how many rows a row stands for."""
        fn = call.name.lower()
        zero = F.lit(0).cast("bigint")
        if fn == "count":
            if call.star:
                return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), zero), T.INT, zero, []
            v = e(args[0])
            c = identity(v) if T.kind(v.type) in ("node", "rel") else v.col
            if weight is not None and not call.distinct:
                return F.coalesce(F.sum(F.when(c.isNotNull(), F.col(weight))), zero), T.INT, zero, []
            return F.count_distinct(c) if call.distinct else F.count(c), T.INT, zero, []
        if len(args) != (2 if fn.startswith("percentile") else 1):
            raise T.TypeProblem(f"{call.name}() takes {2 if fn.startswith('percentile') else 1} argument(s)")
        v = e.value(args[0])
        if fn == "collect":
            kind = T.lst(v.type)
            if v.type == T.NULL:
                return F.collect_list(v.col.cast("string")), kind, F.array().cast("array<string>"), []
            return F.collect_set(v.col) if call.distinct else F.collect_list(v.col), kind, F.array().cast(T.ddl(kind)), []
        if fn in ("min", "max"):
            if T.kind(v.type) in ("node", "rel", "path"):
                raise T.TypeProblem(f"{call.name}() of an entity")
            if v.type == T.NULL:
                return F.max(v.col.cast("string")), T.NULL, None, []
            return (F.min if fn == "min" else F.max)(v.col), v.type, None, []
        if v.type == T.NULL:
            v = null(T.INT)
        if not T.numeric(v.type):
            raise T.TypeProblem(f"{call.name}() of what isn't a number")
        real = v.col.cast("double")
        if fn == "sum":
            empty = zero if v.type == T.INT else F.lit(0.0)
            return F.coalesce(F.sum_distinct(v.col) if call.distinct else F.sum(v.col), empty), v.type, empty, []
        if fn == "avg":
            return (F.sum_distinct(real) / F.count_distinct(real)) if call.distinct else F.avg(real), T.FLOAT, None, []
        if fn in ("stdev", "stdevp"):
            d = F.array_distinct(F.collect_list(real)) if call.distinct else None
            if d is not None:
                raise T.TypeProblem(f"{call.name}(DISTINCT) is not supported")
            return F.coalesce(F.stddev_samp(real) if fn == "stdev" else F.stddev_pop(real), F.lit(0.0)), T.FLOAT, F.lit(0.0), []
        share = e(args[1])
        if not share.literal or share.type not in (T.INT, T.FLOAT) or not 0 <= share.value <= 1:
            raise T.TypeProblem(f"{call.name}() takes a constant from 0 to 1")
        tmp = self.fresh("p")
        if fn == "percentilecont":
            return F.percentile(F.col(tmp), float(share.value)), T.FLOAT, None, [real.alias(tmp)]
        return F.expr(f"percentile_disc({float(share.value)!r}) WITHIN GROUP (ORDER BY {tmp})"), T.FLOAT, None, [real.alias(tmp)]
