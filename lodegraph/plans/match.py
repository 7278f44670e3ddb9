"""Graph patterns to joins.

A hop is an equi-join of the bindings with the edge tables that its type, its
direction and the possible tables of its ends leave. The node table of the far
end is joined only if a property of it is asked for: labels follow from ids.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import SHIFT, PropertyGraph
from ..storage import checkpointed, stored
from . import ast as A
from . import types as T
from .expressions import Exprs, conjuncts, no_properties, walk
from .values import NodeB, RelB, Val, ValB

#: Hops that a variable-length pattern may have before levels are checkpointed.
LAZY_LEVELS = 3
#: Hops of a variable-length pattern up to which tables are pruned hop by hop.
PRUNED_LEVELS = 8
_SUBQUERY = (A.PatternPredicate, A.Exists, A.PatternComp, A.ShortestPath)


@dataclass(frozen=True)
class Rows:
    df: DataFrame
    scope: dict
    unit: bool = False  # one row, nothing bound
    weight: str | None = None  # a column: how many rows a row stands for

    def where(self, c: Column) -> "Rows":
        return replace(self, df=self.df.where(c))


def variables(e) -> set[str]:
    out = {x.name for x in walk(e) if isinstance(x, (A.Var, A.MapProjection))}
    for x in walk(e):
        if isinstance(x, (A.NodePat, A.RelPat)) and x.var:
            out.add(x.var)
    return out


def flipped(direction: str) -> str:
    return {"out": "in", "in": "out", "both": "both"}[direction]


def has_subquery(e) -> bool:
    return any(isinstance(x, _SUBQUERY) or isinstance(x, A.Call) and x.name.lower() in ("indegree", "outdegree") for x in walk(e))


class Matcher:
    graph: PropertyGraph
    params: dict

    def __init__(self, graph: PropertyGraph, params: dict):
        self.graph, self.params = graph, params
        self._count = 0

    def fresh(self, what: str = "c") -> str:
        self._count += 1
        return f"_{self._count}_{''.join(c for c in what if c.isalnum() or c == '_')}"

    def exprs(self, scope: dict) -> Exprs:
        return Exprs(self.graph, self.params, scope)

    def demand(self, var: str | None) -> set[str] | None:  # None: all
        raise NotImplementedError

    def filter(self, rows: Rows, e: A.Expr) -> Rows:
        raise NotImplementedError

    def unit(self) -> Rows:
        return Rows(self.graph.spark.range(1).select(F.lit(1).alias(self.fresh("one"))), {}, True)

    # node and edge frames
    def _keys(self, entity: str, var: str | None, tables: tuple[int, ...], more: set[str] = frozenset()) -> list[str]:
        wanted = self.demand(var) if var else set()
        there = {k for i in tables for k in self.graph.table_properties(entity, i)}
        return sorted(there if wanted is None else there & (wanted | set(more)))

    def _tables(self, node: A.NodePat) -> tuple[int, ...]:
        return self.graph.node_tables(lambda labels: node.labels is None or node.labels.test(labels))

    def _scan(self, node: A.NodePat, more: set[str] = frozenset()) -> tuple[DataFrame, NodeB]:
        tables = self._tables(node)
        keys = self._keys("node", node.var, tables, more | {k for k, _ in node.props})
        name = self.fresh(node.var or "n")
        cols = {k: self.fresh(k) for k in keys}
        df = self.graph.node_frame(tables, keys).select(F.col("id").alias(name), *(F.col(f"`{k}`").alias(c) for k, c in cols.items()))
        return df, NodeB(name, tables, cols)

    def _edges(self, rel: A.RelPat, direction: str, near: tuple[int, ...], far: tuple[int, ...], more: set[str] = frozenset(), ends: bool = False) -> tuple[DataFrame | None, RelB, str, str, tuple[int, ...], tuple[int, ...]]:
        """Edges seen from the near end: frame, binding, near and far column,
        tables that the two ends may be in."""
        g = self.graph
        typed = g.edge_tables(lambda types: rel.types is None or rel.types.test(types))
        meets = lambda a, b: a is None or bool(set(a) & set(b))
        forward = tuple(i for i in typed if meets(g.edges[i].src, near) and meets(g.edges[i].dst, far)) if direction != "in" else ()
        backward = tuple(i for i in typed if meets(g.edges[i].dst, near) and meets(g.edges[i].src, far)) if direction != "out" else ()
        tables = tuple(sorted({*forward, *backward}))
        keys = self._keys("edge", rel.var, tables, more | {k for k, _ in rel.props})
        eid, a, b = self.fresh(rel.var or "r"), self.fresh("a"), self.fresh("b")
        cols = {k: self.fresh(k) for k in keys}
        props = [F.col(f"`{k}`").alias(c) for k, c in cols.items()]
        src, dst = (a, b) if direction == "out" else (b, a) if direction == "in" else (self.fresh("src"), self.fresh("dst"))
        both = direction == "both"
        parts = []
        for these, x, y in ((forward, "src", "dst"), (backward, "dst", "src")):
            if these:
                extra = [F.col("src").alias(src), F.col("dst").alias(dst)] if both else []
                parts.append(g.edge_frame(these, keys).select(F.col("id").alias(eid), F.col(x).alias(a), F.col(y).alias(b), *extra, *props))
        every = tuple(range(len(g.nodes)))
        side = lambda these, end: {t for i in these for t in (getattr(g.edges[i], end) if getattr(g.edges[i], end) is not None else every)}
        near_in = tuple(sorted(side(forward, "src") | side(backward, "dst")))
        far_in = tuple(sorted(side(forward, "dst") | side(backward, "src")))
        if not parts:
            parts.append(g.edge_frame((), keys).select(F.col("id").alias(eid), F.col("src").alias(a), F.col("dst").alias(b), *([F.col("src").alias(src), F.col("dst").alias(dst)] if both else []), *props))
        return reduce(DataFrame.unionAll, parts), RelB(eid, src, dst, tables, cols), a, b, near_in, far_in

    def _in_tables(self, c: Column, tables: tuple[int, ...]) -> Column:
        return F.shiftright(c, SHIFT).cast("int").isin(list(tables)) if tables else F.lit(False)

    def _props(self, rows: Rows, b, props: list[tuple[str, A.Expr]]) -> Rows:
        """Inline properties, by loose equality."""
        from .expressions import equal

        for k, e in props:
            x = self.exprs(rows.scope)
            rows = rows.where(equal(x.property(x.bound(b), k), x(e)))
        return rows

    def _bind_node(self, rows: Rows, column: str, node: A.NodePat, possible: tuple[int, ...], more: set[str] = frozenset()) -> tuple[Rows, NodeB]:
        """Bind a node pattern to ids that are in a column already."""
        if node.var and node.var in rows.scope:
            old = rows.scope[node.var]
            if not isinstance(old, NodeB):
                old = self._entity_of(old)
            rows = rows.where(F.col(column) == F.col(old.id))
            return self._check(rows, old, node), old
        allowed = self._tables(node)
        tables = tuple(t for t in possible if t in allowed)
        keys = self._keys("node", node.var, tables, more | {k for k, _ in node.props})
        if keys:
            cols, key = {k: self.fresh(k) for k in keys}, self.fresh("id")
            frame = self.graph.node_frame(tables, keys).select(F.col("id").alias(key), *(F.col(f"`{k}`").alias(c) for k, c in cols.items()))
            rows = replace(rows, df=rows.df.join(frame, F.col(column) == F.col(key)).drop(key))
            b = NodeB(column, tables, cols)
        else:
            if set(tables) != set(possible):
                rows = rows.where(self._in_tables(F.col(column), tables))
            b = NodeB(column, tables, {})
        if node.var:
            rows = replace(rows, scope=rows.scope | {node.var: b})
        return self._props(rows, b, node.props), b

    def _entity_of(self, b) -> NodeB:
        raise T.TypeProblem("a variable that isn't a node stands for one in a pattern")

    def _check(self, rows: Rows, b: NodeB, node: A.NodePat) -> Rows:
        """Constraints of a pattern on a node that is bound already."""
        allowed = self._tables(node)
        if not set(b.tables) <= set(allowed):
            rows = rows.where(self._in_tables(F.col(b.id), tuple(t for t in b.tables if t in allowed)))
        return self._props(rows, b, node.props)

    # patterns
    def match(self, rows: Rows, patterns: list[A.Pattern], where: A.Expr | None, reach: bool = False) -> Rows:
        choices = [self._unrolled(p) for p in patterns]
        options = list(product(*choices))
        if len(options) == 1:
            return self._match(rows, list(options[0]), where, reach)
        parts = [self._match(rows, list(o), where, reach) for o in options]
        return self.union_rows(parts)

    def union_rows(self, parts: list[Rows]) -> Rows:
        """Union of rows with the same names bound."""
        first = parts[0]
        cols: list[str] = []
        scope = {}
        for name, b in first.scope.items():
            others = [p.scope[name] for p in parts]
            if isinstance(b, ValB):
                kind = reduce(T.unify, (o.type for o in others))
                c = self.fresh(name)
                cols.append(c)
                scope[name] = (ValB(c, kind), others)
            else:
                keys = sorted({k for o in others for k in o.props})
                tables = tuple(sorted({t for o in others for t in o.tables}))
                heads = [self.fresh(name) for _ in range(1 if isinstance(b, NodeB) else 3)]
                props = {k: self.fresh(k) for k in keys}
                scope[name] = (type(b)(*heads, tables, props), others)
        frames = []
        for i, p in enumerate(parts):
            out = []
            for name, (new, others) in scope.items():
                o = others[i]
                if isinstance(new, ValB):
                    out.append(T.convert(F.col(o.column), o.type, new.type).alias(new.column))
                    continue
                heads = ("id",) if isinstance(new, NodeB) else ("id", "src", "dst")
                out += [F.col(getattr(o, h)).alias(getattr(new, h)) for h in heads]
                entity = "node" if isinstance(new, NodeB) else "edge"
                types, own = self.graph.property_types(entity, new.tables), self.graph.property_types(entity, o.tables)
                out += [(T.convert(F.col(o.props[k]), own[k], types[k]) if k in o.props else F.lit(None).cast(T.ddl(types[k]))).alias(c) for k, c in new.props.items()]
            kept = [c for c in p.df.columns if c in self._carried(first)]
            frames.append(p.df.select(*kept, *out))
        return Rows(reduce(DataFrame.unionAll, frames), {n: new for n, (new, _) in scope.items()})

    def _carried(self, rows: Rows) -> list[str]:
        return []

    def _unrolled(self, p: A.Pattern) -> list[A.Pattern]:
        """Patterns with fixed repetitions in place of quantified parts."""
        at = next((i for i, r in enumerate(p.rels) if isinstance(r, A.Quantified)), None)
        if at is None:
            return [p]
        if p.path:
            raise T.TypeProblem("a path variable can't stand over a quantified part")
        q = p.rels[at]
        blank = lambda n: A.NodePat(None, n.labels, n.props)

        def both(a: A.NodePat, b: A.NodePat) -> A.NodePat:
            labels = a.labels if b.labels is None else b.labels if a.labels is None else A.LabelExpr("and", [a.labels, b.labels])
            return A.NodePat(a.var or b.var, labels, a.props + b.props)

        out = []
        for times in range(q.low, q.high + 1):
            nodes, rels = p.nodes[: at + 1], list(p.rels[:at])
            for _ in range(times):
                inner = [blank(n) for n in q.inner.nodes]
                nodes = nodes[:-1] + [both(nodes[-1], inner[0])] + inner[1:]
                rels += [replace(r, var=None) for r in q.inner.rels]
            nodes = nodes[:-1] + [both(nodes[-1], p.nodes[at + 1])] + p.nodes[at + 2 :]
            out += self._unrolled(replace(p, nodes=nodes, rels=rels + p.rels[at + 1 :]))
        return out

    def _match(self, rows: Rows, patterns: list[A.Pattern], where: A.Expr | None, reach: bool) -> Rows:
        pending = conjuncts(where)
        rows, pending = self._apply(rows, pending)
        left = list(patterns)
        while left:
            p = next((p for p in left if variables([p.nodes, p.rels]) & set(rows.scope)), left[0])
            left.remove(p)
            rows, pending = self._pattern(rows, p, pending, reach)
            rows, pending = self._apply(rows, pending)
        for e in pending:
            rows = self.filter(rows, e)
        return rows

    def _apply(self, rows: Rows, pending: list[A.Expr]) -> tuple[Rows, list[A.Expr]]:
        """Apply the conditions whose variables are all bound."""
        rest = []
        for e in pending:
            if not has_subquery(e) and variables(e) and self._free(e) <= set(rows.scope):
                rows = rows.where(self.exprs(rows.scope).boolean(e))
            else:
                rest.append(e)
        return rows, rest

    @staticmethod
    def _free(e) -> set[str]:
        """Variables of an expression but those that it binds itself."""
        own = {x.var for x in walk(e) if isinstance(x, (A.ListComp, A.Quantifier, A.Reduce))} | {x.acc for x in walk(e) if isinstance(x, A.Reduce)}
        return variables(e) - own

    def _pattern(self, rows: Rows, p: A.Pattern, pending: list[A.Expr], reach: bool) -> tuple[Rows, list[A.Expr]]:
        if p.selector:
            return self._shortest(rows, p, pending)
        n = len(p.nodes)
        bound = [i for i in range(n) if p.nodes[i].var and p.nodes[i].var in rows.scope]
        shown = self.path_keys(p)
        more = set(shown or ())
        scanned = False
        at: dict[int, NodeB] = {}
        if bound:
            start = bound[0]
            old = rows.scope[p.nodes[start].var]
            at[start] = old if isinstance(old, NodeB) else self._entity_of(old)
            rows = self._check(rows, at[start], p.nodes[start])
        else:
            fixed = lambda e: isinstance(e, A.Lit) or isinstance(e, A.Param)
            anchored = [i for i in (0, n - 1) if any(fixed(e) for _, e in p.nodes[i].props)]
            start = anchored[0] if anchored else 0
            first = p.rels[0] if n > 1 else None
            node = p.nodes[start]
            if start == 0 and rows.unit and first is not None and not first.variable and not node.props and not self._keys("node", node.var, self._tables(node), more):
                at[0] = None  # the edges name it
            else:
                scanned = rows.unit
                scan, at[start] = self._scan(node, more)
                rows = Rows(scan if rows.unit else rows.df.crossJoin(scan), rows.scope | ({node.var: at[start]} if node.var else {}))
                rows = self._props(rows, at[start], node.props)
                rows, pending = self._apply(rows, pending)
        used: list[tuple[str, Column | None, tuple[int, ...]]] = []
        segments: dict[int, object] = {}
        for i in [*range(start, n - 1), *range(start - 1, -1, -1)]:
            right = i >= start
            here, there = (i, i + 1) if right else (i + 1, i)
            rel = p.rels[i]
            direction = rel.direction if right else flipped(rel.direction)
            if rel.variable:
                lone = n == 2 and not p.path and not rel.var and reach and not used
                rows, at[there], segments[i] = self._variable(rows, at[here], rel, direction, p.nodes[there], used, p.restrictor, shown, right, lone, scanned)
            else:
                rows, at[here], at[there], segments[i] = self._hop(rows, at[here], p.nodes[here], rel, direction, p.nodes[there], used, more)
            rows, pending = self._apply(rows, pending)
        if p.path:
            rows = self._bind_path(rows, p, [at[i] for i in range(n)], [segments[i] for i in range(n - 1)], shown or set())
        return rows, pending

    def path_keys(self, p: A.Pattern) -> set[str] | None:
        """Properties that a path's nodes and relationships must show."""
        return set() if p.path else None

    def _hop(self, rows: Rows, near: NodeB | None, near_pat: A.NodePat, rel: A.RelPat, direction: str, far: A.NodePat, used: list, more: set[str]):
        bound_far = far.var in rows.scope and isinstance(rows.scope[far.var], NodeB) if far.var else False
        near_tables = near.tables if near is not None else self._tables(near_pat)
        far_tables = rows.scope[far.var].tables if bound_far else self._tables(far)
        edges, b, a_col, b_col, near_in, far_in = self._edges(rel, direction, near_tables, far_tables, more)
        if near is None:
            tables = tuple(t for t in near_in if t in near_tables)
            rows = Rows(edges, dict(rows.scope))
            if set(tables) != set(near_in):
                rows = rows.where(self._in_tables(F.col(a_col), tables))
            near = NodeB(a_col, tables, {})
            if near_pat.var:
                rows = replace(rows, scope=rows.scope | {near_pat.var: near})
        elif bound_far:
            rows = replace(rows, df=rows.df.join(edges, (F.col(near.id) == F.col(a_col)) & (F.col(rows.scope[far.var].id) == F.col(b_col))))
        else:
            rows = replace(rows, df=rows.df.join(edges, F.col(near.id) == F.col(a_col)))
        if rel.var and rel.var in rows.scope:
            rows = rows.where(F.col(rows.scope[rel.var].id) == F.col(b.id))
        elif rel.var:
            rows = replace(rows, scope=rows.scope | {rel.var: b})
        rows = self._props(rows, b, rel.props)
        rows = self._unlike(rows, F.col(b.id), None, b.tables, used)
        used.append((b.id, None, b.tables))
        rows, there = self._bind_node(rows, b_col, far, far_in, more)
        return rows, near, there, b

    def _unlike(self, rows: Rows, one: Column | None, many: Column | None, tables: tuple[int, ...], used: list) -> Rows:
        """No relationship twice in a pattern."""
        for col, ids, other in used:
            if not set(tables) & set(other):
                continue
            if ids is None:
                rows = rows.where(F.col(col) != one if many is None else ~F.array_contains(many, F.col(col)))
            else:
                rows = rows.where(~F.array_contains(ids, one) if many is None else ~F.arrays_overlap(many, ids))
        return rows

    # variable length
    def _steps(self, rel: A.RelPat, direction: str, start: tuple[int, ...], far: tuple[int, ...], shown: set[str] | None):
        """Edges of any hop of a variable-length pattern, with struct columns."""
        every = tuple(range(len(self.graph.nodes)))
        keys = shown or set()
        edges, b, a, z, _, far_in = self._edges(rel, direction, every, every, set(keys))
        part = self._props(Rows(edges, {}), b, rel.props)
        e = self.exprs({})
        made = e.whole(Val(F.col(b.id), ("rel", e._fields("edge", b)), entity=b))
        kind = ("rel", e._fields("edge", b))
        return part.df.select(F.col(b.id).alias("e"), F.col(a).alias("a"), F.col(z).alias("z"), made.alias("r")), kind, b.tables, far_in

    def _variable(self, rows: Rows, near: NodeB, rel: A.RelPat, direction: str, far: A.NodePat, used: list, restrictor: str | None, shown: set[str] | None, forward: bool, lone: bool, scanned: bool):
        low, high = rel.low, rel.high
        reach = lone and low <= 1 and direction != "both" and restrictor in (None, "WALK", "TRAIL")
        steps, kind, tables, far_in = self._steps(rel, direction, near.tables, self._tables(far), shown)
        want_rels = (rel.var is not None and not reach) or shown is not None
        ids = rows.df.select(F.col(near.id).alias("s")).where("s is not null").distinct()
        if reach:
            found = self._reach(ids, rel, direction, near.tables, self._tables(far), low, high, scanned)
        else:
            found = self._walk(ids, steps, low, high, restrictor or "TRAIL", want_rels, shown)
        cols = {c: self.fresh(c) for c in found.columns}
        found = found.select(*(F.col(c).alias(x) for c, x in cols.items()))
        rows = replace(rows, df=rows.df.join(found, F.col(near.id) == F.col(cols["s"])).drop(cols["s"]))
        rels = nodes = None
        if not reach:
            if restrictor is None or restrictor == "TRAIL":
                rows = self._unlike(rows, None, F.col(cols["es"]), tables, used)
            used.append((cols["es"], F.col(cols["es"]), tables))
        if want_rels:
            rels = F.col(cols["rs"]) if forward else F.reverse(F.col(cols["rs"]))
        if "ns" in cols:
            nodes = F.col(cols["ns"])
        if rel.var and want_rels:
            name = self.fresh(rel.var)
            rows = Rows(rows.df.withColumn(name, rels), rows.scope | {rel.var: ValB(name, T.lst(kind))})
        possible = tuple(sorted({*far_in, *(near.tables if low == 0 else ())}))
        rows, there = self._bind_node(rows, cols["z"], far, possible, set(shown or ()))
        return rows, there, (rels, nodes, kind, forward)

    def _level(self, df: DataFrame, high: int) -> DataFrame:
        return checkpointed(df) if high > LAZY_LEVELS else df

    def _walk(self, ids: DataFrame, steps: DataFrame, low: int, high: int, restrictor: str, want_rels: bool, shown: set[str] | None) -> DataFrame:
        """``s, z, es`` (ids passed), ``rs`` (structs) and ``ns`` (node ids
        after the first) of every walk from the ids."""
        if high < low:
            high = low - 1
        by_nodes = restrictor in ("ACYCLIC", "SIMPLE")
        keep_nodes = by_nodes or shown is not None
        rel_type = steps.schema["r"].dataType
        level = ids.select("s", F.col("s").alias("z"), F.array().cast("array<bigint>").alias("es"), *([F.array().cast(f"array<{rel_type.simpleString()}>").alias("rs")] if want_rels else []), *([F.array("s").alias("ns")] if keep_nodes else []))
        out = [level] if low == 0 else []
        for k in range(1, high + 1):
            going = level if restrictor != "SIMPLE" or k == 1 else level.where("s <> z")
            e = steps.select("e", "a", F.col("z").alias("y"), "r")
            nxt = going.join(e, F.col("z") == F.col("a"))
            if restrictor == "TRAIL":
                nxt = nxt.where(~F.array_contains("es", F.col("e")))
            elif restrictor == "ACYCLIC":
                nxt = nxt.where(~F.array_contains("ns", F.col("y")))
            elif restrictor == "SIMPLE":
                nxt = nxt.where(~F.array_contains("ns", F.col("y")) | (F.col("y") == F.col("s")))
            level = nxt.select("s", F.col("y").alias("z"), F.array_append("es", F.col("e")).alias("es"), *([F.array_append("rs", F.col("r")).alias("rs")] if want_rels else []), *([F.array_append("ns", F.col("y")).alias("ns")] if keep_nodes else []))
            level = self._level(level, high)
            if high > LAZY_LEVELS and level.isEmpty():
                break
            if k >= low:
                out.append(level)
        if not out:
            return level.where(F.lit(False))
        return reduce(DataFrame.unionAll, out)

    def _reach(self, ids: DataFrame, rel: A.RelPat, direction: str, near: tuple[int, ...], far: tuple[int, ...], low: int, high: int, scanned: bool) -> DataFrame:
        """Distinct ``s, z`` within so many hops: what was reached goes no
        further, so levels hold no more rows than there are pairs.

        A hop reads only edge tables that lie on a way from near to far tables
        within the hops left. Where most nodes of the near tables are to start
        and fewer are to be reached, levels grow back from the far end.
        """
        every, near, far = tuple(range(len(self.graph.nodes))), tuple(near), tuple(far)

        def hop(a_in: tuple[int, ...], z_in: tuple[int, ...]):
            edges, b, a, z, from_, to = self._edges(rel, direction, a_in, z_in)
            df = self._props(Rows(edges, {}), b, rel.props).df.select(F.col(a).alias("a"), F.col(z).alias("y"))
            return df, tuple(t for t in from_ if t in a_in), tuple(t for t in to if t in z_in), b.tables

        pruned = high <= PRUNED_LEVELS
        out, back = [near], [far]  # tables so many hops from either end
        for _ in range(high if pruned else 0):
            out.append(hop(out[-1], every)[2])
            back.append(hop(every, back[-1])[1])
        within = lambda sets: tuple(sorted({t for s in sets for t in s}))
        reverse = False
        if scanned and pruned and high > 1:
            last, first = hop(within(out[:high]), far)[0].select("y").distinct().count(), ids.count()
            reverse = last < first and 2 * first >= self.graph.node_frame(near, []).count()

        def ends(k: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
            if not pruned:
                return every, every
            return (within(out[: high - k + 1]), back[k - 1]) if reverse else (out[k - 1], within(back[: high - k + 1]))

        once: dict[tuple[int, ...], DataFrame] = {}  # edges that several hops read
        start = ids.select("s", F.col("s").alias("z"))
        levels, known, level = [start] if low == 0 else [], [near] if low == 0 else [], start
        for k in range(1, high + 1):
            pairs, from_, to, tables = hop(*ends(k))
            if tables not in once and any(hop(*ends(j))[3] == tables for j in range(k + 1, min(high, k + PRUNED_LEVELS) + 1)):
                once[tables] = stored(pairs.distinct(), "pairs")
            pairs, there = once.get(tables, pairs), from_ if reverse else to
            if reverse:
                nxt = pairs.select(F.col("a").alias("s"), F.col("y").alias("z")) if k == 1 else pairs.join(level, F.col("y") == F.col("s")).select(F.col("a").alias("s"), "z")
            else:
                nxt = level.join(pairs, F.col("z") == F.col("a")).select("s", F.col("y").alias("z"))
            level = nxt.distinct()
            before = [x for x, tables in zip(levels, known) if set(tables) & set(there)]
            if before:
                level = level.join(reduce(DataFrame.unionAll, before), ["s", "z"], "left_anti")
            if high > 1:  # each level is read by all that follow
                level = stored(level, "reach")
                if level.isEmpty():
                    break
            levels.append(level)
            known.append(there)
        return reduce(DataFrame.unionAll, levels) if levels else start.where(F.lit(False))

    # shortest paths
    def _shortest(self, rows: Rows, p: A.Pattern, pending: list[A.Expr]) -> tuple[Rows, list[A.Expr]]:
        rel = p.rels[0]
        if len(p.rels) != 1 or isinstance(rel, A.Quantified) or rel.props or p.restrictor:
            raise T.TypeProblem("a shortest path takes one relationship, without properties or restrictor")
        mode, k = p.selector
        low, high = (rel.low, rel.high) if rel.variable else (1, 1)
        if low > 1:
            raise T.TypeProblem("a shortest path begins at 0 or 1 hops")
        bound = [bool(n.var and n.var in rows.scope) for n in p.nodes]
        start = 1 if bound[1] and not bound[0] else 0
        near, far = p.nodes[start], p.nodes[1 - start]
        shown = self.path_keys(p)
        if not bound[start]:
            scan, b = self._scan(near, set(shown or ()))
            rows = Rows(scan if rows.unit else rows.df.crossJoin(scan), rows.scope | ({near.var: b} if near.var else {}))
            rows = self._props(rows, b, near.props)
            rows, pending = self._apply(rows, pending)
        else:
            b = rows.scope[near.var]
            rows = self._check(rows, b, near)
        direction = rel.direction if start == 0 else flipped(rel.direction)
        steps, kind, _, far_in = self._steps(rel, direction, b.tables, self._tables(far), shown)
        want = rel.var is not None or p.path is not None
        pairs = None
        if bound[1 - start]:
            pairs = rows.df.select(F.col(b.id).alias("s"), F.col(rows.scope[far.var].id).alias("z")).where("s is not null and z is not null").distinct()
            ids = pairs.select("s").distinct()
        else:
            ids = rows.df.select(F.col(b.id).alias("s")).where("s is not null").distinct()
        found = self.shortest_paths(ids, steps, low, high, mode, k, want, pairs)
        cols = {c: self.fresh(c) for c in found.columns}
        found = found.select(*(F.col(c).alias(x) for c, x in cols.items()))
        on = F.col(b.id) == F.col(cols["s"])
        if pairs is not None:
            on = on & (F.col(rows.scope[far.var].id) == F.col(cols["z"]))
        rows = replace(rows, df=rows.df.join(found, on).drop(cols["s"]))
        possible = tuple(sorted({*far_in, *(b.tables if low == 0 else ())}))
        rows, there = self._bind_node(rows, cols["z"], far, possible, set(shown or ()))
        forward = start == 0
        rels = None
        if want:
            rels = F.col(cols["rs"]) if forward else F.reverse(F.col(cols["rs"]))
        if rel.var:
            name = self.fresh(rel.var)
            rows = Rows(rows.df.withColumn(name, rels), rows.scope | {rel.var: ValB(name, T.lst(kind))})
        if p.path:
            ends = [b, there] if forward else [there, b]
            rows = self._bind_path(rows, p, ends, [(rels, F.col(cols["ns"]), kind, forward)], shown or set())
        return rows, pending

    def shortest_paths(self, ids: DataFrame, steps: DataFrame, low: int, high: int, mode: str, k: int, want_rels: bool, pairs: DataFrame | None) -> DataFrame:
        """Loopless paths ``s, z, es, rs, ns`` from the ids: breadth first, each
        level checkpointed; a pair that has its shortest goes no further."""
        rel_type = steps.schema["r"].dataType
        level = ids.select("s", F.col("s").alias("z"), F.array().cast("array<bigint>").alias("es"), *([F.array().cast(f"array<{rel_type.simpleString()}>").alias("rs")] if want_rels else []), F.array("s").alias("ns"))
        out = [level] if low == 0 else []
        seen = level.select("s", "z")
        open_pairs = pairs
        for depth in range(1, high + 1):
            e = steps.select("e", "a", F.col("z").alias("y"), "r")
            nxt = level.join(e, F.col("z") == F.col("a")).where(~F.array_contains("ns", F.col("y")))
            nxt = nxt.select("s", F.col("y").alias("z"), F.array_append("es", F.col("e")).alias("es"), *([F.array_append("rs", F.col("r")).alias("rs")] if want_rels else []), F.array_append("ns", F.col("y")).alias("ns"))
            if mode != "k":
                nxt = nxt.join(seen, ["s", "z"], "left_anti")
            if mode == "any":
                rest = [c for c in nxt.columns if c not in ("s", "z")]
                nxt = nxt.groupBy("s", "z").agg(F.min_by(F.struct(*rest), F.col("es")).alias("m")).select("s", "z", *(F.col(f"m.{c}").alias(c) for c in rest))
            level = checkpointed(nxt)
            if level.isEmpty():
                break
            out.append(level)
            if mode != "k":
                seen = checkpointed(seen.unionAll(level.select("s", "z").distinct()))
                if open_pairs is not None:
                    open_pairs = open_pairs.join(seen, ["s", "z"], "left_anti")
                    if open_pairs.isEmpty():
                        break
        if not out:
            return level.where(F.lit(False))
        found = reduce(DataFrame.unionAll, out)
        if mode == "k":
            order = Window.partitionBy("s", "z").orderBy(F.size("es"), "es")
            found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
        return found

    # paths
    def _bind_path(self, rows: Rows, p: A.Pattern, nodes: list[NodeB], segments: list, keys: set[str]) -> Rows:
        """A path's struct: nodes and relationships in the order of the pattern."""
        e = self.exprs(rows.scope)
        types = self.graph.property_types("node")
        known = tuple((k, types[k]) for k in sorted(keys & set(types)))
        node_type, rel_type = ("node", known), ("rel", ())
        for s in segments:
            rel_type = T.unify(rel_type, ("rel", e._fields("edge", s)) if isinstance(s, RelB) else s[2])

        def one(b: NodeB) -> Column:
            part = replace(b, props={k: c for k, c in b.props.items() if k in keys})
            fields = e._fields("node", part)
            return T.convert(e.whole(Val(F.col(b.id), ("node", fields), entity=part)), ("node", fields), node_type)

        node_parts, rel_parts = [F.array(one(nodes[0]))], []
        df = rows.df
        for i, s in enumerate(segments):
            if isinstance(s, RelB):
                t = ("rel", e._fields("edge", s))
                rel_parts.append(F.array(T.convert(e.whole(Val(F.col(s.id), t, entity=s)), t, rel_type)))
            else:
                rels, ids, t, forward = s
                rel_parts.append(T.convert(rels, T.lst(t), T.lst(rel_type)))
                middle = F.slice(ids if forward else F.reverse(ids), 2, F.greatest(F.size(ids) - 2, F.lit(0)))
                if known:
                    df, shown = self._show_nodes(df, middle, known)
                    node_parts.append(shown)
                else:
                    node_parts.append(F.transform(middle, lambda x: F.struct(x.alias("id"), self.graph.labels_of(x).alias("labels"), no_properties().alias("properties"))))
                node_parts.append(F.when(F.size(ids) > 1, F.array(one(nodes[i + 1]))).otherwise(F.array().cast(f"array<{T.ddl(node_type)}>")))
                continue
            node_parts.append(F.array(one(nodes[i + 1])))
        name = self.fresh(p.path)
        listed = lambda parts, t: F.concat(*parts) if parts else F.array().cast(f"array<{T.ddl(t)}>")
        made = F.struct(listed(node_parts, node_type).alias("nodes"), listed(rel_parts, rel_type).alias("rels"))
        return Rows(df.withColumn(name, made), rows.scope | {p.path: ValB(name, ("path", node_type, rel_type))})

    def _show_nodes(self, df: DataFrame, ids: Column, known: tuple) -> tuple[DataFrame, Column]:
        """Node structs with properties for a list of ids: one join over all
        lists of distinct ids, gathered again by list."""
        key, name = self.fresh("ids"), self.fresh("nodes")
        df = df.withColumn(key, ids)
        lists = df.select(F.col(key).alias("k")).distinct()
        keys = [k for k, _ in known]
        frame = self.graph.node_frame(self.graph.node_tables(), keys)
        made = F.struct(F.col("id"), self.graph.labels_of(F.col("id")).alias("labels"), F.struct(*(F.col(f"`{k}`").alias(k) for k in keys)).alias("properties"))
        each = lists.select("k", F.posexplode("k").alias("i", "x")).join(frame, F.col("x") == F.col("id")).select("k", F.struct("i", made.alias("n")).alias("p"))
        back = each.groupBy("k").agg(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["n"]).alias(name))
        out = df.join(back.withColumnRenamed("k", f"{key}_k"), F.col(key) == F.col(f"{key}_k"), "left").drop(f"{key}_k")
        return out, F.coalesce(F.col(name), F.array().cast(f"array<{T.ddl(('node', known))}>"))
