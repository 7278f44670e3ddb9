"""Writes by business key, as transforms from one snapshot to the next.

A statement becomes a frame of operations (one, or a row of ``UNWIND $rows``,
which may be a list or a DataFrame), folded by key in their order: the last
value of a property wins. The frame is then joined to the tables that the
pattern's labels leave. Tables of other labels and types stay as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SHIFT, EdgeTable, NodeTable, PropertyGraph, numbered
from ..plans import ast as A
from ..plans import types as T
from ..plans.compiler import Planner
from ..plans.match import Rows
from ..plans.values import NodeB, Val, ValB
from ..plans.writeparser import SetItem, Write, parse_write
from ..storage import checkpointed, stored


class WriteProblem(ValueError):
    """A write that is refused."""


_HEAD = ("id", "src", "dst")
_MASK = (1 << SHIFT) - 1


def execute(graph: PropertyGraph, statement: str, params: dict) -> tuple[PropertyGraph, DataFrame | None]:
    if re.fullmatch(r"\s*CALL\s+(\w+\.)?consolidate\(\)\s*;?\s*", statement, re.I):
        return consolidated(graph), None
    return Writer(graph, params).run(parse_write(statement))


def consolidated(graph: PropertyGraph) -> PropertyGraph:
    """The same graph with every table written out and read again."""
    return graph.with_version(nodes=tuple(replace(t, df=stored(t.df, "nodes")) for t in graph.nodes), edges=tuple(replace(t, df=stored(t.df, "edges")) for t in graph.edges))


@dataclass
class Patch:
    """What SET items come to: property columns of the operations, and whether
    other properties are cleared."""

    values: dict[str, tuple[Column, object, bool]]  # column, type, whether null leaves the old value
    clear: bool = False


class Writer:
    def __init__(self, graph: PropertyGraph, params: dict):
        self.graph, self.params = graph, params
        self.planner = Planner(graph, {k: v for k, v in params.items() if not isinstance(v, DataFrame)})

    # operations
    def operations(self, w: Write) -> tuple[DataFrame, dict]:
        spark = self.graph.spark
        if w.unwind is None:
            return spark.range(1).select(F.col("id").alias("ordinal")), {}
        source = w.unwind.source
        if isinstance(source, A.Param) and isinstance(self.params.get(source.name), DataFrame):
            df = self.params[source.name]
            row = F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns))
            df = stored(df.select(row.alias("row")), "ops")
            return numbered(df, "ordinal"), {w.unwind.var: ValB("row", T.of_spark(df.schema["row"].dataType))}
        v = self.planner.exprs({})(source)
        if T.kind(v.type) != "list" or not isinstance(v.value, list):
            raise WriteProblem("UNWIND in a write takes a list")
        df = spark.range(1).select(F.posexplode(v.col).alias("ordinal", "row")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
        return df, {w.unwind.var: ValB("row", v.type[1])}

    def patch(self, items: list[SetItem], exprs, var: str | None, skip: set[str] = frozenset()) -> Patch:
        out = Patch({})
        for item in items:
            if item.var != var or item.kind in ("label", "unlabel"):
                continue
            if item.kind == "unset":
                if item.key in skip:
                    raise WriteProblem(f"the key {item.key} can't be removed")
                out.values[item.key] = (F.lit(None), T.NULL, False)
                continue
            v: Val = exprs(item.value)
            if item.kind == "prop":
                if item.key in skip:
                    raise WriteProblem(f"the key {item.key} can't be set")
                out.values[item.key] = (v.col, v.type, False)
                continue
            if T.kind(v.type) != "map":
                raise WriteProblem("SET takes a map here")
            if item.kind == "replace":
                out.values, out.clear = {}, True
            for k, t in v.type[1]:
                if k not in skip:
                    out.values[k] = (v.col[k], t, t != T.NULL and item.kind == "merge")
        return out

    @staticmethod
    def labels(p: A.NodePat) -> tuple[str, ...]:
        def names(e) -> list[str]:
            if e is None:
                return []
            if e.op == "name":
                return [e.args[0]]
            if e.op == "and":
                return [n for a in e.args for n in names(a)]
            raise WriteProblem("a write names labels without | and !")

        return tuple(names(p.labels))

    def key_of(self, p: A.NodePat) -> tuple[str, str]:
        """(label, key property) of a node pattern: the property with a range index."""
        labels = self.labels(p)
        known = {x for t in self.graph.nodes for x in t.labels}
        for name in labels:
            if name not in known:
                raise WriteProblem(f"unknown label {name}")
        for name in labels:
            for k, _ in p.props:
                if self.graph.index("range", "node", name, k):
                    return name, k
        raise WriteProblem("a write names a node by a property with a range index")

    # nodes
    def resolve(self, ops: DataFrame, exprs, p: A.NodePat, into: str) -> DataFrame:
        """``ops`` with the key (``into``_key) and the id, null if absent."""
        name, key = self.key_of(p)
        v = exprs(dict(p.props)[key])
        tables = self.graph.node_tables(lambda labels: name in labels)
        kind = self.graph.property_types("node", tables).get(key, v.type)
        if v.type != kind and not (T.numeric(v.type) and T.numeric(kind)):
            raise WriteProblem(f"the key {key} is of another type")
        ops = ops.withColumn(f"{into}_key", T.convert(v.col, v.type, kind) if v.type != kind else v.col)
        nodes = self.graph.node_frame(tables, [key]).select(F.col("id").alias(f"{into}_id"), F.col(f"`{key}`").alias("__k"))
        wanted = nodes.join(ops.select(F.col(f"{into}_key").alias("__k")).distinct(), "__k", "left_semi")
        found = checkpointed(wanted)
        if not found.groupBy("__k").count().where("count > 1").isEmpty():
            raise WriteProblem(f"more than one {name} has the same {key}")
        if not ops.where(F.col(f"{into}_key").isNull()).isEmpty():
            raise WriteProblem(f"the key {key} is null")
        return ops.join(found, F.col(f"{into}_key") == F.col("__k"), "left").drop("__k")

    def run(self, w: Write) -> tuple[PropertyGraph, DataFrame | None]:
        ops, scope = self.operations(w)
        exprs = self.planner.exprs(scope)
        if w.rel is None:
            graph = self.node_write(w, ops, exprs)
        else:
            graph = self.edge_write(w, ops, exprs)
        result = self.returned(w, graph, ops, scope) if w.returns is not None else None
        return graph, result

    def node_write(self, w: Write, ops: DataFrame, exprs) -> PropertyGraph:
        p = w.nodes[0]
        name, key = self.key_of(p)
        ops = checkpointed(self.resolve(ops, exprs, p, "n"))
        if w.mode == "match" and not ops.where("n_id is null").isEmpty():
            raise WriteProblem(f"no {name} has this {key}: use MERGE to create it")
        if w.delete:
            return self.delete_nodes(ops.select(F.col("n_id").alias("id")).distinct(), w.detach)
        inline = [SetItem("prop", p.var or "", k, e) for k, e in p.props if k != key]
        for item in [*w.sets, *w.on_create, *w.on_match]:
            if item.var != p.var:
                raise WriteProblem(f"{item.var} is not bound")
        always = inline + w.sets
        changed = self.patch(w.on_match + (always if w.mode != "create" else inline + w.sets), exprs, p.var, {key})
        created = self.patch(inline + w.on_create + w.sets, exprs, p.var, {key})
        graph = self.graph
        if w.mode != "match":
            graph = self.create_nodes(graph, ops.where("n_id is null"), p, key, created)
        graph = self.patch_nodes(graph, ops.where("n_id is not null"), key, changed)
        add = [i.key for i in [*w.sets, *w.on_create, *w.on_match] if i.kind == "label"]
        drop = [i.key for i in w.sets if i.kind == "unlabel"]
        if add or drop:
            known = {x for t in graph.nodes for x in t.labels}
            if set(add) - known:
                raise WriteProblem(f"unknown label {', '.join(sorted(set(add) - known))}")
            tables = graph.node_tables(lambda labels: name in labels)
            frame = graph.node_frame(tables, [key])
            ids = frame.join(ops.select(F.col("n_key").alias("__k")).distinct(), F.col(f"`{key}`") == F.col("__k"), "left_semi").select("id")
            graph = self.relabel(graph, checkpointed(ids), add, drop)
        return graph

    @staticmethod
    def folded(ops: DataFrame, by: str, patch: Patch) -> DataFrame:
        """A row a key: the last value of each property."""
        aggs = []
        for k, (c, _, keeps) in patch.values.items():
            if keeps:
                aggs.append(F.max_by(F.when(c.isNotNull(), F.struct(c.alias("v"))), F.when(c.isNotNull(), F.col("ordinal"))).alias(f"p_{k}"))
            else:
                aggs.append(F.max_by(F.struct(c.alias("v")), "ordinal").alias(f"p_{k}"))
        return ops.groupBy(by).agg(F.lit(True).alias("p__there"), *aggs)

    def patch_nodes(self, graph: PropertyGraph, ops: DataFrame, key: str, patch: Patch) -> PropertyGraph:
        if not patch.values and not patch.clear or ops.isEmpty():
            return graph
        wide = checkpointed(self.folded(ops.withColumnRenamed("n_id", "__id"), "__id", patch))
        touched = {r[0] for r in wide.select(F.shiftright("__id", SHIFT).cast("int")).distinct().collect()}  # at most a row a table
        return graph.with_version(nodes=tuple(replace(t, df=self.patched(t.df, wide, patch, {key})) if i in touched else t for i, t in enumerate(graph.nodes)))

    @staticmethod
    def patched(df: DataFrame, wide: DataFrame, patch: Patch, keep: set[str]) -> DataFrame:
        joined = df.join(wide, df["id"] == wide["__id"], "left")
        out = [F.col(h) for h in _HEAD if h in df.columns]
        for name in [c for c in df.columns if c not in _HEAD] + [k for k in patch.values if k not in df.columns]:
            have = T.of_spark(df.schema[name].dataType) if name in df.columns else T.NULL
            old = F.col(f"`{name}`") if name in df.columns else F.lit(None)
            if name in patch.values:
                _, t, keeps = patch.values[name]
                kind = T.unify(have, t)
                if kind == T.NULL:
                    continue
                new = T.convert(F.col(f"`p_{name}`")["v"], t, kind).cast(T.ddl(kind))
                was = T.convert(old, have, kind).cast(T.ddl(kind))
                base = F.when(F.col("p__there"), F.lit(None).cast(T.ddl(kind))).otherwise(was) if patch.clear else was
                out.append(F.when(F.col(f"`p_{name}`").isNotNull(), new).otherwise(base).alias(name))
            elif patch.clear and name not in keep:
                out.append(F.when(F.col("p__there"), F.lit(None)).otherwise(old).alias(name))
            else:
                out.append(old.alias(name))
        return joined.select(*out)

    def create_nodes(self, graph: PropertyGraph, ops: DataFrame, p: A.NodePat, key: str, patch: Patch, side: str = "n") -> PropertyGraph:
        if ops.isEmpty():
            return graph
        labels = tuple(sorted(set(self.labels(p))))
        at = next((i for i, t in enumerate(graph.nodes) if tuple(sorted(t.labels)) == labels), None)
        nodes = list(graph.nodes)
        if at is None:
            at = len(nodes)
            nodes.append(NodeTable(labels, graph.spark.createDataFrame([], "id bigint"), key))
        new = self.folded(ops, f"{side}_key", patch)
        cols = [F.col(f"{side}_key").alias(key)]
        for k, (_, t, _) in patch.values.items():
            if t != T.NULL:
                cols.append(F.col(f"`p_{k}`")["v"].alias(k))
        table = nodes[at].df
        last = table.agg(F.max(F.col("id").bitwiseAND(F.lit(_MASK)))).first()[0]
        made = numbered(stored(new.select(*cols), "created"))
        made = made.withColumn("id", F.lit(at << SHIFT) + F.col("__n") + F.lit(-1 if last is None else last) + 1).drop("__n")
        nodes[at] = replace(nodes[at], df=aligned([table, made], ["id"]))
        return graph.with_version(nodes=tuple(nodes))

    def delete_nodes(self, ids: DataFrame, detach: bool) -> PropertyGraph:
        g, ids = self.graph, checkpointed(ids)
        if not detach:
            ends = g.edge_frame(g.edge_tables(), []).select(F.explode(F.array("src", "dst")).alias("id"))
            if not ends.join(ids, "id", "left_semi").isEmpty():
                raise WriteProblem("the node has relationships: use DETACH DELETE")
        nodes = tuple(replace(t, df=t.df.join(ids, "id", "left_anti")) for t in g.nodes)
        edges = g.edges
        if detach:
            gone = lambda end: ids.withColumnRenamed("id", end)
            edges = tuple(replace(t, df=t.df.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select(*t.df.columns)) for t in g.edges)
        return g.with_version(nodes=nodes, edges=edges)

    def relabel(self, g: PropertyGraph, ids: DataFrame, add: list[str], drop: list[str]) -> PropertyGraph:
        """Move nodes to the tables of their new labels; edges follow."""
        tables = [r[0] for r in ids.select(F.shiftright("id", SHIFT).cast("int")).distinct().collect()]  # at most a row a table
        nodes, moves, widened = list(g.nodes), [], {}
        for i in tables:
            labels = tuple(sorted((set(g.nodes[i].labels) | set(add)) - set(drop)))
            if labels == tuple(sorted(g.nodes[i].labels)):
                continue
            to = next((j for j, t in enumerate(nodes) if tuple(sorted(t.labels)) == labels), None)
            if to is None:
                to = len(nodes)
                nodes.append(NodeTable(labels, g.spark.createDataFrame([], "id bigint"), g.nodes[i].key))
            rows = numbered(stored(nodes[i].df.join(ids, "id", "left_semi"), "moved"))
            last = nodes[to].df.agg(F.max(F.col("id").bitwiseAND(F.lit(_MASK)))).first()[0]
            rows = rows.withColumn("__new", F.lit(to << SHIFT) + F.col("__n") + F.lit(-1 if last is None else last) + 1)
            moves.append(rows.select(F.col("id").alias("__old"), "__new"))
            nodes[i] = replace(nodes[i], df=nodes[i].df.join(ids, "id", "left_anti"))
            nodes[to] = replace(nodes[to], df=aligned([nodes[to].df, rows.drop("id", "__n").withColumnRenamed("__new", "id")], ["id"]))
            widened.setdefault(i, set()).add(to)
        if not moves:
            return g
        moved = reduce(DataFrame.unionAll, moves)
        edges = []
        for t in g.edges:
            df = t.df
            for end in ("src", "dst"):
                there = getattr(t, end)
                if there is None or set(there) & set(widened):
                    df = df.join(moved, F.col(end) == F.col("__old"), "left").withColumn(end, F.coalesce("__new", end)).drop("__old", "__new")
            wide = lambda there: None if there is None else tuple(sorted({*there, *(j for i in there for j in widened.get(i, ()))}))
            edges.append(replace(t, df=df.select(*t.df.columns), src=wide(t.src), dst=wide(t.dst)))
        return g.with_version(nodes=tuple(nodes), edges=tuple(edges))

    # relationships
    def edge_write(self, w: Write, ops: DataFrame, exprs) -> PropertyGraph:
        g, rel = self.graph, w.rel
        a, b = w.nodes if rel.direction == "out" else w.nodes[::-1]
        if rel.types is None or rel.types.op != "name":
            raise WriteProblem("a relationship is written with one type")
        kind = rel.types.args[0]
        at = next((i for i, t in enumerate(g.edges) if t.type == kind), None)
        if at is None:
            raise WriteProblem(f"unknown relationship type {kind}")
        if len(rel.props) > 1:
            raise WriteProblem("one property at most names a relationship")
        for item in w.sets + w.on_create + w.on_match:
            if rel.props and item.var == rel.var and item.key == rel.props[0][0]:
                raise WriteProblem("the property that names a relationship can't be set")
        ops = checkpointed(self.resolve(self.resolve(ops, exprs, a, "a"), exprs, b, "b"))
        if w.mode in ("match", "link") and not ops.where("a_id is null or b_id is null").isEmpty():
            raise WriteProblem("an end of the relationship doesn't exist")
        if w.mode in ("merge", "create"):
            for p, side in ((a, "a"), (b, "b")):
                key = self.key_of(p)[1]
                extra = self.patch([SetItem("prop", p.var or "", k, e) for k, e in p.props if k != key], exprs, p.var or "", {key})
                g = self.create_nodes(g, ops.where(f"{side}_id is null"), p, key, extra, side)
            self.graph, self.planner.graph = g, g
            ops = checkpointed(self.resolve(self.resolve(ops.drop("a_id", "b_id", "a_key", "b_key"), exprs, a, "a"), exprs, b, "b"))
        pair = ["a_id", "b_id"]
        if w.mode == "match":
            if rel.props:
                raise WriteProblem("a relationship is deleted or changed by its ends and type alone")
            pairs = ops.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")).distinct()
            if w.delete:
                if w.delete != rel.var:
                    raise WriteProblem(f"{w.delete} is not the relationship")
                return g.with_version(edges=tuple(replace(t, df=t.df.join(pairs, ["src", "dst"], "left_anti").select(*t.df.columns)) if t.type == kind else t for t in g.edges))
        identity = list(pair)
        if rel.props:
            k, e = rel.props[0]
            v = exprs(e)
            ops = ops.withColumn("__ident", v.col)
            identity.append("__ident")
        tables = [i for i, t in enumerate(g.edges) if t.type == kind]
        edges = list(g.edges)
        there = None
        for i in tables:
            df = edges[i].df
            if rel.props and rel.props[0][0] not in df.columns:
                continue
            ident = [F.col("src").alias("a_id"), F.col("dst").alias("b_id"), *([F.col(f"`{rel.props[0][0]}`").alias("__ident")] if rel.props else [])]
            part = df.select(F.col("id").alias("e_id"), *ident)
            there = part if there is None else there.unionAll(part)
        seen = ops.select(*identity).distinct()
        found = checkpointed(there.join(seen, identity, "left_semi")) if there is not None else None
        ops = checkpointed(ops.join(found, identity, "left")) if found is not None else ops.withColumn("e_id", F.lit(None).cast("bigint"))
        if w.mode == "match" and not ops.where("e_id is null").isEmpty():
            raise WriteProblem(f"no {kind} between these nodes")
        changed = self.patch(w.on_match + w.sets, exprs, rel.var)
        created = self.patch(w.on_create + w.sets, exprs, rel.var)
        old = ops.where("e_id is not null")
        if (changed.values or changed.clear) and not old.isEmpty():
            wide = checkpointed(self.folded(old.withColumnRenamed("e_id", "__id"), "__id", changed))
            keep = {rel.props[0][0]} if rel.props else set()
            for i in tables:
                edges[i] = replace(edges[i], df=self.patched(edges[i].df, wide, changed, keep))
        new = ops.where("e_id is null")
        if w.mode != "match" and not new.isEmpty():
            if rel.props:
                created.values[rel.props[0][0]] = (F.col("__ident"), exprs(rel.props[0][1]).type, False)
            by = F.struct(*identity)
            rows = self.folded(new.withColumn("__by", by), "__by", created)
            cols = [F.col("__by.a_id").alias("src"), F.col("__by.b_id").alias("dst"), *(F.col(f"`p_{k}`")["v"].alias(k) for k, (_, t, _) in created.values.items() if t != T.NULL)]
            made = numbered(stored(rows.select(*cols), "edges"))
            last = edges[at].df.agg(F.max(F.col("id").bitwiseAND(F.lit(_MASK)))).first()[0]
            made = made.withColumn("id", F.lit(at << SHIFT) + F.col("__n") + F.lit(-1 if last is None else last) + 1).drop("__n")
            tables_of = lambda p: g.node_tables(lambda labels: set(self.labels(p)) <= labels)
            wide_to = lambda have, p: None if have is None else tuple(sorted({*have, *tables_of(p)}))
            t = edges[at]
            edges[at] = EdgeTable(t.type, aligned([t.df, made], list(_HEAD)), wide_to(t.src, a), wide_to(t.dst, b))
        return g.with_version(edges=tuple(edges))

    # RETURN
    def returned(self, w: Write, graph: PropertyGraph, ops: DataFrame, scope: dict) -> DataFrame:
        """A row an operation, in their order, over the new snapshot."""
        planner = Planner(graph, self.planner.params)
        planner._demand = type(planner._demand).of(A.Query([[A.Return(w.returns)]], []))
        rows = Rows(ops.withColumn("_ordinal", F.col("ordinal")), dict(scope))
        for p in w.nodes:
            if not p.var or w.delete == p.var:
                continue
            name, key = self.key_of(p)
            tables = graph.node_tables(lambda labels: name in labels)
            keys = sorted({*planner._keys("node", p.var, tables), key})
            cols, nid = {k: planner.fresh(k) for k in keys}, planner.fresh(p.var)
            frame = graph.node_frame(tables, keys).select(F.col("id").alias(nid), *(F.col(f"`{k}`").alias(c) for k, c in cols.items()))
            v = planner.exprs(scope)(dict(p.props)[key])
            rows = Rows(rows.df.join(frame, v.col == F.col(cols[key])), rows.scope | {p.var: NodeB(nid, tables, cols)})
        if w.rel is not None and w.rel.var and all(p.var for p in w.nodes) and not w.delete:
            rows, _ = planner._pattern(rows, A.Pattern(w.nodes, [replace(w.rel, props=[])]), [], False)
        planner._outer = ["_ordinal"]
        out = planner.values(planner.project(rows, w.returns))
        planner._outer = []
        return out.df.orderBy("_ordinal").select(*(F.col(b.column).cast("string").alias(n) if b.type == T.NULL else F.col(b.column).alias(n) for n, b in out.scope.items()))


def aligned(frames: list[DataFrame], head: list[str]) -> DataFrame:
    """Union by name, with types that hold both."""
    kinds: dict[str, object] = {}
    for df in frames:
        for f in df.schema.fields:
            if f.name not in head:
                kinds[f.name] = T.unify(kinds.get(f.name, T.NULL), T.of_spark(f.dataType))
    parts = []
    for df in frames:
        cols = [F.col(h) for h in head]
        for k, t in kinds.items():
            cols.append((T.convert(F.col(f"`{k}`"), T.of_spark(df.schema[k].dataType), t).cast(T.ddl(t)) if k in df.columns else F.lit(None).cast(T.ddl(t))).alias(k))
        parts.append(df.select(*cols))
    return reduce(DataFrame.unionAll, parts)

