"""CALL: procedures that yield rows."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ast as A
from ..plans import types as T
from ..plans.match import Rows
from ..plans.values import NodeB, RelB, Val, ValB
from . import algorithms, fulltext, introspect, knn

#: By lower-case name: outputs (name, kind) and the arguments' names.
SIGNATURES: dict[str, tuple[str, tuple[tuple[str, object], ...], tuple[str, ...]]] = {
    "db.idx.vector.querynodes": ("db.idx.vector.queryNodes", (("node", "node"), ("score", T.FLOAT)), ("label", "attribute", "k", "query")),
    "db.idx.fulltext.querynodes": ("db.idx.fulltext.queryNodes", (("node", "node"), ("score", T.FLOAT)), ("label", "query")),
    "db.idx.fulltext.queryrelationships": ("db.idx.fulltext.queryRelationships", (("relationship", "rel"), ("score", T.FLOAT)), ("type", "query")),
    "algo.bfs": ("algo.BFS", (("nodes", "nodes"), ("edges", "edges")), ("source", "maxLevel", "relationshipType")),
    "algo.wcc": ("algo.WCC", (("node", "node"), ("componentId", T.INT)), ("config",)),
    "algo.pagerank": ("algo.pageRank", (("node", "node"), ("score", T.FLOAT)), ("label", "relationshipType")),
    "algo.harmoniccentrality": ("algo.HarmonicCentrality", (("node", "node"), ("score", T.FLOAT), ("reachable", T.INT)), ("config",)),
    "algo.betweenness": ("algo.betweenness", (("node", "node"), ("score", T.FLOAT)), ("config",)),
    "algo.labelpropagation": ("algo.labelPropagation", (("node", "node"), ("communityId", T.INT)), ("config",)),
}


def call(planner, rows: Rows, c: A.CallProc) -> Rows:
    name = c.name.lower()
    if name in SIGNATURES:
        found, outputs, keys = _special(planner, rows, name, c.args or [])
    else:
        df = introspect.procedure(planner.graph, name)
        if df is None:
            raise T.TypeProblem(f"unknown procedure {c.name}()")
        cols = {f.name: planner.fresh(f.name) for f in df.schema.fields}
        outputs = {f.name: ValB(cols[f.name], T.of_spark(f.dataType)) for f in df.schema.fields}
        found, keys = df.select(*(F.col(f"`{n}`").alias(x) for n, x in cols.items())), {}
    wanted = c.yields if c.yields is not None else [(n, n) for n in outputs]
    by = {n.lower(): n for n in outputs}
    scope = {}
    for n, alias in wanted:
        if n.lower() not in by:
            raise T.TypeProblem(f"{c.name}() yields no {n}")
        if alias in rows.scope:
            raise T.TypeProblem(f"{alias} is bound already")
        scope[alias] = outputs[by[n.lower()]]
    for alias, b in list(scope.items()):
        if isinstance(b, (NodeB, RelB)):
            found, scope[alias] = _shown(planner, found, b, alias)
    on = reduce(lambda a, b: a & b, (F.col(mine).eqNullSafe(F.col(k)) for mine, k in keys.items()), F.lit(True))
    if rows.unit and not keys:
        df = found
    else:
        df = (rows.df.join(found, on) if keys else rows.df.crossJoin(found)).drop(*keys.values())
    out = Rows(df, rows.scope | scope)
    return planner.filter(out, c.where) if c.where is not None else out


def _shown(planner, df: DataFrame, b, var: str):
    """Join the properties that the query asks of a yielded entity."""
    entity = "node" if isinstance(b, NodeB) else "edge"
    keys = planner._keys(entity, var, b.tables)
    if not keys:
        return df, b
    cols, key = {k: planner.fresh(k) for k in keys}, planner.fresh("id")
    frame = planner.graph.node_frame(b.tables, keys) if entity == "node" else planner.graph.edge_frame(b.tables, keys)
    frame = frame.select(F.col("id").alias(key), *(F.col(f"`{k}`").alias(x) for k, x in cols.items()))
    return df.join(frame, F.col(b.id) == F.col(key)).drop(key), replace(b, props=cols)


def _text(v: Val, what: str, optional: bool = False) -> str | None:
    if optional and v.type == T.NULL:
        return None
    if not isinstance(v.value, str):
        raise T.TypeProblem(f"{what} must be a literal string")
    return v.value


def _view(planner, config: Val | None, known: tuple[str, ...] = ()):
    """Nodes and edges that a configuration map selects."""
    g = planner.graph
    settings = {}
    if config is not None and config.type != T.NULL:
        if not isinstance(config.value, dict):
            raise T.TypeProblem("the configuration must be a literal map")
        settings = config.value
    for k in settings:
        if k not in ("nodeLabels", "relationshipTypes", *known):
            raise T.TypeProblem(f"unknown configuration key {k}")
    labels, types = settings.get("nodeLabels"), settings.get("relationshipTypes")
    nodes = g.node_tables(lambda has: labels is None or bool(has & set(labels)))
    edges = [i for i in g.edge_tables(lambda has: types is None or bool(has & set(types))) if all(end is None or set(end) & set(nodes) for end in (g.edges[i].src, g.edges[i].dst))]
    ends = [tuple(t for t in nodes if any(end is None or t in end for end in (getattr(g.edges[i], side) for i in edges))) for side in ("src", "dst")]
    return nodes, g.node_frame(nodes, []), algorithms.view(g.edge_frame(tuple(edges), []), *(g.node_frame(tables, []) for tables in ends)), settings


def _special(planner, rows: Rows, name: str, args: list[A.Expr]):
    g = planner.graph
    rows, args = planner.lift(rows, args)
    e = planner.exprs(rows.scope)
    values = [e.value(x) for x in args]
    if len(values) > len(SIGNATURES[name][2]):
        raise T.TypeProblem(f"{SIGNATURES[name][0]}() takes {len(SIGNATURES[name][2])} arguments")
    node, score, key = planner.fresh("node"), planner.fresh("score"), planner.fresh("q")
    if name == "db.idx.vector.querynodes":
        label, prop = _text(values[0], "the label"), _text(values[1], "the attribute")
        index = g.index("vector", "node", label, prop)
        if index is None:
            raise T.TypeProblem(f"no vector index on ({label}, {prop})")
        k, q = values[2], values[3]
        if k.type != T.INT or not k.literal or k.value < 0:
            raise T.TypeProblem("k must be a constant that is not negative")
        if q.type != T.VEC:
            raise T.TypeProblem("the query must be a vector")
        tables = g.node_tables(lambda labels: label in labels)
        outputs = {"node": NodeB(node, tables), "score": ValB(score, T.FLOAT)}
        if not any(isinstance(x, A.Var) for x in _walk(args[3])):
            found = knn.nearest_one(g, index, k.value, q.col)
            return found.select(F.col("id").alias(node), F.col("score").alias(score)), outputs, {}
        mine = planner.fresh("q")
        asked = rows.df.select(q.col.alias("q")).where("q is not null").distinct()
        found = knn.nearest_each(g, index, k.value, asked).select(F.col("q").alias(key), F.col("id").alias(node), F.col("score").alias(score))
        raise_if = rows.df.select("*", q.col.alias(mine))
        found = raise_if.select(*_ids(rows), mine).join(found, F.col(mine) == F.col(key)).drop(mine, key)
        return _keyed(planner, rows, found, outputs)
    if name.startswith("db.idx.fulltext"):
        label, query = _text(values[0], "the label"), _text(values[1], "the query")
        entity = "node" if name.endswith("nodes") else "relationship"
        index = g.index("fulltext", entity, label)
        if index is None:
            raise T.TypeProblem(f"no full-text index on {label}")
        found = fulltext.search(g, index, query)
        if entity == "node":
            tables = g.node_tables(lambda labels: label in labels)
            return found.select(F.col("id").alias(node), F.col("score").alias(score)), {"node": NodeB(node, tables), "score": ValB(score, T.FLOAT)}, {}
        tables = g.edge_tables(lambda types: label in types)
        src, dst = planner.fresh("src"), planner.fresh("dst")
        ends = g.edge_frame(tables, []).select(F.col("id").alias(key), F.col("src").alias(src), F.col("dst").alias(dst))
        made = found.select(F.col("id").alias(node), F.col("score").alias(score)).join(ends, F.col(node) == F.col(key)).drop(key)
        return made, {"relationship": RelB(node, src, dst, tables), "score": ValB(score, T.FLOAT)}, {}
    if name == "algo.bfs":
        return _bfs(planner, rows, args, values)
    if name == "algo.pagerank":
        label = _text(values[0], "the label", True) if values else None
        kind = _text(values[1], "the type", True) if len(values) > 1 else None
        config = {k: [v] for k, v in (("nodeLabels", label), ("relationshipTypes", kind)) if v is not None}
        from ..plans.values import lit

        tables, nodes, edges, _ = _view(planner, lit(config))
        found = algorithms.pagerank(nodes, edges)
        return found.select(F.col("id").alias(node), F.col("score").alias(score)), {"node": NodeB(node, tables), "score": ValB(score, T.FLOAT)}, {}
    config = values[0] if values else None
    extra = {"algo.betweenness": ("samplingSize", "samplingSeed"), "algo.labelpropagation": ("maxIterations",)}.get(name, ())
    tables, nodes, edges, settings = _view(planner, config, extra)
    if name == "algo.wcc":
        found = algorithms.components(nodes, edges)
    elif name == "algo.harmoniccentrality":
        found = algorithms.harmonic(nodes, edges)
    elif name == "algo.betweenness":
        found = algorithms.betweenness(nodes, edges)
    else:
        found = algorithms.label_propagation(nodes, edges, int(settings.get("maxIterations", 10)))
    outputs, cols = {}, []
    for (out, kind), c in zip(SIGNATURES[name][1], found.columns):
        x = planner.fresh(out)
        cols.append(F.col(c).alias(x))
        outputs[out] = NodeB(x, tables) if kind == "node" else ValB(x, kind)
    return found.select(*cols), outputs, {}


def _ids(rows: Rows) -> list[str]:
    return list(dict.fromkeys(b.column if isinstance(b, ValB) else b.id for b in rows.scope.values()))


def _keyed(planner, rows: Rows, found: DataFrame, outputs: dict):
    """Results by the distinct bindings that they were found for."""
    ids = _ids(rows)
    fresh = {c: planner.fresh("k") for c in ids}
    out = [c for c in found.columns if c not in ids]
    return found.dropDuplicates([*ids, *out]).select(*(F.col(c).alias(k) for c, k in fresh.items()), *out), outputs, fresh


def _walk(e):
    from ..plans.expressions import walk

    return walk(e)


def _bfs(planner, rows: Rows, args, values):
    """One row a source: the nodes reached and the tree edges, level by level;
    no row where nothing is reached."""
    g = planner.graph
    v = planner.exprs(rows.scope)(args[0])
    outputs_of = lambda a, b, x, y: {"nodes": ValB(a, T.lst(x)), "edges": ValB(b, T.lst(y))}
    level = values[1].value if len(values) > 1 and values[1].type == T.INT and values[1].literal else 0
    kind = _text(values[2], "the type", True) if len(values) > 2 else None
    if T.kind(v.type) not in ("node", T.NULL):
        raise T.TypeProblem("algo.BFS() starts from a node")
    tables = g.edge_tables(lambda types: kind is None or kind in types)
    keys = planner._demand.keys if not planner._demand.whole else set(g.property_types("node"))
    known = tuple((k, t) for k, t in sorted(g.property_types("node").items()) if k in keys)
    node_type, edge_type = ("node", known), ("rel", ())
    a, b, key = planner.fresh("nodes"), planner.fresh("edges"), planner.fresh("k")
    if v.type == T.NULL:
        empty = g.spark.createDataFrame([], f"`{a}` {T.ddl(T.lst(node_type))}, `{b}` {T.ddl(T.lst(edge_type))}")
        return empty, outputs_of(a, b, node_type, edge_type), {}
    from ..plans.expressions import identity, no_properties

    at = identity(v)
    source = rows.df.select(at.alias("s")).where("s is not null").distinct()
    edges = g.edge_frame(tables, [])
    found = algorithms.bfs(edges, source, level)
    frame = g.node_frame(g.node_tables(), [k for k, _ in known])
    props = F.struct(*(F.col(f"`{k}`").alias(k) for k, _ in known)) if known else no_properties()
    shown = frame.select(F.col("id").alias("node"), F.struct("id", g.labels_of(F.col("id")).alias("labels"), props.alias("properties")).alias("n"))
    ends = edges.select(F.col("id").alias("edge"), F.struct("id", "src", "dst", g.type_of(F.col("id")).alias("type"), no_properties().alias("properties")).alias("r"))
    full = found.join(shown, "node").join(ends, "edge").select("s", F.struct("level", "node", "n", "r").alias("p"))
    lists = full.groupBy("s").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    out = lists.select(F.col("s").alias(key), F.transform("ps", lambda p: p["n"]).alias(a), F.transform("ps", lambda p: p["r"]).alias(b))
    head = v.entity.id if v.entity is not None else None
    if head is None:
        raise T.TypeProblem("algo.BFS() starts from a bound node")
    return out, outputs_of(a, b, node_type, edge_type), {head: key}
