"""Catalog procedures and SHOW commands."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as library
from ..model import PropertyGraph


def _frame(graph: PropertyGraph, rows: list, schema: str) -> DataFrame:
    return graph.spark.createDataFrame(rows, schema)


def labels(g: PropertyGraph) -> list[str]:
    return sorted({x for t in g.nodes for x in t.labels})


def types(g: PropertyGraph) -> list[str]:
    return sorted({t.type for t in g.edges})


def keys(g: PropertyGraph) -> list[str]:
    return sorted(set(g.property_types("node")) | set(g.property_types("edge")))


def stats(g: PropertyGraph) -> DataFrame:
    """One row of counts; tables are counted side by side."""
    parts = None
    for entity, tables in (("node", g.nodes), ("edge", g.edges)):
        for i, t in enumerate(tables):
            names = list(t.labels) if entity == "node" else [t.type]
            one = t.df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(entity).alias("entity"), F.array(*map(F.lit, names)).cast("array<string>").alias("names"), "n")
            parts = one if parts is None else parts.unionAll(one)
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("entity") == kind, F.col("n"))), F.lit(0)).cast("bigint")
    count = lambda kind, name: F.coalesce(F.sum(F.when((F.col("entity") == kind) & F.array_contains("names", name), F.col("n"))), F.lit(0)).cast("bigint")
    none = F.struct(F.lit(None).cast("string").alias("_"))
    return parts.agg(
        total("node").alias("nodeCount"), total("edge").alias("relCount"), F.lit(len(labels(g))).cast("bigint").alias("labelCount"), F.lit(len(types(g))).cast("bigint").alias("relTypeCount"), F.lit(len(keys(g))).cast("bigint").alias("propertyKeyCount"),
        (F.struct(*(count("node", x).alias(x) for x in labels(g))) if labels(g) else none).alias("labels"),
        (F.struct(*(count("edge", x).alias(x) for x in types(g))) if types(g) else none).alias("relTypes"),
    )


def indexes(g: PropertyGraph) -> DataFrame:
    rows = [(x.kind, x.entity, x.label, list(x.properties), x.metric if x.kind == "vector" else None, x.dimension) for x in g.indexes]
    return _frame(g, rows, "type string, entity string, label string, properties array<string>, metric string, dimension int")


def procedures(g: PropertyGraph) -> DataFrame:
    from .procedures import SIGNATURES

    rows = sorted((n, "READ") for n in [*(s[0] for s in SIGNATURES.values()), "db.labels", "db.relationshipTypes", "db.propertyKeys", "db.indexes", "db.constraints", "db.meta.stats", "db.schema.visualization", "dbms.procedures", "dbms.functions", "dbms.components"])
    return _frame(g, rows, "name string, mode string")


def functions(g: PropertyGraph) -> DataFrame:
    from ..plans.expressions import AGGREGATES, Exprs

    library.load()
    special = {"id": "id", "labels": "labels", "type": "type", "keys": "keys", "properties": "properties", "nodes": "nodes", "relationships": "relationships", "startnode": "startNode", "endnode": "endNode", "haslabels": "hasLabels"}
    assert all(hasattr(Exprs, f"fn_{k}") for k in special)
    spelled = {"stdev": "stDev", "stdevp": "stDevP", "percentilecont": "percentileCont", "percentiledisc": "percentileDisc"}
    rows = {(n, "scalar") for n in [*library.SPELLED.values(), *special.values(), "indegree", "outdegree"]} | {(spelled.get(a, a), "aggregate") for a in AGGREGATES}
    return _frame(g, sorted(rows), "name string, kind string")


def visualization(g: PropertyGraph) -> DataFrame:
    """A row a relationship type and pair of label sets."""
    every = range(len(g.nodes))
    rows = sorted({(":".join(g.nodes[s].labels), t.type, ":".join(g.nodes[d].labels)) for t in g.edges for s in (t.src if t.src is not None else every) for d in (t.dst if t.dst is not None else every)})
    return _frame(g, rows, "source string, type string, target string")


PROCEDURES = {
    "db.labels": lambda g: _frame(g, [(x,) for x in labels(g)], "label string"),
    "db.relationshiptypes": lambda g: _frame(g, [(x,) for x in types(g)], "relationshipType string"),
    "db.propertykeys": lambda g: _frame(g, [(x,) for x in keys(g)], "propertyKey string"),
    "db.indexes": indexes,
    "db.constraints": lambda g: _frame(g, [], "name string, type string, label string"),
    "db.meta.stats": stats,
    "db.schema.visualization": visualization,
    "dbms.procedures": procedures,
    "dbms.functions": functions,
    "dbms.components": lambda g: _frame(g, [("lodegraph", ["1.0"], "community")], "name string, versions array<string>, edition string"),
}


def procedure(g: PropertyGraph, name: str) -> DataFrame | None:
    made = PROCEDURES.get(name)
    return made(g) if made else None


SHOWS = {
    "INDEXES": indexes, "INDEX INFO": indexes, "PROCEDURES": procedures, "FUNCTIONS": functions, "CONSTRAINTS": PROCEDURES["db.constraints"],
    "DATABASES": lambda g: _frame(g, [("default", "online")], "name string, status string"),
    "VERSION": lambda g: _frame(g, [("lodegraph", "1.0")], "name string, version string"),
    "STORAGE INFO": stats,
    "TRANSACTIONS": lambda g: _frame(g, [], "id string"),
    "TRIGGERS": lambda g: _frame(g, [], "name string"),
    "LICENSE": lambda g: _frame(g, [("open",)], "license string"),
}


def shown(g: PropertyGraph, query: str) -> DataFrame | None:
    m = re.fullmatch(r"\s*SHOW\s+([A-Za-z]+(?:\s+INFO)?)\s*;?\s*", query, re.I)
    if not m:
        return None
    made = SHOWS.get(re.sub(r"\s+", " ", m[1].upper()))
    if made is None:
        raise ValueError(f"can't show {m[1]}")
    return made(g)
