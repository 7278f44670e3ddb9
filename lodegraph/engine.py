"""The way in: queries and writes against a property graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .model import PropertyGraph
from .plans.compiler import Planner
from .plans.parser import parse


class Engine:
    """Runs queries over a graph, or over named graphs (``USE name``)."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph, graphs: dict[str, PropertyGraph] | None = None, max_rows: int | None = None):
        self.spark, self.graph, self.graphs, self.max_rows = spark, graph, graphs or {}, max_rows

    def run(self, query: str, params: dict | None = None) -> DataFrame:
        """The result of a read query as a DataFrame."""
        graph = self.graph
        use = re.match(r"\s*USE\s+(\w+|`[^`]+`)\s+", query, re.I)
        if use:
            name = use[1].strip("`")
            if name not in self.graphs:
                raise ValueError(f"no graph {name}")
            graph, query = self.graphs[name], query[use.end() :]
        from .operators.introspect import shown

        static = shown(graph, query)
        if static is not None:
            return static
        out = Planner(graph, params).run(parse(query))
        if self.max_rows is not None and len(out.take(self.max_rows + 1)) > self.max_rows:
            raise ValueError(f"the result has more than {self.max_rows} rows")
        return out

    def write(self, statement: str, params: dict | None = None) -> DataFrame | None:
        """Run a write statement: the engine's graph becomes a new snapshot. A
        RETURN sees the snapshot after the write."""
        from .operators.writes import execute

        self.graph, result = execute(self.graph, statement, params or {})
        return result

    def json(self, query: str, params: dict | None = None) -> str:
        """``{"columns": [...], "rows": [...]}`` for results that fit the driver."""
        import json

        df = self.run(query, params)
        return json.dumps({"columns": df.columns, "rows": [list(json.loads(r).get(c) for c in df.columns) for r in df.toJSON().collect()]})
