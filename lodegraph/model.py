"""The property graph: node tables by label set, edge tables by type.

Ids hold the ordinal of their table above ``SHIFT`` bits, so that the labels of
a node or the type of a relationship follow from its id without a join, and a
label or type test picks tables while the plan is made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans import types as T

SHIFT = 48
_HEAD = {"id", "src", "dst"}


@dataclass(frozen=True)
class NodeTable:
    """``df``: ``id`` and a column a property. ``key``: the business key."""

    labels: tuple[str, ...]
    df: DataFrame
    key: str | None = None


@dataclass(frozen=True)
class EdgeTable:
    """``df``: ``id, src, dst`` and a column a property; ``src`` and ``dst``:
    ordinals of the node tables that hold the ends (None: any)."""

    type: str
    df: DataFrame
    src: tuple[int, ...] | None = None
    dst: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Index:
    kind: str  # range, vector, fulltext
    entity: str  # node, relationship
    label: str
    properties: tuple[str, ...]
    metric: str = "cosine"
    dimension: int | None = None
    stopwords: tuple[str, ...] = ()


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    nodes: tuple[NodeTable, ...]
    edges: tuple[EdgeTable, ...]
    indexes: tuple[Index, ...] = ()
    version: int = 0
    _types: dict = field(default_factory=dict, compare=False)

    # catalog
    def property_types(self, entity: str = "node", tables: tuple[int, ...] | None = None) -> dict[str, object]:
        """Type of every property key over the given tables (default: all). A
        property whose kinds don't go together is read as text there."""
        if (entity, tables) not in self._types:
            out: dict[str, object] = {}
            every = self.nodes if entity == "node" else self.edges
            for i in range(len(every)) if tables is None else tables:
                for f in every[i].df.schema.fields:
                    if f.name not in _HEAD:
                        t = T.of_spark(f.dataType)
                        try:
                            out[f.name] = T.unify(out.get(f.name, T.NULL), t)
                        except T.TypeProblem:
                            out[f.name] = T.STR
            self._types[entity, tables] = out
        return self._types[entity, tables]

    def table_properties(self, entity: str, ordinal: int) -> list[str]:
        return [c for c in (self.nodes if entity == "node" else self.edges)[ordinal].df.columns if c not in _HEAD]

    def node_tables(self, test: Callable[[frozenset[str]], bool] = lambda labels: True) -> tuple[int, ...]:
        return tuple(i for i, t in enumerate(self.nodes) if test(frozenset(t.labels)))

    def edge_tables(self, test: Callable[[frozenset[str]], bool] = lambda types: True) -> tuple[int, ...]:
        return tuple(i for i, t in enumerate(self.edges) if test(frozenset((t.type,))))

    def labels_of(self, node_id: Column, tables: tuple[int, ...] | None = None) -> Column:
        known = {self.nodes[i].labels for i in tables} if tables is not None else set()
        sets = F.array(*(F.array(*map(F.lit, t.labels)).cast("array<string>") for t in self.nodes))
        if len(known) == 1:
            return F.when(node_id.isNotNull(), F.array(*map(F.lit, known.pop())).cast("array<string>"))
        return F.get(sets, F.shiftright(node_id, SHIFT).cast("int"))

    def type_of(self, edge_id: Column, tables: tuple[int, ...] | None = None) -> Column:
        known = {self.edges[i].type for i in tables} if tables is not None else set()
        if len(known) == 1:
            return F.when(edge_id.isNotNull(), F.lit(known.pop()))
        return F.get(F.array(*(F.lit(t.type) for t in self.edges)), F.shiftright(edge_id, SHIFT).cast("int"))

    def index(self, kind: str, entity: str, label: str, prop: str | None = None) -> Index | None:
        for x in self.indexes:
            if x.kind == kind and x.entity == entity and x.label == label and (prop is None or prop in x.properties):
                return x
        return None

    # frames
    def node_frame(self, tables: tuple[int, ...], keys: list[str]) -> DataFrame:
        """``id`` and the given properties of all nodes in the tables."""
        return self._union([self.nodes[i].df for i in tables], keys, self.property_types("node", tables), ["id"])

    def edge_frame(self, tables: tuple[int, ...], keys: list[str]) -> DataFrame:
        return self._union([self.edges[i].df for i in tables], keys, self.property_types("edge", tables), ["id", "src", "dst"])

    def _union(self, frames: list[DataFrame], keys: list[str], types: dict, head: list[str]) -> DataFrame:
        out = None
        for df in frames:
            cols = [F.col(h) for h in head]
            for k in keys:
                want = types.get(k, T.NULL)
                cols.append((T.convert(F.col(f"`{k}`"), T.of_spark(df.schema[k].dataType), want).cast(T.ddl(want)) if k in df.columns else F.lit(None).cast(T.ddl(want))).alias(k))
            part = df.select(*cols)
            out = part if out is None else out.unionAll(part)
        if out is None:
            out = self.spark.createDataFrame([], ",".join([f"{h} bigint" for h in head] + [f"`{k}` {T.ddl(types.get(k, T.STR))}" for k in keys]))
        return out

    def with_version(self, **changes) -> "PropertyGraph":
        return replace(self, version=self.version + 1, _types={}, **changes)


def local_ids(ordinal: int, key: Column) -> Column:
    """Ids from whole-number keys of 0 to 2 ** SHIFT - 1; another key is an error,
    as it would be an id of another table."""
    k = key.cast("bigint")
    beyond = F.raise_error(F.concat(F.lit("a key doesn't fit an id: "), k.cast("string"))).cast("bigint")
    return F.when(F.shiftright(k, SHIFT) == 0, F.lit(ordinal << SHIFT) + k).when(k.isNotNull(), beyond)


def numbered(df: DataFrame, name: str = "__n") -> DataFrame:
    """``df`` (a stored table, read alike each time) with dense numbers from 0:
    a row's place in its partition, and the rows of the partitions before, a
    table of a row a partition that is broadcast."""
    part = F.spark_partition_id().alias("__part")
    counts = df.groupBy(part).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__ahead"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.select("*", part, place.alias("__place")).join(F.broadcast(ahead), "__part")
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__place") + F.col("__ahead")).alias(name))
