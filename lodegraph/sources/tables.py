"""Ordinary tables as a property graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EdgeTable, Index, NodeTable, PropertyGraph, local_ids


@dataclass(frozen=True)
class NodeMap:
    """Rows of ``frame()`` as nodes: ``key`` is a whole-number column (unique,
    from 0 to 2 ** 48 - 1, else an error), ``props`` maps property names to columns."""

    labels: tuple[str, ...]
    frame: Callable[[], DataFrame]
    key: str
    props: dict[str, str] = field(default_factory=dict)
    key_property: str | None = None


@dataclass(frozen=True)
class EdgeMap:
    """Rows of ``frame()`` as relationships between the keys of two node maps,
    named by their first label; ``number`` is a whole-number column or
    expression, unique in the frame."""

    type: str
    frame: Callable[[], DataFrame]
    src: tuple[str, str]
    dst: tuple[str, str]
    number: str
    props: dict[str, str] = field(default_factory=dict)


def from_tables(spark: SparkSession, nodes: list[NodeMap], edges: list[EdgeMap], indexes: tuple[Index, ...] = ()) -> PropertyGraph:
    """Ids are made from the keys alone, so nothing is shuffled or numbered."""
    ordinal = {m.labels[0]: i for i, m in enumerate(nodes)}
    ids = lambda i, expr: local_ids(i, F.expr(expr))
    made = tuple(NodeTable(m.labels, m.frame().select(ids(i, m.key).alias("id"), *(F.expr(c).alias(p) for p, c in m.props.items())), m.key_property) for i, m in enumerate(nodes))
    linked = tuple(
        EdgeTable(m.type, m.frame().select(ids(i, m.number).alias("id"), ids(ordinal[m.src[0]], m.src[1]).alias("src"), ids(ordinal[m.dst[0]], m.dst[1]).alias("dst"), *(F.expr(c).alias(p) for p, c in m.props.items())), (ordinal[m.src[0]],), (ordinal[m.dst[0]],))
        for i, m in enumerate(edges)
    )
    return PropertyGraph(spark, made, linked, indexes)


def successors(df: DataFrame, group: str, part: Column, order: list[str], item: str) -> DataFrame:
    """``item, next_id``: what follows each item of its group in order.

    ``part`` grows with the order and splits groups, so that no task holds all
    of a large one: items are sorted within parts, and the last of a part is
    followed by the first of the group's next part.
    """
    split = df.withColumn("__part", part)
    inside = split.withColumn("next_id", F.lead(item).over(Window.partitionBy(group, "__part").orderBy(*order)))
    firsts = split.groupBy(group, "__part").agg(F.min_by(item, F.struct(*order)).alias("__first"))
    after = firsts.select(group, "__part", F.lead("__first").over(Window.partitionBy(group).orderBy("__part")).alias("__next"))
    joined = inside.join(after, [group, "__part"])
    return joined.select(item, F.coalesce("next_id", "__next").alias("next_id")).where("next_id is not null")


def star_schema(spark: SparkSession, folder: str) -> PropertyGraph:
    """The graph over the driver's tables."""
    table = lambda name: lambda: spark.read.parquet(f"{folder}/{name}.parquet")
    t = {n: table(n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")}
    same = lambda prefix, *names: {n: f"{prefix}_{n}" for n in names}

    def users():
        return t["events"]().select("user_id").distinct()

    def supplied():
        return t["lineitem"]().select("l_partkey", "l_suppkey").distinct()

    def following():
        return successors(t["events"]().select("user_id", "ts", "event_id"), "user_id", F.to_date("ts"), ["ts", "event_id"], "event_id")

    def messages():
        return t["conversations"]()

    def replies():
        order = Window.partitionBy("conv_id").orderBy("turn")
        c = messages().select("conv_id", "turn", F.lead("turn").over(order).alias("next_turn"))
        return c.where("next_turn is not null")

    line = "if(l_linenumber BETWEEN 0 AND 7, l_orderkey * 8 + l_linenumber, -1)"
    message = lambda turn: f"if({turn} BETWEEN 0 AND 65535, conv_id * 65536 + {turn}, -1)"
    nodes = [
        NodeMap(("Region",), t["region"], "r_regionkey", same("r", "regionkey", "name"), "regionkey"),
        NodeMap(("Nation",), t["nation"], "n_nationkey", same("n", "nationkey", "name"), "nationkey"),
        NodeMap(("Customer",), t["customer"], "c_custkey", same("c", "custkey", "name", "acctbal", "mktsegment"), "custkey"),
        NodeMap(("Supplier",), t["supplier"], "s_suppkey", same("s", "suppkey", "name", "acctbal"), "suppkey"),
        NodeMap(("Part",), t["part"], "p_partkey", same("p", "partkey", "name", "brand", "type", "size", "retailprice"), "partkey"),
        NodeMap(("Order",), t["orders"], "o_orderkey", {"orderkey": "o_orderkey", "status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority"}, "orderkey"),
        NodeMap(("User",), users, "user_id", {"userid": "user_id"}, "userid"),
        NodeMap(("Event",), t["events"], "event_id", {"eventid": "event_id", "ts": "ts", "kind": "event_type", "value": "value"}, "eventid"),
        NodeMap(("Document",), t["documents"], "doc_id", {"docid": "doc_id", "text": "text", "lang": "lang", "source": "source"}, "docid"),
        NodeMap(("Vec",), t["embeddings"], "vec_id", {"vecid": "vec_id", "embedding": "embedding", "label": "label"}, "vecid"),
        NodeMap(("Message",), messages, message("turn"), {"conv": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
    ]
    edges = [
        EdgeMap("IN_REGION", t["nation"], ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey"),
        EdgeMap("IN_NATION", t["customer"], ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "c_custkey"),
        EdgeMap("IN_NATION", t["supplier"], ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "s_suppkey"),
        EdgeMap("PLACED", t["orders"], ("Customer", "o_custkey"), ("Order", "o_orderkey"), "o_orderkey"),
        EdgeMap("CONTAINS", t["lineitem"], ("Order", "l_orderkey"), ("Part", "l_partkey"), line, {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "shipdate": "l_shipdate"}),
        EdgeMap("SUPPLIED_BY", supplied, ("Part", "l_partkey"), ("Supplier", "l_suppkey"), f"if(l_suppkey BETWEEN 0 AND {(1 << 21) - 1}, l_partkey * {1 << 21} + l_suppkey, -1)"),
        EdgeMap("DID", t["events"], ("User", "user_id"), ("Event", "event_id"), "event_id"),
        EdgeMap("NEXT", following, ("Event", "event_id"), ("Event", "next_id"), "event_id"),
        EdgeMap("REPLY", replies, ("Message", message("turn")), ("Message", message("next_turn")), message("turn")),
    ]
    indexes = (
        *(Index("range", "node", m.labels[0], (m.key_property,)) for m in nodes if m.key_property),
        Index("vector", "node", "Vec", ("embedding",), "cosine", 64),
        Index("fulltext", "node", "Document", ("text",)),
        Index("fulltext", "node", "Part", ("name",)),
    )
    return from_tables(spark, nodes, edges, indexes)
