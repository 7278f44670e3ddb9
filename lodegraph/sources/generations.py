"""Versioned graphs on any Hadoop file system: publish, and read what is current."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict

from pyspark.sql import SparkSession

from ..model import EdgeTable, Index, NodeTable, PropertyGraph


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written aside, then renamed over the
    old one in one step, so that there is no moment without it."""
    fs, make = _fs(spark, path)
    aside = make(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    _replace(spark, fs.makeQualified(aside), fs.makeQualified(make(path)))


def _replace(spark: SparkSession, aside, there) -> None:
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, there, over)


def _claimed(spark: SparkSession, root: str) -> str:
    """A version that no other writer has: its claim file is made by one alone."""
    fs, make = _fs(spark, root)
    fs.mkdirs(make(root))
    known = [int(m[1]) for s in fs.listStatus(make(root)) if (m := re.fullmatch(r"v(\d+)(?:\.claim)?", s.getPath().getName()))]
    n = max(known, default=0)
    while True:
        n += 1
        if fs.createNewFile(make(f"{root}/v{n}.claim")):
            return f"v{n}"


def read_text(spark: SparkSession, path: str) -> str:
    fs, make = _fs(spark, path)
    stream = fs.open(make(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(graph: PropertyGraph, root: str) -> str:
    """Write a graph as the next version below ``root``; the pointer to it is
    changed last, so readers see the old version or the new one."""
    spark, root = graph.spark, root.rstrip("/")
    version = _claimed(spark, root)
    at = f"{root}/{version}"
    for kind, tables in (("nodes", graph.nodes), ("edges", graph.edges)):
        for i, t in enumerate(tables):
            t.df.write.parquet(f"{at}/{kind}/{i}")
    manifest = {
        "nodes": [{"labels": t.labels, "key": t.key} for t in graph.nodes],
        "edges": [{"type": t.type, "src": t.src, "dst": t.dst} for t in graph.edges],
        "indexes": [asdict(x) for x in graph.indexes],
    }
    write_text(spark, f"{at}/manifest.json", json.dumps(manifest))
    write_text(spark, f"{root}/current", version)
    return version


def read(spark: SparkSession, root: str, version: str | None = None) -> PropertyGraph:
    root = root.rstrip("/")
    version = version or read_text(spark, f"{root}/current").strip()
    at = f"{root}/{version}"
    m = json.loads(read_text(spark, f"{at}/manifest.json"))
    nodes = tuple(NodeTable(tuple(t["labels"]), spark.read.parquet(f"{at}/nodes/{i}"), t["key"]) for i, t in enumerate(m["nodes"]))
    pick = lambda x: None if x is None else tuple(x)
    edges = tuple(EdgeTable(t["type"], spark.read.parquet(f"{at}/edges/{i}"), pick(t["src"]), pick(t["dst"])) for i, t in enumerate(m["edges"]))
    indexes = tuple(Index(**x | {"properties": tuple(x["properties"]), "stopwords": tuple(x["stopwords"])}) for x in m["indexes"])
    return PropertyGraph(spark, nodes, edges, indexes, int(version[1:]))


def validated(graph: PropertyGraph) -> PropertyGraph:
    """The graph, if every relationship's ends exist; else an error."""
    ids = graph.node_frame(graph.node_tables(), [])
    edges = graph.edge_frame(graph.edge_tables(), [])
    for end in ("src", "dst"):
        if not edges.join(ids.withColumnRenamed("id", end), end, "left_anti").isEmpty():
            raise ValueError(f"relationships whose {end} does not exist")
    return graph
