"""Exact k nearest neighbours over a vector property.

One vector is a scan with built-in expressions and a top-k. Many vectors meet
the indexed ones block by block: higher-order functions are interpreted element
by element in Spark, so each pair of blocks is one matrix product in NumPy on
Arrow batches instead, and only the k best of a block go on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from ..model import Index, PropertyGraph

#: Rows of a block of vectors, neighbours found for a block of queries, and
#: scores in memory at a time.
BLOCK_ROWS, FOUND_ROWS, SCORES = 1 << 15, 1 << 15, 1 << 20


def vectors(graph: PropertyGraph, index: Index) -> DataFrame:
    """``id, v`` of nodes that have a vector."""
    tables = graph.node_tables(lambda labels: index.label in labels)
    prop = index.properties[0]
    return graph.node_frame(tables, [prop]).select("id", F.col(f"`{prop}`").cast("array<float>").alias("v")).where("v is not null")


def checked(q: Column, dimension: int | None) -> Column:
    """A query vector, or an error: elements that are null or not finite, or
    another number of them than the index has."""
    bad = F.exists(q, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.when(bad, F.raise_error(F.lit("a query vector has an element that is not finite")).cast("array<float>")).otherwise(q)
    if dimension is None:
        return q
    wrong = F.raise_error(F.concat(F.lit(f"the index has {dimension} dimensions, the vector "), F.size(q).cast("string"))).cast("array<float>")
    return F.when(F.size(q) != dimension, wrong).otherwise(q)


def nearest_one(graph: PropertyGraph, index: Index, k: int, q: Column) -> DataFrame:
    """For one literal vector: a scan, and the best k of every task's rows."""
    score = METRICS[index.metric.lower()](F.col("v"), checked(q.cast("array<float>"), index.dimension))
    return vectors(graph, index).select("id", score.alias("score")).orderBy("score", "id").limit(k)


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance of every query to every vector, in double precision."""
    products = q @ x.T
    if metric == "dot":
        return -products
    if metric == "cosine":
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
        np.divide(products, norms, out=products, where=norms != 0)  # of zero vectors it is zero already
        return np.subtract(1.0, products, out=products)
    return np.stack([((x - one) ** 2).sum(1) for one in q]) if len(q) else products


def matrix(column) -> np.ndarray:
    """A column of lists of one length as rows of single precision."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().unique()
    if len(sizes) != 1:
        raise ValueError("the vectors have several numbers of dimensions")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), sizes[0].as_py())


def search(left, right, metric: str, k: int):
    """``q, id, score``: of a block of vectors ``id, v`` the nearest of each of a
    block of queries ``q``. What it holds is bound by the blocks' sizes."""
    import pyarrow as pa

    schema = pa.schema([("q", pa.list_(pa.float32())), ("id", pa.int64()), ("score", pa.float64())])
    if not left.num_rows or not right.num_rows or not k:
        return schema.empty_table()
    ids, x, q = left.column("id").to_numpy(), matrix(left.column("v")), matrix(right.column("q"))
    if q.shape[1] != x.shape[1]:
        raise ValueError(f"the vectors have {x.shape[1]} dimensions, the query {q.shape[1]}")
    order = np.argsort(ids, kind="stable")  # of equal distances the smaller id comes first
    ids, x = ids[order], x[order].astype(np.float64)
    at, found, scores = [], [], []
    step = max(1, SCORES // len(x))
    for lo in range(0, len(q), step):
        d = distances(metric, q[lo : lo + step].astype(np.float64), x)
        for i, row in enumerate(d):
            some = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
            best = some[np.argsort(row[some], kind="stable")[:k]]
            at.append(np.full(len(best), lo + i))
            found.append(ids[best])
            scores.append(row[best])
    asked_for = right.column("q").take(pa.array(np.concatenate(at)))
    return pa.table([asked_for.combine_chunks().cast(schema.field("q").type), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))], schema=schema)


def nearest_each(graph: PropertyGraph, index: Index, k: int, queries: DataFrame) -> DataFrame:
    """``q, id, score`` for each of ``queries(q)``, distinct vectors: every block
    of queries meets every block of vectors, and its best are ranked again."""
    metric = index.metric.lower()
    rows, wanted = vectors(graph, index), queries.select("q", F.xxhash64("q").alias("h"))
    counts = rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(queries.agg(F.count(F.lit(1)).alias("m"))).first()  # one row each
    spread = graph.spark.sparkContext.defaultParallelism
    blocks = max(1, -(-counts["n"] // BLOCK_ROWS), min(spread, counts["n"] // 256))
    chunks = max(1, -(-counts["m"] // max(64, FOUND_ROWS // max(k, 4))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), every(chunks).alias("c"), "id", "v")
    asked = wanted.select(every(blocks).alias("b"), F.pmod("h", F.lit(chunks)).cast("int").alias("c"), checked(F.col("q"), index.dimension).alias("q"))
    found = dealt.groupBy("b", "c").cogroup(asked.groupBy("b", "c")).applyInArrow(lambda left, right: search(left, right, metric, k), "q array<float>, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))
    return found.withColumn("r", rank).where(F.col("r") <= k).select("q", "id", "score")
