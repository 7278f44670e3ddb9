"""Approximate nearest neighbours by a permutation index (operator 8).

Every vector is represented by its ``prefix`` nearest pivots, in order of their
distances; pivots are a bounded sample of the vectors, by hash of their ids. A
block of vectors is posted in pivot inverted files: under each of its pivots,
the vector and the position it gives that pivot. A query reads the files of its
own nearest pivots only and adds up, for each vector posted there, how much that
lessens Spearman's footrule between the two prefixes (a pivot that is missing
counts as if it came next). The ``share`` of a block with the least footrule,
those that tie with the last of them included, is compared exactly.

All blocks together hold all rows, and every query meets every block; blocks,
and queries that meet a block at a time, have a bounded number of rows. Copies
of one vector in a block count as one, with its smallest ids.

Defined results: vectors that are null, empty, zero, of another dimension than
most, or with null or non-finite components, and rows without vec_id take no
part; rows that repeat a query's vec_id are its own; a vec_id given twice is
one query (with the lesser vector); of equal distances the smaller ids come
first, however many there are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns
from .ragged import gather

#: Pivots at most, pivots a vector is posted under, and the part of a block that is compared.
PIVOTS, PREFIX, SHARE = 2048, 64, 0.08
#: Vectors compared for each one asked for, at least, over all blocks.
DEPTH = 10
#: Rows of a block, and queries that meet one at a time.
BLOCK_ROWS, CHUNK_QUERIES = 1 << 16, 1 << 16
OUT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v``; single-precision vectors stay so until they are compared."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = columns(vectors, key, vector).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(kind).alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull()).where(fine)


def prefixes(x: np.ndarray, pivots: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` nearest pivots of each vector, nearest first."""
    out = np.empty((len(x), size), np.int32)
    norms = (pivots**2).sum(1)[None]
    for at in range(0, len(x), 1024):
        apart = norms - 2 * x[at : at + 1024] @ pivots.T
        near = np.argpartition(apart, size - 1, 1)[:, :size] if size < len(pivots) else np.broadcast_to(np.arange(size), apart.shape)
        order = np.lexsort((near, np.take_along_axis(apart, near, 1)), axis=1)
        out[at : at + 1024] = np.take_along_axis(near, order, 1)
    return out


class Files:
    """Pivot inverted files of a block: by pivot, ``vector * size + position``."""

    def __init__(self, near: np.ndarray, pivots: int):
        self.vectors, self.size = near.shape
        order = np.argsort(near.ravel(), kind="stable")
        self.posted = order.astype(np.int32 if near.size < 1 << 31 else np.int64)
        self.offsets = np.searchsorted(near.ravel()[order], np.arange(pivots + 1))

    def gains(self, own: np.ndarray) -> np.ndarray:
        """By vector, what the pivots it shares with a query lessen the footrule
        by, halved: a pivot at positions a and b by size - max(a, b)."""
        entry, ends = gather(self.posted, self.offsets, own)
        position = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(ends))
        gain = self.size - np.maximum(position, entry % self.size)
        return np.bincount(entry // self.size, gain, self.vectors)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int, share: float = SHARE, least: int = 0, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, vector, distance)``: up to k of the block for each query, of
    the ``share`` of its vectors, ``least`` at least, that are compared."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    _, kinds = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)
    by = np.argsort(kinds, kind="stable")  # copies of a vector together, smallest ids first
    begins = np.concatenate([[True], kinds[by][1:] != kinds[by][:-1]])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(by)) - 1
    again = np.flatnonzero(np.concatenate([begins[1:] | (ids[by][1:] != ids[by][:-1]), [True]]))
    rows_of_one = int(np.diff(again, prepend=-1).max(initial=1))  # a vec_id may be given more than once
    copies = np.minimum(last - first + 1, k + rows_of_one)
    distinct = x[by[first]].astype(float)
    least_id, most_id = ids[by[first]], ids[by[last]]
    size = min(prefix, len(pivots))
    files, asked = Files(prefixes(distinct, pivots, size), len(pivots)), prefixes(q, pivots, size)
    n = len(distinct)
    take = min(n, max(least, int(np.ceil(share * n))))
    out = []
    for i, own in enumerate(query_ids.tolist()):
        gain = files.gains(asked[i])
        near = np.flatnonzero(gain >= np.partition(gain, n - take)[n - take])
        near = near[(least_id[near] != own) | (most_id[near] != own)]
        distance = np.sqrt(((distinct[near] - q[i]) ** 2).sum(1))
        if len(near) > k:
            some = distance <= np.partition(distance, k)[k]  # all that tie; one may be left with other rows than the query's own
            near, distance = near[some], distance[some]
        c = copies[near]
        rows = by[np.repeat(first[near], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
        d = np.repeat(distance, c)
        other = ids[rows] != own
        rows, d = rows[other], d[other]
        top = np.lexsort((ids[rows], d))[:k]
        out.append((np.full(len(top), own), ids[rows[top]], d[top]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of both given as ``(id, v)``."""
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, count = sizes[0]["d"], sizes[0]["n"]
    vectors, queries = (x.where(F.size("v") == dimension) for x in (vectors, queries))
    sample = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(4 * pivots).collect()
    chosen = np.array(list(dict.fromkeys(tuple(r["v"]) for r in sample))[:pivots], float)
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(12, -(-count // BLOCK_ROWS))
    least = -(-DEPTH * k // blocks)
    chunks = -(-max(1, queries.count()) // CHUNK_QUERIES)
    hashed = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = vectors.select(hashed(blocks, 1).alias("b"), every(chunks).alias("c"), "id", "v")
    asked = queries.select(every(blocks).alias("b"), hashed(chunks, 2).alias("c"), "id", "v")

    def search(left, right):
        import pyarrow as pa

        got = lambda t: (t.column("id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dimension))
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (ids, x), (query_ids, q) = got(left), got(right)
        a, b, s = search_block(ids, x, query_ids, q.astype(float), chosen, k, share, least)
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    found = dealt.groupBy("b", "c").cogroup(asked.groupBy("b", "c")).applyInArrow(search, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_every(spark: SparkSession, table: DataFrame, step: int = 100, k: int = 10) -> DataFrame:
    """Queries: rows whose vec_id is divisible by ``step``, against all rows."""
    vectors = usable(table)
    return nearest(spark, vectors, vectors.where(F.pmod("id", F.lit(step)) == 0), k)
