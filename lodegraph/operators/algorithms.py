"""Graph algorithms as iterated joins; state is checkpointed every round.

All take ``nodes(id)`` and ``edges(src, dst)`` (parallel edges kept) and work
on partitioned frames; nothing but counts and sums reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SHIFT
from ..storage import checkpointed, stored

DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-9


def view(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes that their ends can be."""
    e = edges.select("id", "src", "dst").join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    return e.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")


def bfs(edges: DataFrame, source: DataFrame, max_level: int) -> DataFrame:
    """``s, node, edge, level`` of what each ``source(s)`` reaches; tree edges
    are the smallest into a node from the level before."""
    level = source.select("s", F.col("s").alias("node"))
    seen = level
    out, depth = None, 0
    while max_level <= 0 or depth < max_level:
        depth += 1
        nxt = level.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("id").alias("edge")), "node")
        nxt = nxt.groupBy("s", F.col("to").alias("node")).agg(F.min("edge").alias("edge")).join(seen.select("s", "node"), ["s", "node"], "left_anti")
        nxt = checkpointed(nxt.withColumn("level", F.lit(depth)))
        if nxt.isEmpty():
            break
        out = nxt if out is None else out.unionAll(nxt)
        seen = checkpointed(seen.select("s", "node").unionAll(nxt.select("s", "node")))
        level = nxt.select("s", "node")
    return out if out is not None else source.select("s", F.col("s").alias("node"), F.lit(0).cast("bigint").alias("edge"), F.lit(0).alias("level")).where(F.lit(False))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, componentId``: the smallest id that is connected, by alternating
    large-star and small-star rounds (Kiveris et al. 2014)."""
    e = checkpointed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes["id"] == roots["u"], "left").select("id", F.coalesce("root", "id").alias("componentId"))


def pagerank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, score``; the mass of nodes without out-edges is spread evenly.

    Nodes without in-edges have one score, a number; rounds are over the others,
    for each of which the weights of its edges from such nodes are summed once.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("score"))
    edges = checkpointed(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    degree = edges.groupBy("src").agg(F.sum("w").alias("d"))
    links = checkpointed(edges.join(degree, "src").select("src", "dst", (F.col("w") / F.col("d")).alias("w")))
    fed = stored(links.select(F.col("dst").alias("id")).distinct(), "fed")
    inner = stored(links.join(fed.select(F.col("id").alias("src")), "src", "left_semi"), "inner")
    even = links.join(fed.select(F.col("id").alias("src")), "src", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("even"))
    ends = links.select(F.col("src").alias("id")).distinct().withColumn("goes", F.lit(True))
    ranks = fed.join(even, "id", "left").join(ends, "id", "left").select("id", F.lit(1.0 / n).alias("score"), F.coalesce("even", F.lit(0.0)).alias("even"), F.col("goes").isNull().alias("ends"))
    ranks = checkpointed(ranks)
    some, closed = ranks.agg(F.count(F.lit(1)), F.count(F.when(F.col("ends"), 1))).first()
    going = degree.count()
    rest, closed_rest, score = n - some, n - going - closed, 1.0 / n
    loose = (n - going) / n
    for _ in range(ROUNDS):
        base = (1 - DAMPING) / n + DAMPING * loose / n
        given = inner.join(ranks.select(F.col("id").alias("src"), "score"), "src").groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        got = F.coalesce("got", F.lit(0.0)) + F.col("even") * F.lit(score)
        new = checkpointed(ranks.join(given, ranks["id"] == given["dst"], "left").select("id", (F.lit(base) + DAMPING * got).alias("new"), "score", "even", "ends"))
        change, loose = new.agg(F.coalesce(F.sum(F.abs(F.col("new") - F.col("score"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("ends"), F.col("new"))), F.lit(0.0))).first()
        change, loose, score = change + rest * abs(base - score), loose + closed_rest * base, base
        ranks = new.select("id", F.col("new").alias("score"), "even", "ends")
        if change < TOLERANCE:
            break
    ranks = stored(ranks.select("id", "score"), "ranks")
    return nodes.join(ranks, "id", "left").select("id", F.coalesce("score", F.lit(score)).alias("score"))


def distances(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``s, node, level`` of every node that each node reaches, but itself."""
    return bfs(checkpointed(edges), nodes.select(F.col("id").alias("s")), 0).select("s", "node", "level")


def harmonic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, score, reachable``: the sum of inverse distances along edges."""
    nodes = checkpointed(nodes)
    far = distances(nodes, edges).groupBy("s").agg(F.sum(F.lit(1.0) / F.col("level")).alias("score"), F.count(F.lit(1)).alias("reachable"))
    return nodes.join(far, nodes["id"] == far["s"], "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("reachable", F.lit(0)).cast("bigint").alias("reachable"))


def _tables(pairs: DataFrame) -> set[tuple]:
    """The tables that pairs ``s, node`` are in."""
    return {tuple(r) for r in pairs.select(*(F.shiftright(c, SHIFT) for c in ("s", "node"))).distinct().collect()}


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, score``: Brandes' sums over ordered pairs, parallel edges counted,
    for all sources together: a forward sweep of path counts by level, then a
    backward one of dependencies.

    The first level is the edges themselves; only edges that go on from where
    others end are joined to it and to those after it. Pairs of a level are held
    against earlier ones only where some are in the same two tables.
    """
    links = checkpointed(edges.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))
    onward = stored(links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "onward")
    levels = [links.select(F.col("src").alias("s"), F.col("dst").alias("node"), F.col("w").alias("sigma"))]
    tables = [_tables(levels[0])]
    while True:
        nxt = levels[-1].join(onward, F.col("node") == F.col("src")).where("s <> dst").groupBy("s", F.col("dst").alias("to")).agg(F.sum(F.col("sigma") * F.col("w")).alias("sigma"))
        nxt = checkpointed(nxt.select("s", F.col("to").alias("node"), "sigma"))
        there = _tables(nxt)
        before = [x.select("s", "node") for x, known in zip(levels, tables) if known & there]
        if before:
            nxt = checkpointed(nxt.join(reduce(DataFrame.unionAll, before), ["s", "node"], "left_anti"))
            there = _tables(nxt)
        if not there:
            break
        levels.append(nxt)
        tables.append(there)
    total = None
    delta = levels[-1].select("s", "node", "sigma", F.lit(0.0).alias("delta"))
    for k in range(len(levels) - 1, 0, -1):
        after = delta.select(F.col("s").alias("s2"), F.col("node").alias("next"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        back = levels[k - 1].join(onward, F.col("node") == F.col("src")).join(after, (F.col("s") == F.col("s2")) & (F.col("dst") == F.col("next")))
        back = back.groupBy("s", "node").agg((F.first("sigma") * F.sum(F.col("w") * F.col("share"))).alias("delta"))
        if k > 1:
            back = checkpointed(back)
            delta = levels[k - 1].join(back, ["s", "node"], "left").select("s", "node", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        part = back.groupBy("node").agg(F.sum("delta").alias("delta"))
        total = part if total is None else total.unionAll(part)
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("score"))
    sums = total.groupBy("node").agg(F.sum("delta").alias("score"))
    return nodes.join(sums, nodes["id"] == sums["node"], "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``id, communityId``: each round every node takes the commonest label of
    its neighbours (both ways, parallel edges counted; ties: the smallest); a
    community is named by its smallest node."""
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    near = checkpointed(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")))
    labels = nodes.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = near.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a", "label").agg(F.sum("w").alias("n"))
        best = votes.groupBy("a").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("new"))
        new = checkpointed(labels.join(best, labels["id"] == best["a"], "left").select("id", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("moved")))
        labels = new.select("id", "label")
        if new.where("moved").isEmpty():
            break
    named = labels.groupBy("label").agg(F.min("id").alias("communityId"))
    return labels.join(named, "label").select("id", "communityId")
