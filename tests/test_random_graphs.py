"""Random small graphs against a plain backtracking matcher."""

import random
from dataclasses import replace

import pytest
from graphs import N, plain

from lodegraph.engine import Engine
from lodegraph.model import EdgeTable, NodeTable, PropertyGraph
from lodegraph.operators import algorithms
from lodegraph.plans import match


def walks(edges, start, low, high, rule):
    """(end, length) of each walk from a node under a restrictor."""
    out = []

    def go(at, path, nodes, closed):
        if len(path) >= low:
            out.append((at, len(path)))
        if len(path) == high or closed:
            return
        for i, (a, b) in enumerate(edges):
            if a != at:
                continue
            if rule == "TRAIL" and i in path or rule == "ACYCLIC" and b in nodes or rule == "SIMPLE" and b in nodes and b != start:
                continue
            go(b, [*path, i], [*nodes, b], rule == "SIMPLE" and b == start)

    go(start, [], [start], False)
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_walks(spark, seed):
    rng = random.Random(seed)
    names = "abcdef"
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(9)]
    e = Engine(spark, plain(spark, names, edges))
    for rule in ("WALK", "TRAIL", "ACYCLIC", "SIMPLE"):
        got = sorted((r["a"], r["b"], r["n"]) for r in e.run(f"MATCH p = {rule} (a)-[:R*1..3]->(b) RETURN a.name AS a, b.name AS b, length(p) AS n").collect())
        assert got == sorted((s, b, n) for s in names for b, n in walks(edges, s, 1, 3, rule)), rule
    reach = {(r["a"], r["b"]) for r in e.run("MATCH (a)-[:R*0..2]->(b) RETURN DISTINCT a.name AS a, b.name AS b").collect()}
    assert reach == {(s, b) for s in names for b, _ in walks(edges, s, 0, 2, "TRAIL")}
    short = {(r["a"], r["b"]): r["n"] for r in e.run("MATCH p = ANY SHORTEST (a)-[:R*1..6]->(b) RETURN a.name AS a, b.name AS b, length(p) AS n").collect()}
    want = {}
    for s in names:
        for b, n in walks(edges, s, 1, 6, "ACYCLIC"):
            want[s, b] = min(n, want.get((s, b), 9))
    assert short == want
    chain = sorted((r["a"], r["c"]) for r in e.run("MATCH (a)-[:R]->(b)-[:R]-(c) RETURN a.name AS a, c.name AS c").collect())
    both = [(j, c, d) for j, (x, y) in enumerate(edges) for c, d in ((x, y), (y, x))]
    assert chain == sorted((a, d) for i, (a, b) in enumerate(edges) for j, c, d in both if i != j and c == b)


def brandes(names, edges):
    """Betweenness over ordered pairs, parallel edges counted, one source at a time."""
    score = dict.fromkeys(names, 0.0)
    for s in names:
        dist, sigma, order, at = {s: 0}, {s: 1.0}, [s], 0
        while at < len(order):
            v, at = order[at], at + 1
            for a, b in edges:
                if a == v and b not in dist:
                    dist[b] = dist[v] + 1
                    order.append(b)
                if a == v and dist[b] == dist[v] + 1:
                    sigma[b] = sigma.get(b, 0.0) + sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for w in order[::-1]:
            for a, b in edges:
                if b == w and a in dist and dist[a] == dist[w] - 1:
                    delta[a] += sigma[a] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score


@pytest.mark.parametrize("seed", range(2))
def test_betweenness(spark, seed):
    rng = random.Random(seed)
    names = "abcdefghij"
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(16)]
    e = Engine(spark, plain(spark, names, [*edges, edges[0]]))
    got = {r["n"]: r["score"] for r in e.run("CALL algo.betweenness({}) YIELD node, score RETURN node.name AS n, score").collect()}
    assert got == pytest.approx(brandes(names, [*edges, edges[0]]))


def test_procedures_read_edges_between_their_nodes_only(spark):
    """Edge tables whose ends can't be among the chosen nodes are left out of the plan."""
    seen = []
    g = plain(spark, "ab", [("a", "b")])
    far = EdgeTable("FAR", spark.createDataFrame([(N, N, N)], "id bigint, src bigint, dst bigint"), (1,), (1,))
    g = replace(g, nodes=(*g.nodes, NodeTable(("M",), spark.createDataFrame([(N,)], "id bigint"))), edges=(*g.edges, far))
    kept = PropertyGraph.edge_frame
    PropertyGraph.edge_frame = lambda self, tables, keys: seen.append(tables) or kept(self, tables, keys)
    try:
        assert Engine(spark, g).run("CALL algo.betweenness({nodeLabels: ['N']}) YIELD node, score RETURN count(*) AS c").first()[0] == 2
    finally:
        PropertyGraph.edge_frame = kept
    assert seen == [(0,)]


def ranks(names, edges):
    """PageRank by plain rounds over all nodes."""
    n, score = len(names), dict.fromkeys(names, 1 / len(names))
    for _ in range(100):
        loose = sum(score[v] for v in names if all(a != v for a, _ in edges))
        new = {v: 0.15 / n + 0.85 * (loose / n + sum(score[a] / sum(x == a for x, _ in edges) for a, b in edges if b == v)) for v in names}
        change, score = sum(abs(new[v] - score[v]) for v in names), new
        if change < 1e-9:
            break
    return score


@pytest.mark.parametrize("seed", range(2))
def test_pagerank(spark, seed, monkeypatch):
    """Nodes that have no in-edges take no part in the rounds."""
    rng = random.Random(seed)
    names = "abcdefghij"
    edges = [(rng.choice("abcdefg"), rng.choice("efghi")) for _ in range(14)]
    sizes, kept = [], algorithms.checkpointed
    monkeypatch.setattr(algorithms, "checkpointed", lambda df: sizes.append(kept(df)) or sizes[-1])
    got = {r["n"]: r["score"] for r in Engine(spark, plain(spark, names, edges)).run("CALL algo.pageRank(null, 'R') YIELD node, score RETURN node.name AS n, score").collect()}
    assert got == pytest.approx(ranks(names, edges), abs=1e-12)
    assert all(x.count() == len({b for _, b in edges}) for x in sizes if "even" in x.columns) and not any(x.columns == ["id"] for x in sizes)


def test_reach_grows_from_the_smaller_end(spark, monkeypatch):
    """Many starts, one end: levels hold a pair for each node and that end, and
    the hops read only tables on the way."""
    levels, kept = [], match.stored
    monkeypatch.setattr(match, "stored", lambda df, what: levels.append((what, kept(df, what))) or levels[-1][1])
    rows = lambda n, at: spark.createDataFrame([(at + i, f"{i:02d}") for i in range(n)], "id bigint, name string")
    hops = lambda pairs: spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id bigint, src bigint, dst bigint")
    a_b = [(i, N + j) for i in range(20) for j in range(10)]
    b_c = [(N + j, 2 * N + j % 2) for j in range(9)]
    nodes = tuple(NodeTable((x,), rows(n, t * N)) for t, (x, n) in enumerate((("A", 20), ("B", 10), ("C", 2))))
    edges = (EdgeTable("R", hops(a_b), (0,), (1,)), EdgeTable("R", hops(b_c), (1,), (2,)), EdgeTable("R", hops([(2 * N, 0)]), (2,), (0,)))
    e = Engine(spark, PropertyGraph(spark, nodes, edges))
    got = lambda q: sorted(tuple(r) for r in e.run(q).collect())
    assert got("MATCH (a:A)-[:R*1..2]->(c:C) WITH DISTINCT a, c RETURN c.name AS c, count(*) AS n") == [("00", 20), ("01", 20)]
    assert [x.count() for what, x in levels if what == "reach"] == [9, 40]  # before 200 pairs of A and B
    assert got("MATCH (a:A {name: '03'})-[:R*1..2]->(c:C) RETURN DISTINCT c.name AS c") == [("00",), ("01",)]
    assert got("MATCH (a:A)-[:R*0..3]->(x:A) WITH DISTINCT a, x RETURN x.name AS x, count(*) AS n")[:2] == [("00", 20), ("01", 1)]
    assert got("MATCH (a:B)-[:R*1..9]->(x) WITH DISTINCT a, x RETURN count(*) AS n") == [(5 * 13 + 4,)]
    assert got("MATCH (c:C)<-[:R*1..2]-(a:A) WITH DISTINCT a, c RETURN count(*) AS n") == [(40,)]
