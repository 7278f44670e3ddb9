"""Patterns, paths and procedures over small graphs."""

import pytest
from graphs import cycle, diamond, multigraph, people, plain

from lodegraph.engine import Engine
from lodegraph.plans.compiler import Demand, Planner
from lodegraph.plans.parser import parse
from lodegraph.plans.types import TypeProblem


def rows(spark, graph, query, **params):
    return sorted((tuple(r) for r in Engine(spark, graph).run(query, params).collect()), key=repr)


def test_hops(spark):
    g = people(spark)
    assert rows(spark, g, "MATCH (a {name: 'Alice'})-[:KNOWS]->(b) RETURN b.name AS n") == [("Bob",), ("Carol",)]
    assert rows(spark, g, "MATCH (a:Person)--(b) RETURN count(*) AS c") == [(8,)]
    assert rows(spark, g, "MATCH (a)-[r]->(b:Company) RETURN type(r) AS t, a.name AS n") == [("WORKS_AT", "Alice"), ("WORKS_AT", "Carol")]
    assert rows(spark, g, "MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN a.name AS a, c.name AS c") == [("Alice", "Carol")]
    assert rows(spark, g, "MATCH (a)-[:KNOWS]-(b)-[:KNOWS]-(a) RETURN count(*) AS c") == [(0,)]  # no relationship twice
    assert rows(spark, g, "MATCH (a)-[:KNOWS]->(b), (a)-[:KNOWS]->(c) RETURN count(*) AS c") == [(5,)]  # but across patterns


def test_self_loop_counts_twice(spark):
    g = plain(spark, "ab", [("a", "a"), ("a", "b")])
    assert rows(spark, g, "MATCH (x {name: 'a'})--(y) RETURN count(*) AS c") == [(3,)]


def test_optional_and_subqueries(spark):
    g = people(spark)
    assert rows(spark, g, "MATCH (p:Person) OPTIONAL MATCH (p)-[:WORKS_AT]->(c) RETURN p.name AS n, c.name AS c") == [("Alice", "Acme"), ("Bob", None), ("Carol", "Globex")]
    assert rows(spark, g, "MATCH (p:Person) OPTIONAL MATCH (p)-[:WORKS_AT]->(c) WHERE c.name = 'Acme' OPTIONAL MATCH (c)<-[:WORKS_AT]-(q) RETURN p.name AS n, q.name AS q") == [("Alice", "Alice"), ("Bob", None), ("Carol", None)]
    assert rows(spark, g, "MATCH (p:Person) WHERE NOT (p)-[:WORKS_AT]->() RETURN p.name AS n") == [("Bob",)]
    assert rows(spark, g, "MATCH (p:Person) WHERE EXISTS { (p)-[:KNOWS]->(q) WHERE q.age > p.age } RETURN p.name AS n") == [("Alice",), ("Bob",)]
    assert rows(spark, g, "MATCH (p:Person) RETURN p.name AS n, list.sort([(p)-[:KNOWS]->(q) | q.name]) AS l") == [("Alice", ["Bob", "Carol"]), ("Bob", ["Carol"]), ("Carol", [])]
    assert rows(spark, g, "MATCH (p:Person) CALL { WITH p MATCH (p)-[:KNOWS]->(q) RETURN count(q) AS c } RETURN p.name AS n, c") == [("Alice", 2), ("Bob", 1), ("Carol", 0)]
    assert rows(spark, g, "MATCH (p:Person) RETURN p.name AS n, indegree(p) AS i, outdegree(p, 'KNOWS') AS o") == [("Alice", 0, 2), ("Bob", 1, 1), ("Carol", 2, 0)]
    with pytest.raises(TypeProblem):
        rows(spark, g, "MATCH (p:Person) CALL { WITH p RETURN p.age AS p } RETURN p")


@pytest.mark.parametrize("restrictor, count", [("WALK", 6), ("TRAIL", 4), ("", 4), ("SIMPLE", 3), ("ACYCLIC", 2)])
def test_restrictors(spark, restrictor, count):
    assert rows(spark, cycle(spark), f"MATCH {restrictor} (a {{name: 'a'}})-[:R*1..4]->(x) RETURN count(*) AS c") == [(count,)]


def test_variable_length(spark):
    g = plain(spark, "abcdefgh", list(zip("abcdefg", "bcdefgh")))
    assert rows(spark, g, "MATCH (a {name: 'a'})-[:R*]->(x) RETURN count(*) AS c") == [(7,)]
    assert rows(spark, g, "MATCH (a {name: 'a'})-[:R*0..1]->(x) RETURN x.name AS n") == [("a",), ("b",)]
    assert rows(spark, g, "MATCH (a {name: 'a'})-[:R*3..2]->(x) RETURN count(*) AS c") == [(0,)]
    assert rows(spark, g, "MATCH p = (a {name: 'a'})-[:R*2]->(x)-[:R]->(y) RETURN [n IN nodes(p) | n.name] AS ns, length(p) AS l") == [(["a", "b", "c", "d"], 3)]
    assert rows(spark, g, "MATCH (x)<-[rs:R*2]-(a {name: 'a'}) RETURN x.name AS n, size(rs) AS s") == [("c", 2)]
    # other spellings agree
    want = rows(spark, g, "MATCH (a)-[:R*1..3]->(b) RETURN a.name AS a, b.name AS b")
    assert want == rows(spark, g, "MATCH (a) ((x)-[:R]->(y)){1,3} (b) RETURN a.name AS a, b.name AS b")
    assert want == rows(spark, g, "MATCH (a)-[:R]->(b) RETURN a.name AS a, b.name AS b UNION ALL MATCH (a)-[:R]->()-[:R]->(b) RETURN a.name AS a, b.name AS b UNION ALL MATCH (a)-[:R]->()-[:R]->()-[:R]->(b) RETURN a.name AS a, b.name AS b")
    assert want == rows(spark, g, "MATCH (a)-[:R*1..3]->(b) RETURN DISTINCT a.name AS a, b.name AS b")


def test_shortest(spark):
    g = diamond(spark)
    assert rows(spark, g, "MATCH p = ALL SHORTEST (s {name: 's'})-[:R*]->(t {name: 't'}) RETURN length(p) AS l") == [(2,), (2,)]
    assert rows(spark, g, "MATCH p = SHORTEST 3 (s {name: 's'})-[:R*]->(t {name: 't'}) RETURN length(p) AS l") == [(2,), (2,), (3,)]
    assert rows(spark, g, "MATCH p = ANY SHORTEST (s {name: 's'})-[:R*]->(t) RETURN t.name AS t, length(p) AS l") == [("a", 1), ("b", 1), ("c", 2), ("t", 2)]
    assert rows(spark, g, "MATCH (s {name: 's'}), (t {name: 't'}) RETURN length(shortestPath((s)-[:R*]->(t))) AS l, shortestPath((t)-[:R*]->(s)) IS NULL AS n") == [(2, True)]
    with pytest.raises(TypeProblem):
        rows(spark, g, "MATCH ANY SHORTEST (s)-[:R*2..3]->(t) RETURN s")


def test_procedures(spark):
    g = people(spark)
    ranks = dict(rows(spark, g, "CALL algo.pageRank(null, null) YIELD node, score RETURN node.name AS n, round(score * 1000000) AS s"))
    assert ranks == {"Alice": 111621, "Bob": 143247, "Carol": 265007, "Acme": 143247, "Globex": 336877}
    assert dict(rows(spark, g, "CALL algo.pageRank('Person', 'KNOWS') YIELD node, score RETURN node.name AS n, round(score * 1000000) AS s")) == {"Alice": 197580, "Bob": 281551, "Carol": 520869}
    assert dict(rows(spark, g, "CALL algo.betweenness() YIELD node, score RETURN node.name AS n, score")) == {"Alice": 0.0, "Bob": 0.0, "Carol": 2.0, "Acme": 0.0, "Globex": 0.0}
    assert rows(spark, g, "CALL algo.HarmonicCentrality({nodeLabels: ['Person'], relationshipTypes: ['KNOWS']}) YIELD node, score, reachable RETURN node.name AS n, score, reachable") == [("Alice", 2.0, 2), ("Bob", 1.0, 1), ("Carol", 0.0, 0)]
    assert rows(spark, g, "CALL algo.WCC() YIELD componentId RETURN count(DISTINCT componentId) AS c") == [(1,)]
    assert rows(spark, g, "CALL algo.WCC({relationshipTypes: ['KNOWS']}) YIELD componentId RETURN count(DISTINCT componentId) AS c") == [(3,)]
    assert rows(spark, g, "CALL algo.labelPropagation({relationshipTypes: ['KNOWS']}) YIELD node, communityId RETURN node.name AS n, communityId AS c")[:2] == [("Acme", (1 << 48) + 3), ("Alice", 0)]
    assert rows(spark, g, "MATCH (a:Person {name: 'Alice'}) CALL algo.BFS(a, 0, 'KNOWS') YIELD nodes RETURN list.sort([n IN nodes | n.name]) AS l") == [(["Bob", "Carol"],)]
    assert rows(spark, g, "MATCH (a:Person {name: 'Carol'}) CALL algo.BFS(a, 0, 'KNOWS') YIELD nodes RETURN nodes") == []
    near = rows(spark, g, "MATCH (a:Person {name: 'Alice'}) CALL db.idx.vector.queryNodes('Person', 'embedding', 2, a.embedding) YIELD node, score RETURN node.name AS n, round(score * 1000000) AS s")
    assert near == [("Alice", 0.0), ("Carol", 117341.0)]
    assert rows(spark, g, "CALL db.idx.vector.queryNodes('Person', 'embedding', 1, vecf32([0.9, 0.8, 0.7])) YIELD node RETURN node.name AS n") == [("Carol",)]
    hits = rows(spark, g, "CALL db.idx.fulltext.queryNodes('Person', 'london | alice') YIELD node, score RETURN node.name AS n, score > 0 AS s")
    assert hits == [("Alice", True), ("Bob", True)]
    assert rows(spark, g, "CALL db.idx.fulltext.queryNodes('Person', '(@city:\"Paris\") (carol | london)') YIELD node RETURN node.name AS n") == [("Carol",)]
    assert rows(spark, g, "CALL db.idx.fulltext.queryRelationships('KNOWS', 'beta') YIELD relationship AS r RETURN r.fact AS f") == [("beta shared",)]
    assert rows(spark, g, "CALL db.meta.stats() YIELD nodeCount, relCount RETURN nodeCount, relCount") == [(5, 5)]
    for bad in ("CALL algo.WCC({nope: 1}) YIELD node RETURN node", "CALL db.idx.vector.queryNodes('Company', 'embedding', 1, vecf32([1])) YIELD node RETURN node", "CALL nope.x() YIELD a RETURN a"):
        with pytest.raises(TypeProblem):
            rows(spark, g, bad)


def test_parallel_edges(spark):
    g = multigraph(spark)
    assert rows(spark, g, "MATCH (a {name: 'a'})-[:R]->(b) RETURN b.name AS n, count(*) AS c") == [("b", 3), ("c", 1)]
    assert rows(spark, g, "MATCH (n) RETURN n.name AS n, outdegree(n) AS o") == [("a", 4), ("b", 1), ("c", 0)]
    assert rows(spark, g, "MATCH (a)-[:R]->(b)-[:R]->(c) RETURN count(*) AS c") == [(3,)]


def test_comma_patterns_are_counted_apart(spark):
    """Five edges into a node and five out of it: 25 rows counted, none of them made."""
    edges = [(x, "h") for x in "abcde"] + [("h", x) for x in "vwxyz"] + [("a", "b"), ("c", "b")]
    g = plain(spark, "habcdevwxyz", edges)
    ends = "MATCH (a)-[:R]->(n), (n)-[:R]->(b)"
    planner, query = Planner(g), parse(f"{ends} RETURN n.name AS n, count(*) AS c")
    planner._demand = Demand.of(query)
    counted = planner._factored(*query.parts[0], planner.unit())
    assert sorted(r[counted.weight] for r in counted.df.collect()) == [2, 25]
    both = [(a, n, b) for a, n in edges for m, b in edges if m == n]
    assert rows(spark, g, f"{ends} RETURN n.name AS n, count(*) AS c, count(b) AS d, count(DISTINCT a) AS e, min(b.name) AS f") == [(n, sum(x[1] == n for x in both), sum(x[1] == n for x in both), len({x[0] for x in both if x[1] == n}), min(x[2] for x in both if x[1] == n)) for n in "bh"]
    assert rows(spark, g, f"{ends} RETURN count(*) + 1 AS c") == [(len(both) + 1,)]
    assert rows(spark, g, f"{ends} WHERE a.name > 'b' AND b.name > 'v' RETURN a.name AS a, count(*) AS c ORDER BY c LIMIT 9") == [(x, sum(a == x and b > "v" for a, _, b in both)) for x in "cde"]
    assert rows(spark, g, f"{ends} WHERE a.name < n.name AND a.name < b.name RETURN count(*) AS c") == [(sum(a < n and a < b for a, n, b in both),)]
    assert rows(spark, g, f"{ends}, (n)-[:R]->(c), (d {{name: 'b'}}) RETURN count(*) AS c") == [(5 * 25 + 2,)]
    assert rows(spark, g, "MATCH (a {name: 'a'}), (b {name: 'none'}) RETURN count(*) AS c") == [(0,)]
