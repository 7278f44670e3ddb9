"""Writes, dumps, generations and mutation streams."""

import pytest
from graphs import people

from lodegraph.engine import Engine
from lodegraph.operators.writes import WriteProblem
from lodegraph.sources.dump import DumpProblem, read_dump, write_dump
from lodegraph.sources.generations import publish, read, validated


def rows(e, query):
    return sorted((tuple(r) for r in e.run(query).collect()), key=repr)


def test_node_writes(spark):
    e = Engine(spark, people(spark))
    assert [tuple(r) for r in e.write("MERGE (p:Person {name: 'Dave'}) ON CREATE SET p.age = 50 ON MATCH SET p.age = 1 RETURN p.age AS a").collect()] == [(50,)]
    e.write("MERGE (p:Person {name: 'Alice'}) ON CREATE SET p.age = 50 ON MATCH SET p.age = 31 SET p.city = 'Rome'")
    got = e.write("UNWIND $rows AS r MERGE (p:Person {name: r.name}) SET p += r RETURN p.name AS n, p.age AS a", {"rows": [{"name": "Eve", "age": 7}, {"name": "Bob", "age": 26}, {"name": "Eve", "age": 8}]})
    assert [tuple(r) for r in got.collect()] == [("Eve", 8), ("Bob", 26), ("Eve", 8)]
    assert rows(e, "MATCH (p:Person) RETURN p.name AS n, p.age AS a, p.city AS c") == [("Alice", 31, "Rome"), ("Bob", 26, "London"), ("Carol", 40, "Paris"), ("Dave", 50, None), ("Eve", 8, None)]
    e.write("MATCH (p:Person {name: 'Bob'}) SET p:Company")
    assert rows(e, "MATCH (c:Company) RETURN c.name AS n") == [("Acme",), ("Bob",), ("Globex",)]
    assert rows(e, "MATCH (:Person {name: 'Bob'})-[:KNOWS]->(x) RETURN x.name AS n") == [("Carol",)]
    e.write("MATCH (p:Person {name: 'Dave'}) SET p = {city: 'X'}")
    assert rows(e, "MATCH (p:Person {name: 'Dave'}) RETURN p.age AS a, p.city AS c") == [(None, "X")]
    for bad in ("MATCH (p:Person {name: 'Zed'}) SET p.age = 1", "MERGE (p:Robot {name: 'x'})", "MERGE (p:Person {age: 3})", "MATCH (p:Person {name: 'Carol'}) DELETE p", "MATCH (p:Person {name: 'Carol'}) REMOVE p.name"):
        with pytest.raises(WriteProblem):
            e.write(bad)


def test_edge_writes(spark):
    e = Engine(spark, people(spark))
    e.write("MERGE (a:Person {name: 'Bob'})-[r:KNOWS]->(b:Person {name: 'Gil'}) SET r.since = 1")
    e.write("MERGE (a:Person {name: 'Bob'})-[r:KNOWS]->(b:Person {name: 'Gil'}) SET r.since = 2")
    e.write("MATCH (a:Person {name: 'Alice'})-[r:KNOWS]->(b:Person {name: 'Bob'}) DELETE r")
    assert rows(e, "MATCH (a)-[r:KNOWS]->(b) RETURN a.name AS a, b.name AS b, r.since AS s") == [("Alice", "Carol", None), ("Bob", "Carol", None), ("Bob", "Gil", 2)]
    e.write("MERGE (a:Person {name: 'Bob'})-[r:KNOWS {since: 3}]->(b:Person {name: 'Gil'})")
    assert rows(e, "MATCH ({name: 'Bob'})-[r:KNOWS]->({name: 'Gil'}) RETURN r.since AS s") == [(2,), (3,)]
    e.write("MATCH (p:Person {name: 'Carol'}) DETACH DELETE p")
    assert rows(e, "MATCH (a)-[r]->(b) RETURN count(*) AS c") == [(3,)]
    for bad in ("MERGE (a:Person {name: 'Bob'})-[r:NOPE]->(b:Person {name: 'Gil'})", "MATCH (a:Person {name: 'Bob'})-[r:KNOWS {since: 3}]->(b:Person {name: 'Gil'}) DELETE r"):
        with pytest.raises(WriteProblem):
            e.write(bad)


DUMP = """CREATE INDEX FOR (n:P) ON (n.k);
CREATE VECTOR INDEX FOR (n:P) ON (n.v) OPTIONS {dimension: 2, metric: 'euclidean'};
CREATE FULLTEXT INDEX FOR (n:P) ON EACH [n.name];
MERGE (n:P {k: 'a'}) SET n.name = 'it\\'s; fine', n.age = 1, n.v = vecf32([1, 2]);
MERGE (n:P {k: 'b'}) SET n.age = 2.5, n.tags = ['x', 'y'];
MERGE (n:P {k: 'a'}) SET n.age = 3, n.size = CASE WHEN n.age > 2 THEN 'big' ELSE 'small' END, n.twice = n.age * 2;
MERGE (n:Q {k: 7}) SET n:Extra;
MERGE (a:P {k: 'a'})-[r:R]->(b:P {k: 'b'}) SET r.w = 1;
MERGE (a:P {k: 'a'})-[r:R]->(b:P {k: 'b'}) SET r.w = 2;
MERGE (a:P {k: 'b'})-[r:S]->(b:Q {k: 7});
"""


def test_dump(spark, tmp_path):
    (tmp_path / "g.cypher").write_text(DUMP)
    g = validated(read_dump(spark, str(tmp_path / "g.cypher")))
    e = Engine(spark, g)
    assert rows(e, "MATCH (p:P) RETURN p.k AS k, p.name AS n, p.age AS a, p.tags AS t") == [("a", "it's; fine", 3.0, None), ("b", None, 2.5, ["x", "y"])]
    assert rows(e, "MATCH (a)-[r:R|S]->(b) RETURN type(r) AS t, r.w AS w") == [("R", 2), ("S", None)]
    assert rows(e, "MATCH (q:Extra) RETURN labels(q) AS l, q.k AS k") == [(["Extra", "Q"], 7)]
    assert rows(e, "MATCH (p:P {k: 'a'}) RETURN p.size AS s, p.twice AS t") == [("big", 6)]
    assert {(x.kind, x.label) for x in g.indexes} == {("range", "P"), ("vector", "P"), ("fulltext", "P")}


def test_dump_round_trip(spark, tmp_path):
    g = people(spark)
    write_dump(g, str(tmp_path / "out"))
    e = Engine(spark, read_dump(spark, str(tmp_path / "out" / "*")))
    for q in ("MATCH (p:Person) RETURN p.name AS n, p.age AS a, p.team AS t", "MATCH (a)-[r]->(b) RETURN a.name AS a, type(r) AS t, b.name AS b, r.since AS s"):
        assert rows(e, q) == rows(Engine(spark, g), q)


def test_dump_by_global_key(spark, tmp_path):
    (tmp_path / "g.cypher").write_text("CREATE (:A {__id__: 1, name: 'x'});\nCREATE (:B {__id__: 2});\nMATCH (a {__id__: 1}), (b {__id__: 2}) CREATE (a)-[:R {w: 1}]->(b);\nMATCH (a {__id__: 1}), (b {__id__: 2}) CREATE (a)-[:R {w: 1}]->(b);\n")
    e = Engine(spark, read_dump(spark, str(tmp_path / "g.cypher"), pk="__id__"))
    assert rows(e, "MATCH (a:A)-[r:R]->(b:B) RETURN a.name AS n, r.w AS w") == [("x", 1), ("x", 1)]


def test_bad_dumps(spark, tmp_path):
    for i, text in enumerate(("MATCH (n:P {k: 1}) SET n.a = 2;\n", "MATCH (a:P {k: 1})-[r:R]->(b:P {k: 2}) SET r.w = 1;\nMERGE (n:P {k: 1});\nMERGE (n:P {k: 2});\n")):
        (tmp_path / f"{i}.cypher").write_text(text)
        with pytest.raises(DumpProblem):
            read_dump(spark, str(tmp_path / f"{i}.cypher"))


def test_generations(spark, tmp_path):
    e = Engine(spark, people(spark))
    root = str(tmp_path / "graph")
    assert publish(e.graph, root) == "v1"
    e.write("MERGE (p:Person {name: 'Dave'})")
    assert publish(e.graph, root) == "v2"
    count = "MATCH (p:Person) RETURN count(*) AS c"
    assert rows(Engine(spark, read(spark, root)), count) == [(4,)] and rows(Engine(spark, read(spark, root, "v1")), count) == [(3,)]


def test_stream(spark, tmp_path):
    from lodegraph.streaming.mutations import apply

    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"name": "Alice", "age": 1}\n{"name": "New", "age": 2}\n')
    e = Engine(spark, people(spark))
    stream = spark.readStream.schema("name string, age bigint").json(str(source))
    apply(e, stream, "UNWIND $rows AS r MERGE (p:Person {name: r.name}) SET p.age = r.age", str(tmp_path / "state"), once=True).awaitTermination(120)
    assert rows(e, "MATCH (p:Person) RETURN p.name AS n, p.age AS a") == [("Alice", 1), ("Bob", 25), ("Carol", 40), ("New", 2)]
