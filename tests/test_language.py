"""Expressions and clauses: query text against exact rows."""

import math

import pytest
from graphs import people

from lodegraph.engine import Engine
from lodegraph.plans.parser import SyntaxProblem, parse
from lodegraph.plans.types import TypeProblem


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, people(spark))


def rows(engine, query, **params):
    return [tuple(r) for r in engine.run(query, params).collect()]


#: One projection for many expressions: text and value.
VALUES = [
    ("1.0/0.0", math.inf), ("-1.0/0.0", -math.inf), ("log(0.0)", -math.inf), ("log(null)", None),
    ("range(5,1)", []), ("range(5,1,-2)", [5, 3, 1]), ("trim('\\t a \\n')", "a"), ("toString(1.0)", "1"), ("'x' + 2.0", "x2"),
    ("substring('abc',1,1)", "b"), ("[1,2,3][-1]", 3), ("[1,2,3][0..2]", [1, 2]), ("split('a.b.','.')", ["a", "b", ""]), ("split('ab','')", ["", "a", "b", ""]),
    ("string.replaceRegex('aXb','X','$0')", "a$0b"), ("abs(-5)", 5.0), ("toBoolean('yes')", None), ("1 = 'a'", False), ("1 < 'a'", None),
    ("toString(date('2023-01-31') + duration('P1M'))", "2023-03-03"), ("null IN []", False), ("2 IN [1, null]", None), ("2 IN [2, null]", True),
    ("0.0/0.0 = 0.0/0.0", False), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("-2^2", 4.0), ("2 ^ 3 ^ 2", 64.0), ("017", 15), ("0xff", 255), ("1 = 1.0", True),
    ("true XOR false AND false", True), ("NOT null", None), ("null AND false", False), ("'a\\nb' =~ 'a'", False), ("'abc' =~ 'a.c'", True),
    ("toInteger('3.9')", None), ("toInteger(3.9)", 3), ("toInteger(true)", 1), ("toFloat('x')", None), ("sign(0)", 1.0), ("size('héllo')", 5),
    ("list.remove([1,2,3], -1)", [1, 2]), ("list.insert([1,3], 1, 2)", [1, 2, 3]), ("list.insert([1,3], 9, 2)", [1, 3]), ("list.dedup([1,2,1])", [1, 2]), ("list.sort([3,null,1])", [None, 1, 3]),
    ("list.insertListElements([1,2],[2,3,3],1,false)", [1, 3, 2]), ("head([])", None), ("tail([1])", []), ("reverse([1,2])", [2, 1]), ("[1] + 2", [1, 2]), ("[1] + [2.5]", [1.0, 2.5]),
    ("any(x IN [1,null] WHERE x = 1)", True), ("all(x IN [] WHERE x = 1)", True), ("single(x IN [1,null] WHERE x = 1)", True), ("none(x IN [null] WHERE x = 1)", None),
    ("reduce(s = 0, x IN [1,2.5] | s + x)", 3.5), ("[x IN range(1,4) WHERE x % 2 = 0 | x * 10]", [20, 40]), ("CASE 1 WHEN 1.0 THEN 'y' END", "y"), ("CASE WHEN null THEN 1 ELSE 2 END", 2),
    ("{a: 1, b: 'x'}.b", "x"), ("{a: 1}['a']", 1), ("'abcdef'[1..-1]", "bcde"), ("typeOf([1])", "List"), ("CAST('12' AS INTEGER)", 12), ("coalesce(null, 2)", 2),
    ("toString(duration('PT0S'))", "P"), ("duration('P1Y2M').months", 2.0), ("date('2023-W01-1').day", 2), ("date('19841021').dayOfQuarter", 23), ("date('1984-10-21').dayOfWeek", 0), ("date('nope')", None),
    ("toString(localdatetime('2020-01-02T03:04'))", "2020-01-02T03:04:00"), ("toString(localtime('10:20:30'))", "10:20:30"), ("localtime('10:20').minute", 20), ("toString(date({year: 2020, month: 2, day: 30}))", "2020-03-01"),
    ("toString(duration({hours: 25}))", "P1DT1H"), ("distance(point({latitude: 0, longitude: 0}), point({latitude: 0, longitude: 0}))", 0.0), ("vec.euclideanDistance(vecf32([0,0]), vecf32([3,4]))", 5.0), ("vec.cosineSimilarity(vecf32([1,0]), vecf32([0,0]))", 0.0),
    ("string.matchRegex('a1b2', '([a-z])([0-9])')", [["a1", "a", "1"], ["b2", "b", "2"]]), ("string.join(['a','b'], '-')", "a-b"), ("left('abc', 9)", "abc"), ("toString(1e21)", "1000000000000000000000"), ("toString(0.00001)", "0.00001"), ("toStringList([1, 2.5])", ["1", "2.5"]), ("isEmpty('')", True), ("round(-2.5)", -3.0), ("haversin(0)", 0.0),
]


def test_values(engine):
    got = rows(engine, "RETURN " + ", ".join(f"{text} AS v{i}" for i, (text, _) in enumerate(VALUES)))[0]
    wrong = [(text, g, want) for (text, want), g in zip(VALUES, got) if g != want or type(g) is not type(want)]
    assert not wrong
    assert math.isnan(rows(engine, "RETURN log(-1.0) AS x")[0][0])


@pytest.mark.parametrize("text", ["1 / 0", "toInteger(0.0/0.0)", "range(1, 5, 0)", "left('a', -1)", "9223372036854775807 + 1", "point({latitude: 91, longitude: 0})", "range(0, 2000000)", "vec.euclideanDistance(vecf32([1]), vecf32([1,2]))", "date('2020-01-01').nothing", "nope(1)", "1 - 'a'", "sum(count(*))", "$missing", "string.join([1, 2])", "'a' =~ '" + "a" * 1025 + "'"])
def test_errors(engine, text):
    with pytest.raises(Exception):
        rows(engine, f"RETURN {text} AS x")


@pytest.mark.parametrize("query", [
    "MATCH (n:Person {name: 'x'})-[r:KNOWS|WORKS_AT*1..3 {a: 1}]->(m) WHERE n.a >= 1 AND NOT m.b RETURN n, r SKIP 1 LIMIT 2",
    "MATCH (n) RETURN n.end, n.`odd name`", "MATCH (a)–[:R]-(b) RETURN a", "RETURN 1 // c\n, /* x */ 2;",
    "MATCH p = SIMPLE (a)-[*..4]-(b) RETURN p", "MATCH ((x)-[:R]->(y)){1,3} RETURN 1", "UNWIND [1] AS x WITH x WHERE x > 0 RETURN DISTINCT x ORDER BY x DESC",
    "CALL { MATCH (n) RETURN n UNION ALL MATCH (n) RETURN n } RETURN n", "RETURN [x IN xs] AS one", "MATCH (n:A|B&!C) RETURN n", "RETURN {a: 1}.a", "CALL db.labels()",
])
def test_accepted(query):
    parse(query)


@pytest.mark.parametrize("query", ["MATCH (n", "RETURN", "MATCH (a)<-[:R]->(b) RETURN a", "RETURN 08", "MATCH ACYCLIC (a)-[:R]->(b) RETURN a", "CREATE (n) RETURN n", "MATCH (n) SET n.a = 1", "RETURN '\\q'", "MATCH (a) RETURN a LIMIT", "RETURN " + "(" * 200 + "1" + ")" * 200])
def test_rejected(query):
    with pytest.raises(SyntaxProblem):
        parse(query)


def test_unwind_and_union(engine):
    assert rows(engine, "UNWIND [1, 1.0] AS x RETURN DISTINCT x") == [(1.0,)]
    assert rows(engine, "UNWIND null AS x RETURN x") == []
    assert rows(engine, "UNWIND 5 AS x RETURN x") == [(5,)]
    assert sorted(rows(engine, "RETURN 1 AS x UNION ALL RETURN 1 AS y UNION RETURN 2 AS z")) == [(1,), (2,)]
    with pytest.raises(TypeProblem):
        rows(engine, "RETURN 1 AS x UNION RETURN 1 AS x, 2 AS y")


def test_aggregates(engine):
    q = "UNWIND [2,4,6,8,10] AS x RETURN " + ", ".join(f"percentileCont(x, {p}) AS c{i}, percentileDisc(x, {p}) AS d{i}" for i, p in enumerate((0, 0.1, 0.33, 0.5, 1)))
    got = rows(engine, q)[0]
    assert [round(x, 9) for x in got[::2]] == [2, 2.8, 4.64, 6, 10] and list(got[1::2]) == [2, 2, 4, 6, 10]
    assert rows(engine, "UNWIND [] AS x RETURN count(x) AS c, sum(x) AS s, stDev(x) AS d, percentileCont(x, 0.5) AS p, collect(x) AS l") == [(0, 0, 0.0, None, [])]
    assert rows(engine, "UNWIND [3] AS x RETURN stDev(x) AS d, stDevP(x) AS p") == [(0.0, 0.0)]
    assert rows(engine, "UNWIND [1, null, 3] AS x RETURN count(*) AS a, count(x) AS b, collect(x) AS c, avg(x) AS d, count(*) + sum(x) AS e") == [(3, 2, [1, 3], 2.0, 7)]
    assert rows(engine, "MATCH (p:Person) RETURN p.city AS c, count(*) AS n ORDER BY n DESC, c") == [("London", 2), ("Paris", 1)]


def test_order_limit_params(engine):
    assert rows(engine, "MATCH (p:Person) RETURN p.name AS n ORDER BY p.age DESC SKIP 1 LIMIT $k", k=1) == [("Alice",)]
    assert rows(engine, "MATCH (p:Person) WHERE p.name IN $names RETURN count(*) AS c", names=["Bob", "Zed"]) == [(1,)]
    assert rows(engine, "MATCH (p:Person) RETURN p.team AS t ORDER BY t LIMIT 1") == [(None,)]
    with pytest.raises(TypeProblem):
        rows(engine, "MATCH (p:Person) RETURN p.name AS n LIMIT p.age")


def test_entities(engine):
    r = engine.run("MATCH (p:Person {name: 'Alice'})-[k:KNOWS {since: 2020}]->(b) RETURN p, k, b.name").first()
    assert r["p"]["labels"] == ["Person"] and r["p"]["properties"]["age"] == 30 and r["k"]["type"] == "KNOWS" and r["b.name"] == "Bob"
    assert rows(engine, "MATCH (p:Person {name: 'Carol'}) RETURN keys(p) AS k") == [(["age", "city", "embedding", "name"],)]
    assert rows(engine, "MATCH (p:Person {name: 'Bob'}) RETURN p{.name, x: p.age + 1} AS m")[0][0].asDict() == {"name": "Bob", "x": 26}


def test_engine_options(spark, engine):
    import json

    assert json.loads(engine.json("MATCH (p:Person) RETURN p.name AS n ORDER BY n LIMIT 1")) == {"columns": ["n"], "rows": [["Alice"]]}
    with pytest.raises(ValueError):
        Engine(spark, people(spark), max_rows=2).run("MATCH (n) RETURN n.name AS n")
    two = Engine(spark, people(spark), {"other": people(spark)})
    assert rows(two, "USE other MATCH (n:Company) RETURN count(*) AS c") == [(2,)]
    assert [r[0] for r in two.run("SHOW INDEXES").select("type").distinct().orderBy("type").collect()] == ["fulltext", "range", "vector"]
    assert {r["label"] for r in two.run("CALL db.labels()").collect()} == {"Person", "Company"}
