"""Ids, numbers and published generations."""

import pytest
from graphs import SF, people
from pyspark.sql import functions as F

from lodegraph.engine import Engine
from lodegraph.model import SHIFT, local_ids, numbered
from lodegraph.operators.knn import checked
from lodegraph.queries import QUERIES, graph
from lodegraph.sources import generations
from lodegraph.storage import stored


@pytest.mark.parametrize("key", [0, 1, (1 << 40) + 5, (1 << SHIFT) - 1])
def test_ids_hold_keys(spark, key):
    made = spark.range(1).select(local_ids(3, F.lit(key)).alias("id")).first()["id"]
    assert made >> SHIFT == 3 and made & (1 << SHIFT) - 1 == key


@pytest.mark.parametrize("key", [-1, 1 << SHIFT, -(1 << 62)])
def test_ids_of_other_tables_are_refused(spark, key):
    with pytest.raises(Exception, match="doesn't fit"):
        spark.range(1).select(local_ids(3, F.lit(key)).alias("id")).collect()
    assert spark.range(1).select(local_ids(3, F.lit(None)).alias("id")).first()["id"] is None


def test_seeks_take_the_ids_that_queries_return(spark):
    """Whatever the layout of ids, the registered seek asks for these two nations."""
    e = Engine(spark, graph(spark, SF))
    nations = {r.i: r.name for r in e.run("MATCH (n:Nation) WHERE n.nationkey IN [1, 3] RETURN id(n) AS i, n.name AS name").collect()}
    assert len(nations) == 2 and sorted(r.name for r in QUERIES["s5_id_seek"](spark, SF).collect()) == sorted(nations.values())
    for i, name in nations.items():
        assert [r.name for r in e.run(f"MATCH (n) WHERE id(n) = {i} RETURN n.name AS name").collect()] == [name]


def test_numbers_are_dense(spark):
    rows = stored(spark.range(0, 1000, 1, 13).where("id % 7 <> 0"), "numbers")
    assert sorted(r["__n"] for r in numbered(rows).collect()) == list(range(rows.count()))
    assert numbered(rows.where("id < 0")).count() == 0


def test_pointer_is_never_absent(spark, tmp_path, monkeypatch):
    """A writer that stops before or within the last step leaves the old version current."""
    root = f"file://{tmp_path}/g"
    g = people(spark)
    assert generations.publish(g, root) == "v1"
    whole = generations._replace
    for at in ("manifest.json", "current"):

        def stops(spark, aside, there, at=at):
            if there.getName() == at:
                raise RuntimeError("stopped")
            whole(spark, aside, there)

        monkeypatch.setattr(generations, "_replace", stops)
        with pytest.raises(RuntimeError):
            generations.publish(g, root)
        assert generations.read(spark, root).version == 1
    monkeypatch.setattr(generations, "_replace", whole)
    assert generations.publish(g, root) == "v4"  # versions that were claimed aren't taken again
    assert generations.read(spark, root).version == 4


def test_two_writers_take_two_versions(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    assert {generations._claimed(spark, root) for _ in range(3)} == {"v1", "v2", "v3"}


@pytest.mark.parametrize("vector", ["[1.0D, double('NaN'), 0.0D]", "[double('Infinity')]", "[1.0D, NULL]", "[1.0D]"])
def test_query_vectors_are_checked(spark, vector):
    with pytest.raises(Exception):
        spark.range(1).select(checked(F.expr(f"cast(array({vector[1:-1]}) as array<float>)"), 2)).collect()


def test_no_cross_join_where_sides_are_linked(spark):
    e = Engine(spark, people(spark))
    for query in ("MATCH (a:Person), (b:Person) WHERE a.city = b.city RETURN count(*) AS n", "MATCH (a:Person)-[:KNOWS]->(b:Person) MATCH (c:Company)<-[:WORKS_AT]-(a) RETURN b.name AS b, c.name AS c"):
        plan = e.run(query)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
