"""Small graphs as literal frames."""

from lodegraph.model import SHIFT, EdgeTable, Index, NodeTable, PropertyGraph

N = 1 << SHIFT
#: The smallest of the driver's tables.
SF = "/root/testdata/sf0.001"


def people(spark):
    """Three persons, two companies; KNOWS 0->1, 1->2, 0->2, WORKS_AT 0->3, 2->4."""
    p = spark.createDataFrame([(0, "Alice", 30, "London", "Red", [0.1, 0.2, 0.3]), (1, "Bob", 25, "London", "Red", [0.2, 0.1, 0.0]), (2, "Carol", 40, "Paris", None, [0.9, 0.8, 0.7])], "id bigint, name string, age bigint, city string, team string, embedding array<float>")
    c = spark.createDataFrame([(N + 3, "Acme"), (N + 4, "Globex")], "id bigint, name string")
    knows = spark.createDataFrame([(0, 0, 1, 2020, "alpha shared"), (1, 1, 2, None, "beta shared"), (4, 0, 2, None, "gamma shared")], "id bigint, src bigint, dst bigint, since bigint, fact string")
    works = spark.createDataFrame([(N + 2, 0, N + 3), (N + 3, 2, N + 4)], "id bigint, src bigint, dst bigint")
    indexes = (
        Index("range", "node", "Person", ("name",)), Index("range", "node", "Company", ("name",)), Index("vector", "node", "Person", ("embedding",), "cosine", 3),
        Index("fulltext", "node", "Person", ("name", "city"), stopwords=("the",)), Index("fulltext", "relationship", "KNOWS", ("fact",)),
    )
    return PropertyGraph(spark, (NodeTable(("Person",), p, "name"), NodeTable(("Company",), c, "name")), (EdgeTable("KNOWS", knows, (0,), (0,)), EdgeTable("WORKS_AT", works, (0,), (1,))), indexes)


def plain(spark, names, edges):
    """Nodes N{name} and relationships R between them, by name."""
    at = {n: i for i, n in enumerate(names)}
    nodes = spark.createDataFrame([(i, n) for n, i in at.items()], "id bigint, name string")
    rels = spark.createDataFrame([(i, at[a], at[b]) for i, (a, b) in enumerate(edges)], "id bigint, src bigint, dst bigint")
    return PropertyGraph(spark, (NodeTable(("N",), nodes, "name"),), (EdgeTable("R", rels, (0,), (0,)),), (Index("range", "node", "N", ("name",)),))


def cycle(spark):
    return plain(spark, "abc", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b")])


def diamond(spark):
    return plain(spark, "sabct", [("s", "a"), ("s", "b"), ("a", "t"), ("b", "t"), ("a", "c"), ("c", "t")])


def multigraph(spark):
    return plain(spark, "abc", [("a", "b"), ("a", "b"), ("a", "b"), ("a", "c"), ("b", "c")])
