"""Text dumps of graphs: statements to a graph, and a graph to statements.

Statements end with ``;`` at a line's end. Each is parsed by itself in a task;
what they say of one node or relationship is folded by key, the last value of a
property winning, by aggregates that combine before they shuffle.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SHIFT, EdgeTable, Index, NodeTable, PropertyGraph, numbered
from ..plans import ast as A
from ..plans import types as T
from ..plans.parser import Parser
from ..plans.writeparser import WriteParser
from ..storage import stored

_FACTS = "kind string, a string, b string, name string, ident string, labels array<string>, props map<string,string>, strict boolean, ddl string"
_RANGE = re.compile(r"CREATE\s+(?:RANGE\s+)?INDEX\s+(?:\w+\s+)?(?:ON\s+:\s*(\w+)\s*\(\s*(\w+)\s*\)|FOR\s+\(\s*\w*\s*:\s*(\w+)\s*\)\s+ON\s+\(\s*\w+\.(\w+)\s*\)|FOR\s+\(\s*\)-\[\s*\w*\s*:\s*(\w+)\s*\]-\(\s*\)\s+ON\s+\(\s*\w+\.(\w+)\s*\))", re.I)
_VECTOR = re.compile(r"CREATE\s+VECTOR\s+INDEX\s+(?:\w+\s+)?FOR\s+\(\s*\w*\s*:\s*(\w+)\s*\)\s+ON\s+\(\s*\w+\.(\w+)\s*\)(?:\s+OPTIONS\s*(\{.*\}))?", re.I | re.S)
_TEXT = re.compile(r"CREATE\s+FULLTEXT\s+INDEX\s+(?:\w+\s+)?FOR\s+\(\s*\w*\s*:\s*(\w+)\s*\)\s+ON\s+EACH\s*\[([^\]]*)\]", re.I)


class DumpProblem(ValueError):
    pass


_PURE = {
    "tolower": str.lower, "toupper": str.upper, "trim": str.strip, "reverse": lambda x: x[::-1], "size": len, "tofloat": float, "tointeger": lambda x: int(float(x)) if not isinstance(x, str) else int(x),
    "tostring": lambda x: str(x).lower() if isinstance(x, bool) else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x), "abs": lambda x: float(abs(x)), "head": lambda x: x[0] if x else None, "last": lambda x: x[-1] if x else None,
}


def constant(e: A.Expr, known: dict | None = None):
    """The value of a statement's expression. It may read what the statement
    itself says of the node or relationship, in ``known``; nulls spread."""
    value = lambda x: constant(x, known)
    if isinstance(e, A.Lit):
        return e.value
    if isinstance(e, A.Prop) and isinstance(e.base, A.Var) and known is not None:
        if e.key not in known:
            raise DumpProblem(f"the statement does not say what {e.key} is")
        return known[e.key]
    if isinstance(e, A.ListLit):
        return [value(x) for x in e.items]
    if isinstance(e, A.Un):
        x = value(e.x)
        return None if x is None else not x if e.op == "NOT" else -x
    if isinstance(e, A.IsNull):
        return (value(e.x) is None) != e.negated
    if isinstance(e, A.Case):
        for test, then in e.whens:
            hit = value(test) if e.subject is None else value(e.subject) is not None and value(e.subject) == value(test)
            if hit is True:
                return value(then)
        return None if e.other is None else value(e.other)
    if isinstance(e, A.Call):
        name = e.name.lower()
        if name == "vecf32":
            return {"vec": [float(x) for x in value(e.args[0])]}
        if name == "coalesce":
            return next((x for x in map(value, e.args) if x is not None), None)
        if name in _PURE and len(e.args) == 1:
            x = value(e.args[0])
            return None if x is None else _PURE[name](x)
    if isinstance(e, A.Bin):
        a, b = value(e.a), value(e.b)
        if e.op == "AND":
            return False if a is False or b is False else None if None in (a, b) else True
        if e.op == "OR":
            return True if a is True or b is True else None if None in (a, b) else False
        if a is None or b is None:
            return None
        ints = isinstance(a, int) and isinstance(b, int)
        made = {
            "+": lambda: _PURE["tostring"](a) + _PURE["tostring"](b) if isinstance(a, str) or isinstance(b, str) else a + b, "-": lambda: a - b, "*": lambda: a * b,
            "/": lambda: (abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1) if ints else a / b, "%": lambda: int(math.fmod(a, b)) if ints else math.fmod(a, b), "=": lambda: a == b, "<>": lambda: a != b,
            "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "IN": lambda: a in b, "CONTAINS": lambda: b in a, "STARTS": lambda: a.startswith(b), "ENDS": lambda: a.endswith(b),
        }
        if e.op in made:
            return made[e.op]()
    raise DumpProblem("a dump's values are constants, or follow from the statement")


def _names(e: A.LabelExpr | None) -> list[str]:
    if e is None:
        return []
    return [e.args[0]] if e.op == "name" else [n for a in e.args for n in _names(a)]


def facts(statement: str, pk: str | None) -> list[tuple]:
    """What one statement says, as rows of ``_FACTS``."""
    text = statement.strip()
    if not text or text.startswith("//"):
        text = re.sub(r"^(\s*//[^\n]*\n?)*", "", text).strip()
        if not text:
            return []
    if re.match(r"CREATE\s+(?:(?:RANGE|VECTOR|FULLTEXT)\s+)?INDEX\b|CALL\s+db\.idx\.fulltext\.createNodeIndex", text, re.I):
        return [("ddl", None, None, None, None, [], {}, False, text)]
    w = WriteParser(text).statement()
    if w is None:
        raise DumpProblem(f"a dump can't hold {text[:60]!r}")
    encode = lambda v: json.dumps(v, ensure_ascii=False)

    def identity(p: A.NodePat) -> tuple[str, dict, list[str]]:
        labels, props = _names(p.labels), {k: constant(v) for k, v in p.props}
        if pk is not None:
            if pk not in props:
                raise DumpProblem(f"a node without {pk}")
            return encode([pk, props.pop(pk)]), props, labels
        if not labels or not props:
            raise DumpProblem("a node is named by a label and a property")
        key = next(iter(props))
        return encode([labels[0], key, props[key]]), props, labels

    def patches(var: str | None, known: dict) -> tuple[dict, list[str]]:
        props, labels = {}, []
        for s in [*w.on_create, *w.on_match, *w.sets]:
            if s.var != var:
                continue
            if s.kind == "prop":
                props[s.key] = constant(s.value, known | props)
            elif s.kind in ("merge", "replace") and isinstance(s.value, A.MapLit):
                props |= {k: constant(v, known | props) for k, v in s.value.items}
            elif s.kind == "label":
                labels.append(s.key)
            elif s.kind == "unset":
                props[s.key] = None
        return props, labels

    out = []
    whole = w.mode in ("merge", "create")
    if w.rel is None:
        ident, props, labels = identity(w.nodes[0])
        more, added = patches(w.nodes[0].var, props)
        out.append(("node", ident, None, None, None, labels + added, {k: encode(v) for k, v in (props | more).items()}, not whole, None))
        return out
    a, b = w.nodes if w.rel.direction == "out" else w.nodes[::-1]
    ends = []
    for p in (a, b):
        ident, props, labels = identity(p)
        ends.append(ident)
        if whole and pk is None:
            out.append(("node", ident, None, None, None, labels, {k: encode(v) for k, v in props.items()}, False, None))
    inline = {k: constant(v) for k, v in w.rel.props}
    more, _ = patches(w.rel.var, inline)
    ident = encode(sorted(inline.items())) if inline and w.merges else None if pk is not None and not w.merges else ""
    out.append(("edge", *ends, _names(w.rel.types)[0], ident, [], {k: encode(v) for k, v in (inline | more).items()}, w.mode == "match", None))
    return out


def _index(ddl: str) -> Index | None:
    if m := _RANGE.match(ddl):
        g = m.groups()
        if g[4]:
            return Index("range", "relationship", g[4], (g[5],))
        return Index("range", "node", g[0] or g[2], (g[1] or g[3],))
    if m := _VECTOR.match(ddl):
        options = m[3] or ""
        dim = re.search(r"dimensions?`?['\"]?\s*:\s*(\d+)", options, re.I)
        metric = re.search(r"(?:similarity_function|similarityFunction|metric)`?['\"]?\s*:\s*['\"](\w+)", options, re.I)
        return Index("vector", "node", m[1], (m[2],), metric[1].lower() if metric else "cosine", int(dim[1]) if dim else None)
    if m := _TEXT.match(ddl):
        return Index("fulltext", "node", m[1], tuple(re.findall(r"\w+\.(\w+)", m[2])))
    if m := re.match(r"CALL\s+db\.idx\.fulltext\.createNodeIndex\(\s*(.*)\)\s*$", ddl, re.I | re.S):
        args = Parser(f"[{m[1]}]").list_lit().items
        first = args[0]
        label = constant(first) if isinstance(first, A.Lit) else constant(dict(first.items)["label"])
        stop = tuple(constant(dict(first.items).get("stopwords", A.ListLit([])))) if isinstance(first, A.MapLit) else ()
        return Index("fulltext", "node", label, tuple(constant(a) for a in args[1:]), stopwords=stop)
    raise DumpProblem(f"unknown index statement {ddl[:60]!r}")


def _kind(sample: str):
    v = json.loads(sample)
    if v is None:
        return T.NULL
    if isinstance(v, bool):
        return T.BOOL
    if isinstance(v, int):
        return T.INT
    if isinstance(v, float):
        return T.FLOAT
    if isinstance(v, str):
        return T.STR
    if isinstance(v, dict):
        return T.VEC
    kind = T.NULL
    for x in v:
        kind = T.unify(kind, _kind(json.dumps(x)))
    return T.lst(kind if kind != T.NULL else T.STR)


def _typed(c: Column, kind) -> Column:
    if kind == T.STR:
        return F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]
    if kind == T.VEC:
        return F.from_json(c, "vec array<float>")["vec"]
    return F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), f"v {T.ddl(kind)}")["v"]


def _kinds(df: DataFrame, by: str) -> dict[str, dict[str, object]]:
    """Types of the properties in each group: one of each group, key and kind
    of text reaches the driver."""
    each = df.select(by, F.explode("props").alias("k", "v")).where("v <> 'null'")
    shape = F.when(F.col("v").rlike(r'^"'), "s").when(F.col("v").rlike(r"^(true|false)$"), "b").when(F.col("v").rlike(r"^-?\d+$"), "i").when(F.col("v").startswith("{"), "v").when(F.col("v").startswith("["), F.concat(F.lit("l"), F.when(F.col("v").contains('"'), "s").when(F.col("v").rlike(r"[.eE]"), "f").when(F.col("v") == "[]", "e").otherwise("i"))).otherwise("f")
    rows = each.groupBy(by, "k", shape.alias("shape")).agg(F.min("v").alias("v")).collect()
    out: dict[str, dict[str, object]] = {}
    for r in rows:
        kinds = out.setdefault(r[by], {})
        kinds[r["k"]] = T.unify(kinds.get(r["k"], T.NULL), _kind(r["v"]))
    return out


def read_dump(spark: SparkSession, path: str, pk: str | None = None) -> PropertyGraph:
    """A graph from the statements in the text files at ``path``."""
    lines = spark.read.option("lineSep", ";\n").text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("name", pa.string()), ("ident", pa.string()), ("labels", pa.list_(pa.string())), ("props", pa.map_(pa.string(), pa.string())), ("strict", pa.bool_()), ("ddl", pa.string()), ("at", pa.struct([("f", pa.string()), ("b", pa.int64()), ("i", pa.int64())])), ("n", pa.int32())])
        names = kinds.names
        for batch in batches:
            rows = []
            for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = text.rstrip().rstrip(";")
                for n, fact in enumerate(facts(body, pk)):
                    rows.append(dict(zip(names, (*fact[:6], list(fact[6].items()), *fact[7:], at, n))))
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    said = stored(lines.mapInArrow(parse, _FACTS + ", at struct<f:string,b:bigint,i:bigint>, n int"), "facts")
    said = said.withColumn("ordinal", F.struct("at", "n"))
    indexes = tuple(_index(r["ddl"]) for r in said.where("kind = 'ddl'").select("ddl").distinct().collect())  # index definitions alone
    return _assembled(spark, said, indexes, pk)


def _folded(df: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``props``, the last value of each property."""
    each = df.select(*by, "ordinal", F.explode("props").alias("k", "v"))
    last = each.groupBy(*by, "k").agg(F.max_by("v", "ordinal").alias("v"))
    return last.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props"))


def _assembled(spark: SparkSession, said: DataFrame, indexes: tuple[Index, ...], pk: str | None) -> PropertyGraph:
    said_nodes = said.where("kind = 'node'")
    if not said_nodes.groupBy("a").agg(F.bool_and("strict").alias("only")).where("only").isEmpty():
        raise DumpProblem("MATCH … SET of a node that no statement makes")
    labels = said_nodes.select("a", F.explode("labels").alias("l")).distinct().groupBy("a").agg(F.array_sort(F.collect_list("l")).alias("labels"))
    nodes = said_nodes.select("a").distinct().join(labels, "a", "left").join(_folded(said_nodes, ["a"]), "a", "left")
    nodes = nodes.select("a", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))
    nodes = stored(nodes.withColumn("set", F.concat_ws(":", "labels")), "dump-nodes")
    sets = sorted(r["set"] for r in nodes.select("set").distinct().collect())  # label sets
    kinds = _kinds(nodes, "set")
    tables, ids = [], None
    keys = {x.label: x.properties[0] for x in indexes if x.kind == "range" and x.entity == "node"}
    for i, name in enumerate(sets):
        part = stored(nodes.where(F.col("set") == name).repartitionByRange("a").sortWithinPartitions("a"), "dump-table")
        part = numbered(part).withColumn("id", F.lit(i << SHIFT) + F.col("__n"))
        types = kinds.get(name, {})
        cols = [_typed(F.col("props")[k], t).alias(k) for k, t in sorted(types.items()) if t != T.NULL and k != pk]
        if pk is not None:
            cols.append(F.get_json_object("a", "$[1]").alias(pk))
        own = tuple(name.split(":")) if name else ()
        table = stored(part.select("id", *cols), "nodes")
        tables.append(NodeTable(own, table, next((keys[x] for x in own if x in keys), None)))
        some = part.select("a", "id")
        ids = some if ids is None else ids.unionAll(some)
    said_edges = said.where("kind = 'edge'")
    edges = []
    if ids is not None:
        ids = stored(ids, "dump-ids")
        by = ["name", "a", "b", "one"]
        # plain CREATE makes a relationship each time; others fold by their ends and naming property
        single = F.coalesce("ident", F.to_json("ordinal"))
        marked = said_edges.withColumn("one", single)
        bare = marked.groupBy(*by).agg(F.bool_and("strict").alias("only"))
        if not bare.where("only").isEmpty():
            raise DumpProblem("a patch of a relationship that no statement makes")
        full = bare.drop("only").join(_folded(marked, by), by, "left").withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))
        full = full.join(ids.select("a", F.col("id").alias("src")), "a", "left").join(ids.select(F.col("a").alias("b"), F.col("id").alias("dst")), "b", "left")
        full = stored(full, "dump-edges")
        if not full.where("src is null or dst is null").isEmpty():
            raise DumpProblem("a relationship whose end no statement makes")
        kinds = _kinds(full, "name")
        for i, r in enumerate(sorted(r["name"] for r in full.select("name").distinct().collect())):
            part = full.where(F.col("name") == r)
            cols = [_typed(F.col("props")[k], t).alias(k) for k, t in sorted(kinds.get(r, {}).items()) if t != T.NULL]
            table = numbered(stored(part.select("src", "dst", *cols), "edges")).withColumn("id", F.lit(i << SHIFT) + F.col("__n")).drop("__n")
            ends = table.agg(F.collect_set(F.shiftright("src", SHIFT).cast("int")).alias("s"), F.collect_set(F.shiftright("dst", SHIFT).cast("int")).alias("d")).first()
            edges.append(EdgeTable(r, table.select("id", "src", "dst", *[c for c in table.columns if c not in ("id", "src", "dst")]), tuple(sorted(ends["s"])), tuple(sorted(ends["d"]))))
    return PropertyGraph(spark, tuple(tables), tuple(edges), indexes)


# writing
def _literal(c: Column, kind) -> Column:
    quote = lambda s: F.concat(F.lit("'"), F.replace(F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("'"))
    if kind == T.STR:
        return quote(c)
    if T.kind(kind) == "list":
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _literal(x, kind[1])), ", ", "null"), F.lit("]"))
    if kind == T.VEC:
        return F.concat(F.lit("vecf32(["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("])"))
    if kind in T.TEMPORAL:
        return quote(c.cast("string"))
    return c.cast("string")


def _tick(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) else "`" + name.replace("`", "``") + "`"


def _sets(var: str, df: DataFrame, skip: set[str]) -> Column:
    parts = []
    for f in df.schema.fields:
        if f.name not in skip:
            c = F.col(f"`{f.name}`")
            parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"{var}.{_tick(f.name)} = "), _literal(c, T.of_spark(f.dataType)))))
    text = F.concat_ws(", ", *parts) if parts else F.lit("")
    return F.when(text != "", F.concat(F.lit(" SET "), text)).otherwise(F.lit(""))


def write_dump(graph: PropertyGraph, path: str) -> None:
    """The graph as business-key statements: ``path``/0-indexes, 1-nodes and
    2-relationships, text files each. A label without a key is refused."""
    spark = graph.spark
    keyed, out = None, None
    for t in graph.nodes:
        if t.key is None:
            if t.df.isEmpty():
                continue
            raise DumpProblem(f"{':'.join(t.labels)} has no key")
        c, kind = F.col(f"`{t.key}`"), T.of_spark(t.df.schema[t.key].dataType)
        head = F.concat(F.lit(f"(n:{_tick(t.labels[0])} {{{_tick(t.key)}: "), _literal(c, kind), F.lit("})"))
        more = "".join(f" SET n:{_tick(x)}" for x in t.labels[1:])
        lines = t.df.select(F.concat(F.lit("MERGE "), head, _sets("n", t.df, {"id", t.key}), F.lit(more)).alias("value"))
        out = lines if out is None else out.unionAll(lines)
        names = t.df.select("id", F.concat(F.lit(f":{_tick(t.labels[0])} {{{_tick(t.key)}: "), _literal(c, kind), F.lit("}")).alias("k"))
        keyed = names if keyed is None else keyed.unionAll(names)
    ddl = [f"CREATE INDEX FOR (n:{_tick(x.label)}) ON (n.{_tick(x.properties[0])})" for x in graph.indexes if x.kind == "range" and x.entity == "node"]
    ddl += [f"CREATE VECTOR INDEX FOR (n:{_tick(x.label)}) ON (n.{_tick(x.properties[0])}) OPTIONS {{dimension: {x.dimension}, metric: '{x.metric}'}}" for x in graph.indexes if x.kind == "vector"]
    ddl += [f"CREATE FULLTEXT INDEX FOR (n:{_tick(x.label)}) ON EACH [{', '.join(f'n.{_tick(p)}' for p in x.properties)}]" for x in graph.indexes if x.kind == "fulltext" and x.entity == "node"]
    spark.createDataFrame([(x,) for x in ddl], "value string").write.option("lineSep", ";\n").text(f"{path}/0-indexes")
    if out is not None:
        out.write.option("lineSep", ";\n").text(f"{path}/1-nodes")
    links = None
    for t in graph.edges:
        ends = t.df.join(keyed.select(F.col("id").alias("src"), F.col("k").alias("__a")), "src").join(keyed.select(F.col("id").alias("dst"), F.col("k").alias("__b")), "dst")
        lines = ends.select(F.concat(F.lit("MERGE (a"), F.col("__a"), F.lit(f")-[r:{_tick(t.type)}]->(b"), F.col("__b"), F.lit(")"), _sets("r", t.df, {"id", "src", "dst"})).alias("value"))
        links = lines if links is None else links.unionAll(lines)
    if links is not None:
        links.write.option("lineSep", ";\n").text(f"{path}/2-relationships")
