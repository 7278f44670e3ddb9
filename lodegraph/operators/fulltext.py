"""Full-text search by BM25 over an index's properties."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Index, PropertyGraph
from ..plans import types as T
from ..storage import checkpointed, spread

K1, B, MAX_HITS = 1.2, 0.75, 10_000
#: The ASCII separators of the analyzer (white space apart).
SEPARATORS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
_SPLIT = r"[\s\x85\p{Z}" + re.sub(r"([^\w])", r"\\\1", SEPARATORS) + "]+"


def terms(text: Column, stopwords: tuple[str, ...]) -> Column:
    """Lower-case terms of a text, without stop words and empty ones."""
    out = F.split(F.lower(text), _SPLIT)
    for word in ("", *stopwords):  # in generated code, unlike filters by lambda
        out = F.array_remove(out, word)
    return out


def analysed(text: str, stopwords: tuple[str, ...] = ()) -> list[str]:
    import regex

    return [t for t in regex.split(_SPLIT, text.lower()) if t and t not in stopwords]


def parse(query: str) -> tuple[list[tuple[str, list[str]]], list[str]]:
    """``(@field:"v"|"v") (t | t)``: filters (field, values) and scored words."""
    filters, words, seen = [], [], False
    at = 0
    text = query.strip()
    if text and not text.startswith("("):
        text = f"({text})" if "(" not in text and ")" not in text else text
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if text[at] != "(":
            raise ValueError(f"full-text query: unexpected {text[at]!r}")
        end, quoted = at + 1, False
        while end < len(text) and (quoted or text[end] != ")"):
            quoted ^= text[end] == '"'
            end += 1
        if end == len(text):
            raise ValueError("full-text query: a group does not end")
        body = text[at + 1 : end].strip()
        at = end + 1
        if body.startswith("@"):
            m = re.fullmatch(r'@(\w+):\s*("[^"]*"(?:\s*\|\s*"[^"]*")*)', body)
            if not m:
                raise ValueError(f"full-text query: a filter is @field:\"value\", not {body!r}")
            filters.append((m[1], re.findall(r'"([^"]*)"', m[2])))
        else:
            if seen:
                raise ValueError("full-text query: one group of terms at most")
            seen = True
            words += [w.strip() for w in body.split("|") if w.strip()]
    return filters, words


def postings(graph: PropertyGraph, index: Index) -> tuple[DataFrame, list[str]]:
    """``id`` and the indexed texts of an index's entities."""
    if index.entity == "node":
        tables = graph.node_tables(lambda labels: index.label in labels)
        return graph.node_frame(tables, list(index.properties)), list(index.properties)
    tables = graph.edge_tables(lambda types: index.label in types)
    return graph.edge_frame(tables, list(index.properties)), list(index.properties)


def search(graph: PropertyGraph, index: Index, query: str, max_hits: int = MAX_HITS) -> DataFrame:
    """``id, score`` of at most ``max_hits`` documents, best first.

    Texts are analysed once: each document's length and the frequencies of the
    few query terms come out of one projection, so nothing but these is
    aggregated; the statistics are one row.
    """
    filters, words = parse(query)
    wanted = list(dict.fromkeys(t for w in words for t in analysed(w, index.stopwords)))
    schema = "id bigint, score double"
    for field, _ in filters:
        if field not in index.properties:
            raise T.TypeProblem(f"the index has no field {field}")
    if not wanted:
        return graph.spark.createDataFrame([], schema)
    frame, fields = postings(graph, index)
    text = [terms(F.col(f"`{f}`").cast("string"), index.stopwords) for f in fields]
    every = F.concat(*(F.coalesce(t, F.array().cast("array<string>")) for t in text))
    keep = F.lit(True)
    for field, values in filters:
        any_value = F.lit(False)
        for v in values:
            parts = analysed(v, index.stopwords)
            has = F.lit(bool(parts))
            for t in parts:
                has = has & F.coalesce(F.array_contains(terms(F.col(f"`{field}`").cast("string"), index.stopwords), t), F.lit(False))
            any_value = any_value | has
        keep = keep & any_value
    docs = spread(frame).select("id", every.alias("t"), keep.alias("keep")).where(F.size("t") > 0)
    tf = [F.size("t") - F.size(F.array_remove("t", t)) for t in wanted]
    docs = docs.select("id", "keep", F.size("t").alias("n"), *(c.alias(f"tf{i}") for i, c in enumerate(tf)))
    docs = checkpointed(docs)  # a few numbers a document; texts are analysed once
    stats = docs.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    hit = F.lit(False)
    for i in range(len(wanted)):
        hit = hit | (F.col(f"tf{i}") > 0)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        f = F.col(f"tf{i}")
        idf = F.log1p((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    found = docs.where(F.col("keep") & hit).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # stats is one row
    return found.orderBy(F.desc("score"), "id").limit(max_hits)
