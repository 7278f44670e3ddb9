"""SimHash near-duplicates by a Gray-order hierarchical index (operator 3).

Fingerprints: words are split at ASCII white space, three-word shingles hashed
by XXH64 (seed 42), and a bit is set where more than half of the hashes set it.

Links (at most two differing bits) between distinct fingerprints: two such
fingerprints agree in at least six of their eight bytes. So the upper nodes of
the index are masked patterns, six bytes each, one mask for every choice of six
bytes: a fingerprint is posted under its 28 patterns, and any linked pair meets
under one. Below a pattern at most 2 ** 16 fingerprints exist, whatever the
corpus, which bounds every group. Inside it members are sorted by the Gray rank
of the free two bytes, so that those sharing their first bits are adjacent: four
levels of lower nodes, four bits each. Pairs of nodes descend level by level
with the differences counted so far, and a pair beyond two goes with all that is
below it, so what is made follows the links that there are. Each group yields a
link to the smallest member of each of its connected parts, not all pairs.

Components of these links are found over the fingerprints, named by their
smallest documents and joined back to the documents by fingerprint; fingerprints
of more than a thousandth of all documents, which are fewer than a thousand, are
salted there.

Defined results: a null or empty text has fingerprint zero, linked like any
other; ties and repeated rows share a fingerprint; a null doc_id is a member,
which others may be linked through, but never names a component, unless all ids
in it are null (then null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, components, heavy_keys, join_salted, stored

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: The pairs of bytes that a mask leaves free.
FREE = tuple(combinations(range(8), 2))
#: Rows whose links are searched at a time; larger groups still come whole.
BLOCK_ROWS = 1 << 18
#: Pairs of nodes that descend together.
BLOCK_PAIRS = 1 << 20
#: Shingles whose bits are summed at a time.
_PART = 1 << 15


def fingerprint(text: bytes | None) -> int:
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    total = len(words) - SHINGLE + 1
    sums = np.zeros(64, np.int64)
    shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    for at in range(0, total, _PART):
        n = min(_PART, total - at)
        h = np.fromiter((xxh64_intdigest(next(shingles), SEED) for _ in range(n)), np.uint64, n)
        sums += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * sums > total).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """``doc_id, f``: fingerprints as signed 64-bit integers; ``h``, a hash of
    the text, as well where it is asked for."""
    more = ["h"] * hashed

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            f = np.array([fingerprint(None if x is None else x) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64)), *batch.columns[2:]], names=["doc_id", "f", *more])

    rows = columns(docs, key, text).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    return rows.select("doc_id", "text", *more).mapInArrow(run, "doc_id long, f long" + ", h long" * hashed)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Rank of 16-bit words in the Gray sequence."""
    for s in (8, 4, 2, 1):
        x = x ^ (x >> s)
    return x


def _pairs(first: np.ndarray, count: np.ndarray, other: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All children pairs of node pairs: (pair, child of one, child of other)."""
    sizes = count * others
    pair = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return pair, first[pair] + within // others[pair], other[pair] + within % others[pair]


def group_links(group: np.ndarray, free: np.ndarray, limit: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows ``(i, j)`` linked inside groups; rows of a group are adjacent, in
    Gray order of their free word, which differs from row to row."""
    n = len(free)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    starts = [np.flatnonzero(new)]  # of nodes by level: groups, then 4, 8, 12 and 16 bits
    for shift in (12, 8, 4, 0):
        bits = free >> shift
        new = new | np.concatenate([[True], bits[1:] != bits[:-1]])
        starts.append(np.flatnonzero(new))
    firsts = [np.searchsorted(below, above) for above, below in zip(starts, starts[1:])]
    counts = [np.diff(np.append(first, len(below))) for first, below in zip(firsts, starts[1:])]
    more = np.flatnonzero(np.diff(np.append(starts[0], n)) > 1)
    open_ = [(0, more, more, np.zeros(len(more), np.uint8))] if len(more) else []
    while open_:
        level, x, y, apart = open_.pop()
        sizes = np.cumsum(counts[level][x] * counts[level][y])
        if sizes[-1] > BLOCK_PAIRS and len(x) > 1:
            cut = min(max(1, int(np.searchsorted(sizes, BLOCK_PAIRS, "right"))), len(x) - 1)
            open_ += [(level, x[cut:], y[cut:], apart[cut:]), (level, x[:cut], y[:cut], apart[:cut])]
            continue
        pair, i, j = _pairs(firsts[level][x], counts[level][x], firsts[level][y], counts[level][y])
        begins = starts[level + 1]
        differ = apart[pair] + np.bitwise_count(((free[begins[i]] ^ free[begins[j]]) >> (12 - 4 * level)) & 15)
        keep = (differ <= limit) & ((i <= j) if level < 3 else (i < j))
        i, j = i[keep], j[keep]
        if level == 3:
            yield begins[i], begins[j]
        elif len(i):
            open_.append((level + 1, i, j, differ[keep]))


def _roots(n: int, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least ``value`` reachable from each row, by pointer jumping."""
    low = value.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            return low
        low = new


def _search(batches: Iterator) -> Iterator:
    """``(mask, pattern, free, rep)`` sorted by the first three, groups whole:
    a link from each member to the least of its connected part."""
    import pyarrow as pa

    def links(part: list[np.ndarray]):
        found = [x for x in group_links((part[0] << 48) | part[1], part[2]) if len(x[0])]
        if not found:
            return None
        i, j = (np.concatenate(x) for x in zip(*found))
        rows = np.unique(np.concatenate([i, j]))
        low = _roots(len(rows), np.searchsorted(rows, i), np.searchsorted(rows, j), part[3][rows])
        apart = low != part[3][rows]
        return pa.RecordBatch.from_arrays([pa.array(part[3][rows][apart]), pa.array(low[apart])], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(k).to_numpy() for k in range(4)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if len(held[0]) < BLOCK_ROWS:
            continue
        key = (held[0] << 48) | held[1]
        cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if cut:
            if (out := links([x[:cut] for x in held])) is not None:
                yield out
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]) and (out := links(held)) is not None:
        yield out


def near_links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the representatives of ``distinct(f, rep)``."""

    def post(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            f, rep = batch.column(0).to_numpy().view(np.uint64), batch.column(1)
            bytes_ = f.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
            for mask, (x, y) in enumerate(FREE):
                pattern = np.zeros(len(f), np.int64)
                for k in range(8):
                    if k not in (x, y):
                        pattern = pattern << 8 | bytes_[:, k]
                word = bytes_[:, x] << 8 | bytes_[:, y]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), mask, np.int64)), pa.array(pattern), pa.array(word), pa.array(gray_rank(word)), rep], names=["mask", "pattern", "free", "gray", "rep"])

    posted = distinct.select("f", "rep").mapInArrow(post, "mask long, pattern long, free long, gray long, rep long")
    alone = posted.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "gray")
    return alone.select("mask", "pattern", "free", "rep").mapInArrow(_search, "a long, b long")


def groups(spark: SparkSession, prints: DataFrame) -> tuple[DataFrame, list]:
    """``f, root, component_id`` of each distinct fingerprint of ``prints(doc_id,
    f)``, root being the smallest fingerprint of its component; and heavy ones."""
    distinct = stored(spark, prints.groupBy("f").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    found = components(spark, near_links(distinct.select("f", F.col("f").alias("rep"))))
    linked = found.select(F.col("node").alias("f"), "root").union(found.select("root", "root").distinct())
    linked = linked.join(distinct.select("f", "rep"), "f").checkpoint()
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    named = distinct.join(linked.join(least, "root").select("f", "root", "least"), "f", "left")
    named = named.select("f", F.coalesce("root", "f").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return named, heavy_keys(distinct, "f")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    prints = stored(spark, fingerprints(docs), "simhash")
    named, heavy = groups(spark, prints)
    joined = join_salted(prints, named, "f", heavy)
    return joined.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, with all columns: of its smallest
    id (none only where no row has one) that with the least hash of its text,
    then the least row. Rows that repeat an id and rows without one are
    documents of their own."""
    k, keys = F.col(f"`{key}`").cast("long"), ["_none", "_id", "_h"]  # a join's keys are the grouping's: texts are dealt once
    prints = stored(spark, fingerprints(docs, key, text, hashed=True), "simhash")
    named, heavy = groups(spark, prints)
    order = F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("h").alias("_h"))
    kept = join_salted(prints, named, "f", heavy).groupBy("root").agg(F.min(order).alias("r")).select("r.*")
    rows = docs.withColumns({"_none": k.isNull(), "_id": F.coalesce(k, F.lit(0)), "_h": F.xxhash64(F.col(f"`{text}`"))}).join(kept, keys, "left_semi")
    return rows.groupBy(*keys).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("r")).select("r.*")
