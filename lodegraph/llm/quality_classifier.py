"""Quality by compression (operator 9).

Two zstandard dictionaries are trained, one on good and one on bad labelled
text. A text is compressed under both, in segments that each begin from the
dictionary, so that long texts are measured as short ones; the difference of the
two sizes, normalised by the text's length, is its one feature. A logistic curve
fitted on other labelled texts than the dictionaries, each class weighted by its
share of the labels, turns it into a score.

Fitting reads a bounded sample: of each class the ``SAMPLE`` labelled documents
whose ids hash lowest, whole; by their ids in turn they go to the dictionary,
trained in one task a class, and to the curve. Ids whose crc32 modulo 3 is 1 are
held out and never fitted on.

Defined results: null text counts as empty; an empty text has feature zero; a
document labelled twice counts by its lowest label; null labels don't count;
with fewer than ``LEAST`` texts of a class, or too little text to train on, whole
texts themselves are the dictionaries (of the other class ``RAW`` at most, at a
level that searches them well) and the curve is cross-fitted on the same texts;
with fewer than two of a class every text scores the share of label 1 (0.5 without labels),
and ``keep_good`` keeps every row; repeated rows score alike; an empty table
gives no rows; a null doc_id is held in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, stored

SAMPLE, DICTIONARY_BYTES, SEGMENT_BYTES, LEVEL, LEAST = 3000, 110 << 10, 1024, 3, 16
RAW, RAW_LEVEL, FOLDS = 256, 19, 5


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Constant and slope by Newton's method; ``counts`` weights the rows."""
    x, w = np.c_[np.ones(len(x)), x], np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (counts * (y - p)) - ridge * w)
        w = w + np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    """What tasks need: two dictionaries and the curve, or a constant."""

    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = ()
    constant: float = 0.5
    level: int = LEVEL

    def compressors(self) -> tuple:
        import zstandard

        out = []
        for raw in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_dict_id=False))
        return tuple(out)

    @staticmethod
    def gaps(pair: tuple, texts: list[bytes]) -> np.ndarray:
        """By how many bytes a byte the good dictionary makes each text smaller."""
        good, bad = (c.compress for c in pair)
        empty = len(bad(b"")) - len(good(b""))
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t:
                parts = range(0, len(t), SEGMENT_BYTES)
                less = sum(len(bad(part)) - len(good(part)) for part in (t[a : a + SEGMENT_BYTES] for a in parts))
                out[i] = (less - empty * len(parts)) / len(t)
        return out

    def scores(self, pair: tuple, texts: list[bytes]) -> np.ndarray:
        constant, slope = self.weights
        return 1 / (1 + np.exp(-np.clip(constant + slope * self.gaps(pair, texts), -30, 30)))


def _trained(chosen: DataFrame) -> list[bytes | None]:
    """Dictionaries of label 1 and of label 0, None where one can't be trained."""

    def train(group):
        import pyarrow as pa
        import zstandard

        texts = [t for _, t in sorted(zip(group.column("doc_id").to_pylist(), group.column("t").to_pylist()))]
        try:
            made = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, texts)) // 4)), texts).as_bytes()
        except zstandard.ZstdError:
            made = None
        return pa.table({"quality": pa.array([group.column("quality")[0].as_py()], pa.int32()), "made": pa.array([made], pa.binary())})

    got = {r["quality"]: r["made"] for r in chosen.where("part = 0").groupBy("quality").applyInArrow(train, "quality int, made binary").collect()}
    return [got.get(1), got.get(0)]


def _cross_fitted(some: DataFrame) -> tuple[Model, list[tuple[int, float]]]:
    """Dictionaries of whole texts, and each text's gap under those of the other folds'."""

    def run(group):
        import pyarrow as pa

        rows = sorted(zip(group.column("doc_id").to_pylist(), group.column("quality").to_pylist(), group.column("t").to_pylist()))
        by = {q: [t for _, k, t in rows if k == q] for q in (1, 0)}
        joined = lambda fold: (b"\n".join(t for i, t in enumerate(by[q]) if i % FOLDS != fold) for q in (1, 0))
        out: list[tuple] = [(None, None, *joined(-1))]
        for fold in range(FOLDS):
            pair = Model(*joined(fold), level=RAW_LEVEL).compressors()
            for q in (1, 0):
                out += [(q, gap, None, None) for gap in Model.gaps(pair, by[q][fold::FOLDS]).tolist()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.float64(), pa.binary(), pa.binary()))], names=["quality", "gap", "good", "bad"])

    rows = some.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "quality int, gap double, good binary, bad binary").collect()
    made = next(r for r in rows if r["quality"] is None)
    return Model(bytes(made["good"]), bytes(made["bad"]), level=RAW_LEVEL), [(r["quality"], r["gap"]) for r in rows if r["quality"] is not None]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    known = columns(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    listed = []
    for label in (0, 1):  # at most ``sample`` ids of each class
        ids = sorted(r["doc_id"] for r in known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect())
        listed += [(d, label, i % 2) for i, d in enumerate(ids)]
    ids = spark.createDataFrame(listed, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, quality int, part int")
    texts = columns(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").cast("binary").alias("t")).where("length(t) > 0")
    chosen = stored(spark, texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("part").alias("part"), F.min("t").alias("t")), "labelled")
    sizes = {r["quality"]: r["count"] for r in chosen.groupBy("quality").count().collect()}
    found: list[tuple[int, float]] = []
    model = Model()
    if min(sizes.get(0, 0), sizes.get(1, 0)) >= 2:
        good, bad = _trained(chosen) if min(sizes.values()) >= LEAST else (None, None)
        if good is not None and bad is not None:
            model = Model(bytes(good), bytes(bad))
            found = _measured(chosen.where("part = 1"), model)
        else:
            place = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))
            model, found = _cross_fitted(chosen.withColumn("place", place).where(F.col("place") <= RAW))
    y = np.array([float(q) for q, _ in sorted(found)])
    if len(set(y)) < 2:
        n1, n0 = totals.get(1, 0), totals.get(0, 0)
        return Model(constant=(n1 + 1) / (n0 + n1 + 2))
    counts = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    return replace(model, weights=tuple(logistic(np.array([gap for _, gap in sorted(found)]), y, counts / counts.mean())))


def _measured(rows: DataFrame, model: Model) -> list[tuple[int, float]]:
    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pair = model.compressors()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(Model.gaps(pair, batch.column(1).to_pylist()))], names=["quality", "gap"])

    return [tuple(r) for r in rows.select("quality", "t").mapInArrow(measure, "quality int, gap double").collect()]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pair = model.compressors() if model.weights else None
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            s = model.scores(pair, texts) if pair else np.full(len(texts), model.constant)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    k = F.col(f"`{key}`")
    rows = columns(docs, key, text).select(k.cast("long").alias("doc_id"), held_out(k).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model calls good, with all columns; all
    rows where no model could be fitted."""
    if not model.weights:
        return docs
    at = docs.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pair = model.compressors()
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(model.scores(pair, texts) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
