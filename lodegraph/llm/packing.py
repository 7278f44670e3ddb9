"""Packing documents into sequences by non-negative least squares (operator 6).

A document of n ids first fills whole windows; what is left of it, r ids, is
placed by a plan made from the histogram of all r (at most ``window`` numbers,
whatever the corpus). The plan: shallow combinations of lengths that fill a
window exactly are enumerated, their repeat counts solved as a non-negative
least squares problem against the histogram, and rounded down; remaining
lengths are packed greedily, longest first with the longest that fits, and kept
where at most ``slack`` ids are missing; the rest is laid end to end and cut at
the window, its last piece at powers of two. So sequences are full, or up to
``slack`` short, or a power of two long.

Which document takes which place: its rank among those of its length, counted
within its input partition and then over the partitions. The plan, not the
documents, is what every task holds.

Defined results: null text counts as empty and has the end id alone; repeated
rows are documents of their own; an empty table gives no pieces; a null key is
carried along.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(lengths: np.ndarray, window: int) -> list[dict[int, int]]:
    """Shallow combinations ``{length: times}`` of the given lengths that sum to
    ``window``: up to eight of one length and one other, and threes whose parts
    of the remainder are 4, 5, 6 or 7 eighths."""
    there, out = set(lengths.tolist()), {}
    for a in lengths.tolist():
        for times in range(1, 9):
            rest = window - a * times
            if rest < 0:
                break
            if rest == 0 or rest in there:
                made = {a: times}
                if rest:
                    made[rest] = made.get(rest, 0) + 1
                out[tuple(sorted(made.items()))] = made
        for eighths in (4, 5, 6, 7):
            b = (window - a) * eighths // 8
            c = window - a - b
            if b in there and c in there:
                made = {a: 1}
                for x in (b, c):
                    made[x] = made.get(x, 0) + 1
                out[tuple(sorted(made.items()))] = made
    return [out[k] for k in sorted(out)]


def solve(parts: list[dict[int, int]], histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|^2, by projected gradient with
    Barzilai-Borwein steps; A has a column a combination."""
    n = len(parts)
    row = np.array([k for p in parts for k in p], np.int64)
    col = np.repeat(np.arange(n), [len(p) for p in parts])
    val = np.array([v for p in parts for v in p.values()], float)
    down = lambda x: np.bincount(row, val * x[col], len(histogram))
    up = lambda y: np.bincount(col, val * y[row], n)
    used = np.bincount(row, minlength=len(histogram))
    x = np.full(n, np.inf)
    np.minimum.at(x, col, histogram[row] / val / np.maximum(used[row], 1))
    gradient = up(down(x) - histogram)
    step = 1e-3
    best, least = x, np.inf
    for _ in range(rounds):
        new = np.maximum(0, x - step * gradient)
        residual = down(new) - histogram
        g, size = up(residual), float(residual @ residual)
        if size < least:
            best, least = new, size
        d, h = new - x, g - gradient
        if not d.any():
            break
        step = float(np.clip((d @ d) / max(d @ h, 1e-12), 1e-6, 10))
        x, gradient = new, g
    return best


class Plan:
    """Where the document of each (length, rank) goes."""

    def __init__(self, histogram: np.ndarray, window: int, slack: int = 8):
        self.window = window
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        used: list[tuple[dict[int, int], int]] = []

        def take(made: dict[int, int], most: int) -> None:
            times = min([most, *(int(left[k]) // v for k, v in made.items())])
            if times > 0:
                used.append((made, times))
                for k, v in made.items():
                    left[k] -= times * v

        parts = combinations(np.flatnonzero(left), window)
        if parts:
            repeats = solve(parts, left.astype(float))
            order = np.argsort(-repeats, kind="stable").tolist()
            for i in order:
                take(parts[i], int(repeats[i] + 1e-9))
            for i in order:
                take(parts[i], int(left.sum()))
        lengths = np.flatnonzero(left).tolist()
        apart: dict[int, int] = {}
        while lengths:
            a, made, rest = lengths[-1], {lengths[-1]: 1}, window - lengths[-1]
            while rest:
                i = bisect_right(lengths, rest) - 1
                while i >= 0 and left[lengths[i]] <= made.get(lengths[i], 0):
                    i -= 1
                if i < 0:
                    break
                made[lengths[i]] = made.get(lengths[i], 0) + 1
                rest -= lengths[i]
            if rest <= slack:
                take(made, int(left.sum()))
            else:  # lengths below can't fill it: its longest is cut instead
                apart[a] = int(left[a])
                left[a] = 0
            lengths = [k for k in lengths if left[k] > 0]
        keys, sequence, offset, rank = [], [], [], np.zeros(window + 1, np.int64)
        at = 0
        for made, times in used:
            inside = 0
            for k in sorted(made, reverse=True):
                for _ in range(made[k]):
                    keys.append((k << 44) + rank[k])
                    sequence.append(at)
                    offset.append(inside)
                    rank[k] += times
                    inside += k
            at += times
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.sequence = np.array(sequence, np.int64)[order]
        self.offset = np.array(offset, np.int64)[order]
        self.placed = rank
        self.stream_first = at
        self.stream_base = np.zeros(window + 1, np.int64)
        total = 0
        for k in sorted(apart, reverse=True):
            self.stream_base[k] = total
            total += k * apart[k]
        whole, tail = divmod(total, window)
        cuts = [whole * window]
        for bit in range(tail.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                cuts.append(cuts[-1] + (1 << bit))
        self.tail = np.array(cuts, np.int64)
        self.stream_length = total

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(document, start, length, sequence, offset)`` of every piece, start
        counted within the given lengths."""
        doc = np.arange(len(lengths))
        planned = ranks < self.placed[lengths]
        d = doc[planned]
        i = np.searchsorted(self.keys, (lengths[d] << 44) + ranks[d], "right") - 1
        parts = [(d, np.zeros(len(d), np.int64), lengths[d], self.sequence[i] + ranks[d] - (self.keys[i] & (1 << 44) - 1), self.offset[i])] if len(d) else []
        d = doc[~planned]
        begin = self.stream_base[lengths[d]] + (ranks[d] - self.placed[lengths[d]]) * lengths[d]
        end, at = begin + lengths[d], begin.copy()
        while len(d):
            last = self.tail[0]
            t = np.searchsorted(self.tail, at, "right") - 1
            start = np.where(at < last, at // self.window * self.window, self.tail[np.maximum(t, 0)])
            stop = np.where(at < last, start + self.window, self.tail[np.minimum(t + 1, len(self.tail) - 1)])
            to = np.minimum(end, stop)
            parts.append((d, at - begin, to - at, self.stream_first + np.where(at < last, at // self.window, last // self.window + t), at - start))
            more = to < end
            d, begin, end, at = d[more], begin[more], end[more], to[more]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, r, part, full, rank, ids``: ids as raw bytes, and each
    document's count of whole windows and rank by r before it in its partition."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .wordtok import WordEncoder

        part = TaskContext.get().partitionId()
        encoder = WordEncoder.of(tokenizer, end_id)
        kind = "<u2" if encoder.vocabulary <= 1 << 16 else "<u4"
        full, ranks = 0, np.zeros(window, np.int64)
        for batch in batches:
            for at, to, ids, offsets in encoder.encode(batch.column(1)):
                n = np.diff(offsets)
                whole, r = n // window, n % window
                before = full + np.cumsum(whole) - whole
                full += int(whole.sum())
                order = np.argsort(r, kind="stable")
                same = np.concatenate([[True], r[order][1:] != r[order][:-1]])
                firsts = np.flatnonzero(same)
                within = np.empty(len(r), np.int64)
                within[order] = np.arange(len(r)) - np.repeat(firsts, np.diff(np.append(firsts, len(r))))
                rank = ranks[r] + within
                ranks += np.bincount(r, minlength=window)
                data = ids.astype(kind)
                raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((offsets * data.itemsize).astype("<i8").tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n), pa.array(r), pa.array(np.full(len(n), part)), pa.array(before), pa.array(rank), raw.cast(pa.binary())], names=["doc_id", "n", "r", "part", "full", "rank", "ids"])

    rows = columns(docs, key, text).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n long, r long, part long, full long, rank long, ids binary")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, slack: int = 8) -> DataFrame:
    """The pieces of all documents (see ``PIECES``). Sequence numbers of whole
    windows of single documents follow ``2 ** 40``; others count from 0."""
    encoded = stored(spark, encode_documents(docs, tokenizer, end_id, window), "packing")
    counts = encoded.groupBy("part", "r").agg(F.count(F.lit(1)).alias("c"))
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("r").agg(F.sum("c").alias("c")).collect():  # a row a length
        histogram[r["r"]] = r["c"]
    plan = Plan(histogram, window, slack)
    before = Window.partitionBy("r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("c").over(before), F.lit(0))).select("part", "r", "ahead")
    width = 2 if _narrow(tokenizer) else 4

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            col = {name: batch.column(name) for name in batch.schema.names}
            n, r, part, full = (col[k].to_numpy() for k in ("n", "r", "part", "full"))
            rank = col["rank"].to_numpy() + col["ahead"].to_numpy()
            whole = n // window
            d0 = np.repeat(np.arange(len(n)), whole)
            i0 = np.arange(len(d0)) - np.repeat(np.cumsum(whole) - whole, whole)
            some = np.flatnonzero(r)
            d1, s1, l1, q1, o1 = plan.place(r[some], rank[some])
            d1 = some[d1]
            doc = np.concatenate([d0, d1])
            start = np.concatenate([i0 * window, whole[d1] * window + s1])
            length = np.concatenate([np.full(len(d0), window), l1])
            sequence = np.concatenate([((part[d0] + 1) << 40) + full[d0] + i0, q1])
            offset = np.concatenate([np.zeros(len(d0), np.int64), o1])
            order = np.lexsort((start, doc))
            doc, start, length, sequence, offset = doc[order], start[order], length[order], sequence[order], offset[order]
            crc, ids, now = np.zeros(len(doc), np.int64), b"", -1
            for i, (d, a, k) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist())):
                if d != now:
                    ids, now = np.frombuffer(col["ids"][d].as_buffer(), f"<u{width}").astype("<u4").tobytes(), d
                crc[i] = zlib.crc32(ids[4 * a : 4 * (a + k)])
            yield pa.RecordBatch.from_arrays([col["doc_id"].take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[doc]), pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return encoded.join(ahead, ["part", "r"]).select("doc_id", "n", "r", "part", "full", "rank", "ahead", "ids").mapInArrow(place, PIECES)


def _narrow(tokenizer: str) -> bool:
    from .wordtok import WordEncoder

    return WordEncoder.of(tokenizer, 1).vocabulary <= 1 << 16
