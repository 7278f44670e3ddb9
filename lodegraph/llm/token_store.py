"""Token-id shards with a minimal perfect hash index (operator 1).

A store is a folder: ``shard-NNNNN.ids`` holds raw little-endian ids (two bytes
each where the vocabulary fits), documents in ascending key order;
``shard-NNNNN.idx`` holds the rows' keys and offsets and a minimal perfect hash
of the distinct keys (levels of collision-free bits, Limasset et al. 2017),
each slot with a 32-bit fingerprint of its key and its first row;
``manifest.json`` has one line a shard: key range, rows, ids before it. A key is
found by its shard's range, one hash probe a level, and one read at an offset.

Defined results: null text counts as empty (its end id alone is stored); a null
key sorts first, is stored, and is not found by key; rows that repeat a key are
stored one after the other, by a hash of their text, over several shards if need
be, and found together; an empty table gives a store without shards. Columns
other than the key and the text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, file_system, publish, shared_root, work_folder
from .ragged import offsets_of

_MAGIC = b"LGTS1\n"
_GAMMA = 1.7


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """SplitMix64 of the keys."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Keys (distinct, 64 bits) to 0 .. n-1 without gaps."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self._ranks, before = [], 0
        for bits in levels:
            self._ranks.append(before + np.cumsum(bits) - bits)
            before += int(bits.sum())
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels, rest = [], keys.astype(np.uint64)
        while len(rest):
            m = max(64, int(_GAMMA * len(rest)) + 1)
            at = (_mix(rest, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that surely aren't in it. Any other
        absent key gets some slot, whose fingerprint tells it apart."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self._ranks)):
            at = (_mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.uint64), 977) >> np.uint64(32)).astype(np.uint32)


class ShardIndex:
    """Rows of a shard: keys (null: absent in ``known``), offsets in ids."""

    def __init__(self, keys: np.ndarray, known: np.ndarray, offsets: np.ndarray, width: int):
        self.keys, self.known, self.offsets, self.width = keys, known, offsets, width
        rows = np.flatnonzero(known)
        first = rows[np.concatenate([[True], keys[rows][1:] != keys[rows][:-1]])] if len(rows) else rows
        self._set(PerfectHash.build(keys[first]), first)

    def _set(self, mph: PerfectHash, first: np.ndarray) -> None:
        self.mph = mph
        self.first = np.zeros(len(first), np.int64)
        self.prints = np.zeros(len(first), np.uint32)
        slots = mph.slots(self.keys[first])
        self.first[slots] = first
        self.prints[slots] = _fingerprints(self.keys[first])

    def write(self, out) -> None:
        arrays = [self.keys.astype("<i8"), self.known.astype(np.uint8), self.offsets.astype("<i8"), self.first.astype("<i8"), self.prints.astype("<u4")]
        head = {"width": self.width, "levels": [len(b) for b in self.mph.levels], "lengths": [len(a) for a in arrays]}
        out.write(_MAGIC + json.dumps(head).encode() + b"\n")
        for a in [*arrays, *(np.packbits(b) for b in self.mph.levels)]:
            out.write(a.tobytes())

    @classmethod
    def read(cls, data: bytes) -> "ShardIndex":
        if not data.startswith(_MAGIC):
            raise ValueError("not a token index")
        end = data.index(b"\n", len(_MAGIC))
        head, at, got = json.loads(data[len(_MAGIC) : end]), end + 1, []
        for n, kind in zip(head["lengths"], ("<i8", "u1", "<i8", "<i8", "<u4")):
            got.append(np.frombuffer(data, kind, n, at))
            at += got[-1].nbytes
        levels = []
        for n in head["levels"]:
            levels.append(np.unpackbits(np.frombuffer(data, "u1", (n + 7) // 8, at), count=n).astype(bool))
            at += (n + 7) // 8
        self = cls.__new__(cls)
        self.keys, self.known, self.offsets, self.first, self.prints = got[0], got[1].astype(bool), *got[2:]
        self.width, self.mph = head["width"], PerfectHash(levels)
        return self

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key, -1 where there is none: the fingerprint settles
        nearly all absent keys, the stored key the rest."""
        out = np.full(len(keys), -1, np.int64)
        if not self.mph.size:
            return out
        slots = self.mph.slots(keys)
        maybe = np.flatnonzero(slots >= 0)
        maybe = maybe[self.prints[slots[maybe]] == _fingerprints(keys[maybe])]
        first = self.first[slots[maybe]]
        same = self.keys[first] == keys[maybe]
        out[maybe[same]] = first[same]
        return out


    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """All rows of each key that is there, key by key."""
        first = self.rows(keys)
        first = first[first >= 0]
        begins = np.flatnonzero(np.concatenate([[True], (self.keys[1:] != self.keys[:-1]) | (self.known[1:] != self.known[:-1])])) if len(self.keys) else first
        end = np.append(begins, len(self.keys))[np.searchsorted(begins, first, "right")]
        return np.repeat(first - offsets_of(end - first)[:-1], end - first) + np.arange((end - first).sum())


def write_store(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", shards: int | None = None) -> list[dict]:
    """Encode ``docs`` into a store of ``shards`` key-range shards (by default
    the session's shuffle partitions); returns the manifest."""
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared_root(spark)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .wordtok import WordEncoder

        shard = TaskContext.get().partitionId()
        encoder = WordEncoder.of(tokenizer, end_id)
        width = 2 if encoder.vocabulary <= 1 << 16 else 4
        keys, known, lengths = [], [], []

        def payload(out) -> None:
            for batch in batches:
                column = batch.column(0)
                known.append(column.is_valid().to_numpy(zero_copy_only=False))
                keys.append(column.fill_null(0).to_numpy())
                for _, _, ids, offsets in encoder.encode(batch.column(1)):
                    out.write(ids.astype(f"<u{width}").tobytes())
                    lengths.append(np.diff(offsets))

        publish(f"{folder}/shard-{shard:05d}.ids", payload)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        k, v, offsets = join(keys, np.int64), join(known, bool), offsets_of(join(lengths, np.int64))
        publish(f"{folder}/shard-{shard:05d}.idx", ShardIndex(k, v, offsets, width).write)
        some = k[v]
        yield pa.RecordBatch.from_pydict({"shard": [shard], "rows": [len(k)], "ids": [int(offsets[-1])], "least": pa.array([int(some[0]) if len(some) else None], pa.int64()), "most": pa.array([int(some[-1]) if len(some) else None], pa.int64())})

    rows = columns(docs, key, text).select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    rows = rows.select("k", "t", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("m"))  # rows that share a key, or a key and a text, are split too
    dealt = rows.repartitionByRange(n, "k", "h", "m").sortWithinPartitions("k", "h", "m").select("k", "t")
    made = dealt.mapInArrow(encode, "shard long, rows long, ids long, least long, most long").collect()  # a row a shard
    manifest, before = [], 0
    for r in sorted(made, key=lambda r: r["shard"]):
        manifest.append(r.asDict() | {"before": before})
        before += r["ids"]
    publish(f"{folder}/manifest.json", lambda out: out.write("".join(json.dumps(m) + "\n" for m in manifest).encode()))
    return manifest


class TokenStore:
    """Keyed access to a store, from the driver or from any task."""

    def __init__(self, folder: str):
        self.folder = folder
        self._store, self._path = file_system(folder)
        with self._store.open_input_stream(f"{self._path}/manifest.json") as f:
            self.manifest = [json.loads(x) for x in f.read().splitlines()]
        self._shards = [m for m in self.manifest if m["least"] is not None]
        self._most = np.array([m["most"] for m in self._shards], np.int64)
        self._open: dict[int, ShardIndex] = {}

    def index(self, shard: int) -> ShardIndex:
        if shard not in self._open:
            with self._store.open_input_stream(f"{self._path}/shard-{shard:05d}.idx") as f:
                self._open[shard] = ShardIndex.read(f.read())
        return self._open[shard]

    def ids(self, shard: int, start: int, end: int) -> np.ndarray:
        width = self.index(shard).width
        with self._store.open_input_file(f"{self._path}/shard-{shard:05d}.ids") as f:
            f.seek(start * width)
            return np.frombuffer(f.read((end - start) * width), f"<u{width}").astype(np.uint32)

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every row with this key."""
        out = []
        for m in self._shards[int(np.searchsorted(self._most, key)) :]:
            if m["least"] > key:
                break
            index = self.index(m["shard"])
            out += [self.ids(m["shard"], int(index.offsets[r]), int(index.offsets[r + 1])) for r in index.rows_of(np.array([key], np.int64)).tolist()]
        return out


def read_store(spark: SparkSession, folder: str, block_ids: int = 4 << 20) -> DataFrame:
    """What the files of a store hold, a row a document: ``doc_id, start,
    n_tokens, ids_crc32, shard, shard_offset``. Every distinct key of a shard is
    looked up in its index, and what is read is at the offsets of the rows found;
    rows without a key are read as they are stored. Payloads pass in blocks."""
    count = len(TokenStore(folder).manifest)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store = None
        for batch in batches:
            store = store or TokenStore(folder)
            before = {m["shard"]: m["before"] for m in store.manifest}
            for shard in batch.column(0).to_pylist():
                index = store.index(shard)
                keyed = index.rows_of(np.unique(index.keys[index.known]))
                if len(keyed) != index.known.sum():
                    raise ValueError(f"shard {shard}: a stored key is not in its index")
                rows = np.concatenate([np.flatnonzero(~index.known), keyed])
                start, end = index.offsets[rows], index.offsets[rows + 1]
                taken = offsets_of(end - start)
                row, n = 0, len(rows)
                while row < n:
                    to = max(row + 1, int(np.searchsorted(taken, taken[row] + block_ids, "right")) - 1)
                    a, b = start[row:to], end[row:to]
                    if (a[1:] != b[:-1]).any():
                        raise ValueError(f"shard {shard}: the index leads to other rows than are stored")
                    data = store.ids(shard, int(a[0]), int(b[-1])).astype("<u4").tobytes()
                    crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip((a - a[0]).tolist(), (b - a[0]).tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(index.keys[rows[row:to]], mask=~index.known[rows[row:to]]), pa.array(a + before[shard]), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(np.full(to - row, shard)), pa.array(a)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_offset"])
                    row = to
                store._open.pop(shard, None)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, shard_offset long"
    return spark.range(0, count, 1, max(1, count)).mapInArrow(read, schema)


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Write a store of ``docs`` in the shared folder and read it back."""
    folder = work_folder(spark, "token-store")
    write_store(spark, docs, folder, tokenizer, end_id, shards=shards)
    return read_store(spark, folder)
