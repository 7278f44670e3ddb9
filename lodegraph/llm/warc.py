"""WARC archives with boundary-chain verification (operator 4).

Writing: a task writes a file of uncompressed WARC/1.1 records; a page whose
payload an earlier-chosen page (the one with the largest page_id) carries too
becomes a revisit record without the payload.

Reading needs no index and splits files into ranges. A task looks for every
place in its range where a record could begin, and emits from each the offset
at which the chain of records from there leaves the range. Pointer jumping over
these offsets, from offset 0 of each file, marks the true entry into each
range; a second pass parses from there. Record starts inside payloads are never
reached. Only offsets that some chain leads to are jumped over, about one a
range, so the tables stay small.

Defined results: null html counts as empty; null urls are written as an empty
target; a null page_id is smaller than any other; rows that repeat the largest
page_id of a payload are all responses; an empty table gives no files and no
rows. A chain that breaks (truncated or damaged file) raises. Of other writers'
records, responses and revisits have a null page_id and refers_to, the digest
and length that their header or payload gives, else null; other types are left
out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, file_system, heavy_keys, join_salted, publish, stored, work_folder

RANGE_BYTES = 8 << 20
_LEAD = b"\r\n\r\n"
_START = re.compile(rb"(?:(?<=\r\n\r\n)|\A)WARC/1\.[01]\r\n")
_URN = "urn:lodegraph:page:"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record; ``payload``, of ``size`` bytes, isn't read for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda x: f"<{_URN}{'null' if x is None else x}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe='%:/?#[]@!$&()*+,;=~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _LEAD + block + _LEAD


def write_archives(pages: DataFrame, folder: str) -> list[dict]:
    """Write every row; returns ``{"file", "bytes"}`` a file."""
    spark = pages.sparkSession
    rows = columns(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )

    sha1 = F.sha1(F.col("html").cast("binary"))
    first = stored(spark, rows.select("page_id", sha1.alias("sha1")).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")), "warc-first")
    heavy = heavy_keys(first, "sha1")
    responses = {r["sha1"]: r["response"] for r in first.where(F.col("sha1").isin(heavy)).collect()} if heavy else {}

    def squeeze(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        small = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            sha1 = [hashlib.sha1(x).hexdigest() for x in raw]
            data = [None if x in responses and responses[x] != page else small.compress(h) for h, x, page in zip(raw, sha1, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sha1, pa.string()), pa.array(map(len, raw), pa.int64()), pa.array(data, pa.binary())], names=["page_id", "url", "sha1", "size", "data"])

    # payloads are dealt compressed, those of copies of heavy ones not at all
    squeezed = rows.mapInArrow(squeeze, "page_id long, url string, sha1 string, size long, data binary")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        whole = zstandard.ZstdDecompressor().decompress
        file = f"part-{TaskContext.get().partitionId():05d}.warc"
        size = 0

        def fill(out) -> None:
            nonlocal size
            for batch in batches:
                for page, url, sha1, length, data, response in zip(*(c.to_pylist() for c in batch.columns)):
                    digest, revisit = base64.b32encode(bytes.fromhex(sha1)).decode(), page != response
                    size += out.write(record(page, url, b"" if revisit else whole(data), length, digest, response, revisit))

        publish(f"{folder}/{file}", fill)
        yield pa.RecordBatch.from_pydict({"file": [file], "bytes": [size]})

    joined = join_salted(squeezed, first.select("sha1", "response"), "sha1", heavy)
    made = joined.select("page_id", "url", "sha1", "size", "data", "response").mapInArrow(write, "file string, bytes long").collect()
    return [r.asDict() for r in made if r["bytes"]]


class _Range:
    """The bytes of a file that records beginning in [lo, hi) can need."""

    def __init__(self, store, path: str, size: int):
        self._file, self.size = store.open_input_file(path), size

    def read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        return self._file.read(max(0, min(n, self.size - at)))

    def header(self, at: int) -> tuple[dict[str, str], int] | None:
        """Fields of the record header at an offset, and where its block begins.
        Of two places where records could begin, the header of the first ends
        before the second, so long ones are read on without a bound."""
        data, n = b"", 1 << 10
        while b"\r\n\r\n" not in data:
            if len(data) == self.size - at:
                return None
            n *= 4
            data = self.read(at, n)
        end = data.index(b"\r\n\r\n")
        return self.parse(data[:end]), at + end + 4

    @staticmethod
    def parse(head: bytes) -> dict[str, str]:
        out = {}
        for line in head.split(b"\r\n")[1:]:
            k, colon, v = line.partition(b":")
            if colon:
                out[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        return out

    def successor(self, at: int) -> int:
        """Where the record after the one at ``at`` begins; -1 if none can."""
        got = self.header(at)
        if got is None or not (n := got[0].get("content-length", "")).isascii() or not n.isdigit():
            return -1
        end = got[1] + int(n)
        return end + 4 if end + 4 <= self.size and self.read(end, 4) == _LEAD else -1

    def close(self) -> None:
        self._file.close()


def _ranges(spark: SparkSession, files: list[dict], step: int) -> DataFrame:
    listed = spark.createDataFrame([(f["file"], f["bytes"]) for f in files], "file string, bytes long")
    parts = listed.select("file", "bytes", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {step})")).alias("part"))
    count = sum((f["bytes"] - 1) // step + 1 for f in files)
    return parts.repartition(max(1, min(count, 4 * spark.sparkContext.defaultParallelism + count // 16)), "file", "part")


def candidates(spark: SparkSession, folder: str, files: list[dict], step: int = RANGE_BYTES) -> DataFrame:
    """``file, at, leaves``: each possible record start, and where the chain
    from there first leaves its range (-1: it breaks)."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, root = file_system(folder)
        for batch in batches:
            for file, size, part in zip(*(c.to_pylist() for c in batch.columns)):
                lo, hi = part * step, min(size, (part + 1) * step)
                source = _Range(store, f"{root}/{file}", size)
                ahead = min(lo, 4)
                data = source.read(lo - ahead, hi - lo + ahead + 16)
                starts = [m.start() + lo - ahead for m in _START.finditer(data) if m.start() >= ahead and m.start() - ahead + lo < hi]
                leaves: dict[int, int] = {}
                for at in reversed(starts):
                    to = source.successor(at)
                    leaves[at] = leaves.get(to, -1) if 0 <= to < hi else to
                source.close()
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array([leaves[a] for a in starts], pa.int64())], names=["file", "at", "leaves"])

    return _ranges(spark, files, step).mapInArrow(scan, "file string, at long, leaves long")


def entries(spark: SparkSession, found: DataFrame, files: list[dict], step: int = RANGE_BYTES) -> DataFrame:
    """``file, at``: the first true record start in each range that has one."""
    starts = spark.createDataFrame([(f["file"], 0) for f in files], "file string, at long")
    led = found.select("file", F.col("leaves").alias("at")).where("at >= 0").distinct().union(starts)
    jump = found.join(led.distinct(), ["file", "at"], "left_semi").checkpoint()
    ends = {f["file"]: f["bytes"] for f in files}
    reached = starts
    rounds = max((b - 1) // step + 1 for b in ends.values()).bit_length()
    for _ in range(rounds):
        onward = reached.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reached = reached.union(onward).distinct().checkpoint()
        after = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("further"))
        jump = jump.join(after, ["file", "leaves"], "left").select("file", "at", F.coalesce("further", "leaves").alias("leaves")).checkpoint()
    return reached


def read_archives(spark: SparkSession, folder: str, files: list[dict], step: int = RANGE_BYTES) -> DataFrame:
    """A row a reachable record (see ``ROWS``)."""
    if not files:
        return spark.createDataFrame([], ROWS)
    found = candidates(spark, folder, files, step).checkpoint()
    sizes = spark.createDataFrame([(f["file"], f["bytes"]) for f in files], "file string, bytes long")
    true = entries(spark, found, files, step).join(sizes, "file").select("file", "bytes", "at")

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, root = file_system(folder)
        for batch in batches:
            for file, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                if at < 0:
                    raise ValueError(f"{file}: the chain of records breaks")
                if at == size:
                    continue
                source, hi, rows = _Range(store, f"{root}/{file}", size), (at // step + 1) * step, []
                while at < min(hi, size):
                    got = source.header(at)
                    if got is None:
                        raise ValueError(f"{file}: no record at {at}")
                    head, begin = got
                    n = int(head["content-length"])
                    row = _row(head, source.read(begin, n))
                    rows += [row] if row else []
                    at = begin + n + 4
                source.close()
                yield pa.RecordBatch.from_pylist(rows, schema=_schema())

    return true.repartition(max(1, 4 * spark.sparkContext.defaultParallelism), "file", "at").mapInArrow(parse, ROWS)


def _schema():
    import pyarrow as pa

    return pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def _row(head: dict[str, str], block: bytes) -> dict | None:
    kind, own = head.get("warc-type", "").lower(), head.get("warc-record-id", "").startswith(f"<{_URN}")
    if kind not in ("response", "revisit"):
        return None
    page = lambda x: None if x is None or not own or x.endswith(":null>") else int(x.rpartition(":")[2].rstrip(">"))
    http, _, payload = block.partition(_LEAD) if head.get("content-type", "").startswith("application/http") or own else (b"", b"", block)
    length, digest = _Range.parse(http).get("content-length"), head.get("warc-payload-digest")
    size = int(length) if length and length.isascii() and length.isdigit() else None
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own and (size != len(payload) or digest != f"sha1:{found}"):
            raise ValueError(f"{head['warc-record-id']}: payload and digest differ")
        size, digest = len(payload), digest or found
    return {"page_id": page(head.get("warc-record-id")), "payload_bytes": size, "payload_digest": digest and digest.removeprefix("sha1:"), "record_type": kind, "refers_to": page(head.get("warc-refers-to")), "url": head.get("warc-target-uri")}


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    folder = work_folder(spark, "warc")
    return read_archives(spark, folder, write_archives(pages, folder))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT x, max(page_id) AS top FROM p GROUP BY x),
b AS (SELECT p.*, g.top, array_to_string(list_transform(string_split(x, ''), lambda c: right('000' || bin(strpos('0123456789abcdef', c) - 1), 4)), '') AS bits FROM p JOIN g USING (x))
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k: substr(bits, 5 * i + k + 1, 1)::INT * (16 >> k)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""
