"""Each operator against its plain version, on a small table and at the edges."""

import collections
import hashlib
import zlib

import brute
import numpy as np
import pytest
from edges import ROWS

from lodegraph.llm import ann, bpe, licenses, packing, pii, quality_classifier, quality_rules, simhash, token_store, warc
from lodegraph.llm.common import work_folder
from lodegraph.llm.queries import tokenizer

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
EDGE = [(d, t) for d, t, _ in ROWS]


def bag(rows):
    return collections.Counter(map(tuple, rows))


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["small", "edge", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


# 1
def test_token_store(spark, docs):
    got = token_store.encode_documents(spark, docs, tokenizer(WORD)).collect()
    assert bag(r[:4] for r in got) == bag(brute.store_rows(texts(docs)))


def test_token_store_access(spark, edge):
    folder = work_folder(spark, "test-store")
    token_store.write_store(spark, edge, folder, tokenizer(WORD), shards=4)
    store = token_store.TokenStore(folder)
    for key in (1, 2, 4, 8, 100, -3):
        assert [x.tolist() for x in store.get(key)] == brute.word_ids([t for d, t in EDGE if d == key])
    assert len(store.get(7)) == 2 and store.get(77) == [] and store.get(10**15) == []


def test_token_store_hot_key(spark):
    """A third of the rows under one key, another third without one: split over shards, found together."""
    rows = [(7, f"text {i % 50}") for i in range(900)] + [(None, f"none {i % 40}") for i in range(900)] + [(i, f"other {i}") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = work_folder(spark, "test-store")
    manifest = token_store.write_store(spark, frame, folder, tokenizer(WORD), shards=12)
    assert max(m["rows"] for m in manifest) < 600
    store = token_store.TokenStore(folder)
    assert bag(x.tolist() for x in store.get(7)) == bag(brute.word_ids([t for d, t in rows if d == 7])) and len(store.get(8)) == 1
    got = token_store.read_store(spark, folder).collect()
    assert bag((r.doc_id, r.ids_crc32) for r in got) == bag((d, zlib.crc32(brute.raw(ids))) for (d, _), ids in zip(rows, brute.word_ids([t for _, t in rows])))
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == np.cumsum([0, *(r.n_tokens for r in sorted(got, key=lambda r: r.start))])[:-1].tolist()


def test_token_store_reads_through_index(spark, edge):
    """A wrong row in the index gives an error, not the stored order."""
    folder = work_folder(spark, "test-store")
    token_store.write_store(spark, edge, folder, tokenizer(WORD), shards=1)
    store = token_store.TokenStore(folder)
    index = store.index(0)
    index.first = index.first[::-1].copy()
    path = folder.removeprefix("file://") + "/shard-00000.idx"
    with open(path, "wb") as out:
        index.write(out)
    with pytest.raises(Exception, match="index"):
        token_store.read_store(spark, folder).collect()


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(10**12, 5000, replace=False).astype(np.int64)
    slots = token_store.PerfectHash.build(keys).slots(keys)
    assert sorted(slots) == list(range(5000))


# 2
def test_quality_rules(docs):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs).collect()]
    assert bag(got) == bag((d, *brute.rules_base(t)) for d, t in texts(docs))
    assert all(not (r.base_failed and r.kept) for r in quality_rules.judge(docs).collect())


def test_quality_rules_cases(spark):
    prose = "the house by the river is old and it was built for the men of the town who came to work in the mill"
    cases = [prose, prose.replace("the", "§§") .replace("is", "x"), "# $ % " * 20 + prose, "\n".join(["the same line of the text"] * 9)]
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules.judge(frame).collect()} == {0: True, 1: True, 2: False, 3: False}
    assert [r.doc_id for r in quality_rules.keep(frame, ("doc_id", "text")).collect()] == [r.doc_id for r in quality_rules.judge(frame).where("kept").collect()]


# 3
def test_simhash(spark, docs):
    got = simhash.near_duplicates(spark, docs).collect()
    assert bag((r.doc_id, r.fingerprint, r.component_id) for r in got) == bag(brute.simhash_components(texts(docs)))


def test_gray_index_finds_all_links(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    f = np.unique(np.concatenate([base, near]))
    frame = spark.createDataFrame([(int(x), i) for i, x in enumerate(f.view(np.int64))], "f long, rep long")
    from lodegraph.llm.common import components

    roots = {r["node"]: r["root"] for r in components(spark, simhash.near_links(frame)).collect()}
    low = list(range(len(f)))
    changed = True
    while changed:
        changed = False
        for i in range(len(f)):
            m = min(low[j] for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 2))
            changed |= m < low[i]
            low[i] = m
    assert [roots.get(i, i) for i in range(len(f))] == low


def test_gray_index_full_group():
    """All 2 ** 16 words of one group, then sparse groups: every link, once, in bounded blocks."""
    words = np.arange(1 << 16)
    words = words[np.argsort(simhash.gray_rank(words), kind="stable")]
    links, most = 0, 0
    for i, j in simhash.group_links(np.zeros(1 << 16, np.int64), words):
        assert (np.bitwise_count(words[i] ^ words[j]) <= 2).all()
        links, most = links + len(i), max(most, len(i))
    assert links == (1 << 16) * (16 + 120) // 2 and most <= simhash.BLOCK_PAIRS
    rng = np.random.default_rng(4)
    rows = np.unique(rng.integers(0, 1 << 9, 3000) << 16 | rng.integers(0, 1 << 16, 3000) & 0x0F0F)
    rows = rows[np.lexsort((simhash.gray_rank(rows & 0xFFFF), rows >> 16))]
    got = {(int(a), int(b)) for i, j in simhash.group_links(rows >> 16, rows & 0xFFFF) for a, b in zip(rows[i], rows[j])}
    want = {(int(a), int(b)) for a in rows for b in rows[(rows >> 16 == a >> 16) & (np.bitwise_count(rows ^ a) <= 2) & (rows != a)]}
    assert {frozenset(x) for x in got} == {frozenset(x) for x in want} and len(got) * 2 == len(want)


def test_simhash_linked_through_null_ids(spark, monkeypatch):
    """Documents without an id bridge two others; one fingerprint of most rows is salted."""
    f = {0: 0, 1: 0b11, 2: 0b1111, 3: 0b111111, 9: 7 << 40, 10: 0xFF << 50, 11: (0xFF << 50) | 1}
    rows = [(5, 0), (None, 1), (3, 2), (None, 9), (None, 10), (None, 11), (7, 3), *((100 + i, 9) for i in range(500)), *((None, 9) for i in range(300))]
    made = spark.createDataFrame([(d, f[k]) for d, k in rows], "doc_id long, f long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: made)
    got = simhash.near_duplicates(spark, made).collect()
    name = {0: 3, 1: 3, 2: 3, 3: 3, 9: 100, 10: None, 11: None}
    assert bag(got) == bag((d, f"{f[k]:016x}", name[k]) for d, k in rows)


def test_one_of_each(spark):
    """Rows that repeat an id with other texts are kept apart, as are rows without ids."""
    long = "the house by the river is old and it was built for the men of the town who came to work in the mill "
    rows = [(1, long, "a"), (2, long, "b"), (2, "another text altogether that is not like it", "c"), (2, "another text altogether that is not like it", "b"), (None, long, "d"), (None, "without id", "e"), (None, "without id", "e"), (None, None, "f"), (4, "", "g"), (3, " ", "h"), (7, "seven words stand here for no reason", "i"), (7, "seven other words are not the same", "j")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `odd name` string")
    got = simhash.one_of_each(spark, frame)
    assert got.columns == frame.columns
    assert bag(got.collect()) == bag([rows[0], rows[3], rows[5], rows[9], rows[10], rows[11]])
    assert simhash.one_of_each(spark, frame.where("false")).count() == 0


# 4
PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/ü", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 50), (6, "u", "z" * 300_000), (6, "u", "z" * 300_000), (None, "u", "<p>x</p>"), (9, "u", "中文")]


@pytest.mark.parametrize("step", [64, 4096, 8 << 20])
def test_warc(spark, step):
    pages = spark.createDataFrame([(*p, 1, "d") for p in PAGES], "page_id long, url string, html string, sha1 int, data string").repartition(2)
    folder = work_folder(spark, "test-warc")
    files = warc.write_archives(pages, folder)
    if step == 64:  # many ranges: only files without long payloads
        pages = pages.where("length(html) < 10000 or html is null")
        folder = work_folder(spark, "test-warc")
        files = warc.write_archives(pages, folder)
    got = warc.read_archives(spark, folder, files, step).collect()
    assert bag(r[:5] for r in got) == bag(brute.warc_rows([(r.page_id, r.html) for r in pages.collect()]))


def test_warc_damage_and_empty(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    folder = work_folder(spark, "test-warc")
    files = warc.write_archives(spark.createDataFrame([(i, "u", "y" * 100) for i in range(20)], "page_id long, url string, html string").coalesce(1), folder)
    whole = max(files, key=lambda f: f["bytes"])
    path = folder.removeprefix("file://") + "/" + whole["file"]
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-30])
    with pytest.raises(Exception):
        warc.read_archives(spark, folder, [whole | {"bytes": len(data) - 30}], 4096).collect()


def test_warc_long_header(spark):
    rows = [(i, "http://a/" + "x" * n, "<p>x</p>") for i, n in enumerate((10, 400_000, 20, 1_100_000, 30))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = work_folder(spark, "test-warc")
    files = warc.write_archives(pages, folder)
    for step in (1 << 16, 8 << 20):
        assert bag((r.page_id, r.url) for r in warc.read_archives(spark, folder, files, step).collect()) == bag(r[:2] for r in rows)


def test_warc_heavy_payload(spark):
    """Half of all pages carry one payload: dealt to many tasks, written once."""
    rows = [(i, "u", "error " * 500 if i % 2 else f"page {i}") for i in range(4000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = work_folder(spark, "test-warc")
    files = warc.write_archives(pages, folder)
    assert len(files) > 4 and sum(f["bytes"] for f in files) < 4000 * 600
    assert bag(r[:5] for r in warc.read_archives(spark, folder, files).collect()) == bag(brute.warc_rows([(p, h) for p, _, h in rows]))


def test_warc_of_other_writers(spark):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: text/dns\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    page = b"HTTP/1.1 200 OK\r\n\r\n<p>hi</p>"
    http = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(page), page)
    data = info + plain + http + info
    folder = work_folder(spark, "test-warc")
    from lodegraph.llm.common import publish

    publish(f"{folder}/other.warc", lambda out: out.write(data))
    got = warc.read_archives(spark, folder, [{"file": "other.warc", "bytes": len(data)}], 64).collect()
    assert {(r.page_id, r.payload_bytes, r.record_type) for r in got} == {(None, 3, "response"), (None, 9, "response")}
    assert {r.payload_digest for r in got} == {brute.warc_rows([(1, x)])[0][2] for x in ("xyz", "<p>hi</p>")}


# 5
def test_bpe(spark, docs):
    t = brute.tokenizer(BYTE)
    want = []
    for d, x in texts(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(brute.raw(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert bag(r[:4] for r in bpe.digests(docs, tokenizer(BYTE)).collect()) == bag(want)


def test_bpe_streams():
    coder, t = bpe.ByteText.of(tokenizer(BYTE)), brute.tokenizer(BYTE)
    rng = np.random.default_rng(3)
    for text in ["a" * 5000, "".join(chr(c) for c in rng.integers(97, 123, 3000)), "ab" * 900, "Ω" * 700]:
        data = text.encode()
        cut = [data[i : i + 7] for i in range(0, len(data), 7)]
        assert list(coder.transducer.stream(cut)) == t.encode(text, add_special_tokens=False).ids
    ids = t.encode("né 中 \U0001f600", add_special_tokens=False).ids
    assert "".join(coder.decode([i] for i in ids)) == t.decode(ids, skip_special_tokens=False)
    assert "".join(coder.decode([ids[1:3]])) == t.decode(ids[1:3], skip_special_tokens=False)


# 6
def test_packing(spark, docs):
    rows = packing.pack(spark, docs, tokenizer(WORD)).collect()
    want = collections.Counter()
    for d, t in texts(docs):
        ids = brute.word_ids([t])[0]
        want[d, len(ids)] += len(ids)
    got, sequences, known = collections.Counter(), collections.defaultdict(list), {d: brute.word_ids([t])[0] for d, t in texts(docs)}
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(brute.raw(known[r.doc_id][r.start : r.start + r.length]))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and (at > 2048 * 0.98 or at & (at - 1) == 0)


# 7
def test_pii(docs):
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in pii.detect(docs).collect())
    assert bag(r[:6] for r in pii.detect(docs).collect()) == bag(brute.personal_row(d, t) for d, t in texts(docs))


@pytest.mark.parametrize("text", ["a@b@c.de x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.256", "4111111111111111 4111-1111 1111-1111 1 2", "+1 (234) 567-89-01+44 20 7946 0958", "..@a.b +@-.-", "1" * 30, "x@y", "a.b+c%d_e-f@g-h.i.j", "+12345678", "4111 1111 1111 1111 4111 1111 1111 1111"])
def test_pii_base(text):
    found = pii.find(text)
    assert {k: found[k] for k in pii.BASE} == brute.personal(text)


def test_pii_added_and_mask():
    text = "iban GB82 WEST 1234 5698 7654 32, SSN: 219-09-9999, token = 'abcdef0123456789abcd', ftp://user:pa55@host.org/"
    found = pii.find(text)
    assert all(len(found[k]) == 1 for k in pii.ADDED)
    assert pii.masked("mail a@b.co now") == "mail [EMAIL] now" and pii.masked("") == ""


def test_pii_long_values():
    key = "eyJhbGciOiJSUzI1NiJ9." + "aB3_" * 300
    for cue, value, kind, rest in (("token=", key, "SECRET", ""), ("api_key: ", "k" * 600 + "7", "SECRET", " x"), ("https://", "u" * 300 + ":p", "CREDENTIAL", "@h"), ("https://", "u:" + "p" * 70_000, "CREDENTIAL", "@h")):
        assert pii.masked(cue + value + rest) == f"{cue}[{kind}]{rest}"


@pytest.mark.parametrize("seed", range(40))
def test_pii_added_brute(seed):
    rng = np.random.default_rng(seed)
    parts = ["token", "accessKey", "ApiKey: ", "API key = ", "passWord=", " : ", "=", "'", '"', " ", "\n", "abcdef0123456789abcd", "A1" * 20, "k" * 20, "SSN ", "Social Security no. ", "219-09-9999", "000-12-3456", "219-00-1234", "9", "ftp://", "https://user:pa55@host", "u:" + "p" * 30, "@", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89370400440532013001", "x", "İ", "ß", "token = token = ", "a@b.co", "-"]
    for _ in range(40):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), 25))
        found = pii.find(text)
        assert {k: found[k] for k in pii.ADDED} == brute.personal_added(text), text
        assert {k: found[k] for k in pii.BASE} == brute.personal(text), text


# 8
def test_nearest(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + rng.normal(size=16) * 0.3).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (None, [1.0] * 16), (3300, [1.0] * 3), (3400, [None] + [1.0] * 15), (200, rows[200][1]), *((5000 + i, rows[300][1]) for i in range(30))]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string")
    got = collections.defaultdict(list)
    for r in ann.search_every(spark, frame).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = brute.nearest([(i, v) for i, v in dict(rows).items() if v is None or len(v) == 16])
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for rows_ in got.values():
        assert [r for r, _, _ in sorted(rows_)] == list(range(1, 11)) and [(s, v) for _, v, s in sorted(rows_)] == sorted((s, v) for _, v, s in rows_)
    assert ann.search_every(spark, frame.where("false")).count() == 0


def test_nearest_without_clusters():
    """Vectors without neighbourhoods: the hard case for pivots."""
    x = np.random.default_rng(11).normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(len(x))
    want = brute.nearest(list(zip(ids.tolist(), x)), step=100)
    asked = ids[::100]
    pivots = x[np.random.default_rng(12).choice(len(x), ann.PIVOTS, replace=False)]
    q, v, _ = ann.search_block(ids, x, asked, x[asked], pivots, 10)
    hits = sum(len(set(v[q == a].tolist()) & {i for i, _ in want[a]}) for a in asked.tolist())
    assert hits >= 0.9 * 10 * len(asked)


def test_nearest_reads_few_postings():
    x = np.random.default_rng(13).normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = x[:1024]
    near = ann.prefixes(x, pivots, 64)
    files = ann.Files(near, len(pivots))
    place = {(v, p): a for v in range(200) for a, p in enumerate(near[v].tolist())}
    gains = files.gains(near[0])
    for v in range(200):  # the footrule of prefixes, a missing pivot being next
        footrule = sum(abs(place.get((0, p), 64) - place.get((v, p), 64)) for p in {*near[0].tolist(), *near[v].tolist()})
        assert footrule == 64 * 65 - 2 * gains[v]
    assert sum(np.diff(files.offsets)[near[0]]) < 8 * len(x)


def test_nearest_ties():
    """126 distinct vectors at one distance: the smallest ids, whatever their order."""
    axes = np.concatenate([np.eye(64)[1:], -np.eye(64)[1:]])
    ids, x = np.arange(1, 127), axes[np.random.default_rng(3).permutation(126)]
    q, v, s = ann.search_block(np.append(ids, 0), np.concatenate([x, np.eye(64)[:1]]), np.array([0]), np.eye(64)[:1], x[:100], 10, share=1.0)
    assert v.tolist() == list(range(1, 11)) and len(set(s.tolist())) == 1
    # copies of the query, and rows that repeat its id with other vectors, are told apart
    ids = np.array([0, 0, 0, 0, 5, 6, 7, 8])
    y = np.array([[1.0, 0], [1, 0], [1, 0.1], [1, 0.2], [1, 0], [1, 0], [1, 3], [1, 2]])
    q, v, s = ann.search_block(ids, y, np.array([0]), y[:1], y[:1], 3, share=1.0)
    assert v.tolist() == [5, 6, 8] and s.tolist() == [0, 0, 2]


# 9
def test_classifier(spark, edge, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_classifier.score(docs, model).collect()
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == known[r.doc_id] for r in held) > 0.93 * len(held)
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.fit(docs, flipped) == model
    odd = quality_classifier.score(edge, model).collect()
    assert len(odd) == len(ROWS) and len({r.score for r in odd if r.doc_id in (1, 2)}) == 1
    assert quality_classifier.score(empty, model).count() == 0
    none = quality_classifier.fit(docs, labels.where("false"))
    assert {r.score for r in quality_classifier.score(edge, none).collect()} == {0.5}


def test_classifier_of_few_labels(spark):
    """10 labelled bad texts held in, too few to train dictionaries on."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    few = labels.where(~quality_classifier.held_out(F.col("doc_id")) & (F.col("quality") == 0)).orderBy("doc_id").limit(10)
    model = quality_classifier.fit(docs, few.union(labels.where("quality = 1")))
    rows = [(known[r.doc_id], r.predicted) for r in quality_classifier.score(docs, model).collect() if r.held_out and r.doc_id in known]
    bad = [p for q, p in rows if q == 0]
    assert bad.count(0) > len(bad) / 2 and sum(q == p for q, p in rows) > 0.9 * len(rows)
    none = quality_classifier.fit(docs, labels.where("quality = 0"))
    assert none.constant < 0.5 and quality_classifier.keep_good(docs, none).count() == docs.count()


def test_classifier_brute(spark, small):
    """The same model and scores by plain code; whole texts count, also far behind their heads."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    docs = [(d, (t or "") + " tail of the text" * (2000 if d % 5 == 0 else 0)) for d, t in texts(small)]
    bad = [(10_000 + i, "buy now cheap click here win " * (20 + i)) for i in range(60)]  # enough to train on
    docs, known = docs + bad, known | {d: 0 for d, _ in bad}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality_classifier.fit(frame, spark.createDataFrame(list(known.items()), "doc_id long, quality int"))
    good, bad, scores = brute.quality(docs, known, quality_classifier)
    assert (model.good, model.bad) == (good, bad)
    got = {r.doc_id: r.score for r in quality_classifier.score(frame, model).collect()}
    assert got.keys() == scores.keys() and all(abs(got[d] - scores[d]) < 1e-6 for d in got)


def test_classifier_odd_labels(spark, small):
    """Null and repeated labels, ids without a document, documents without text."""
    rows = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()]
    docs = small.select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9002, ""), (None, "x")], "doc_id long, text string"))
    fits = lambda more: quality_classifier.fit(docs, spark.createDataFrame(rows + more, "doc_id long, quality int"))
    plain = fits([])
    assert plain.weights and fits([(d, None) for d, _ in rows[:50]] + [(None, 1), (rows[0][0], 7)] + rows[:50]) == plain
    assert fits([(9001, 0), (9002, 1), (9003, 0)]).weights


# 10
def test_licenses(spark, edge, empty):
    mit = licenses.TEMPLATES["MIT"][3]
    apache = licenses.TEMPLATES["Apache-2.0"][3]
    cases = {
        0: ("Some code. SPDX-License-Identifier: MIT\nmore", "MIT"), 1: ("x\n" + mit.replace("Software", "SOFTWARE", 1) + "\ny", "MIT"), 2: (apache.replace("  ", " ").upper(), "Apache-2.0"),
        3: ("we licensed our land to the village", ""), 4: ("All rights reserved.", "Proprietary"), 5: ("licensed under the GNU General Public License, version 3 or so", "GPL-3.0"),
        6: ("released under the MIT License and licensed under CC BY-NC 4.0", "CC-BY-NC-4.0,MIT"), 7: (None, ""), 8: ("", ""), 10: ("see\nlicensed under the Apache\nLicense, Version 2.0 here", "Apache-2.0"), 11: ("head\n" + apache.replace(" writing, ", " writing,\n").replace("OF ANY", "OF\nANY"), "Apache-2.0"), 9: ("y " * 100_000 + "SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    }
    frame = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(frame).collect()}
    assert {i: r.licenses for i, r in rows.items()} == {i: want for i, (_, want) in cases.items()}
    for i, r in rows.items():
        for span in filter(None, r.spans.split(",")):
            name, a, b = span.rsplit(":", 2)
            assert 0 <= int(a) < int(b) <= len(cases[i][0])
    assert licenses.scan(edge).count() == len(ROWS) and licenses.scan(empty).count() == 0


def test_licenses_of_one_block():
    """Wordings that share most of their words, all near the first cue."""
    scanner = licenses.Scanner()
    short = [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts if len(t) < 60]
    for seed in range(100):
        some = [short[i] for i in np.random.default_rng(seed).choice(len(short), 3, replace=False)]
        hits = scanner.scan("\nor\n".join(t for _, t in some))
        assert [n for n, _, _ in hits] == [n for n, _ in some]


@pytest.mark.parametrize("name", ["GPL-2.0", "GPL-3.0"])
def test_licenses_nearest_wording(name):
    text = licenses.TEMPLATES[name][2]
    assert licenses.Scanner().scan(text) == [(name, 0, len(text) - 1)]


def test_licenses_past_the_first_cue():
    """Wordings that go on where the text about an earlier cue ends."""
    isc = licenses.TEMPLATES["ISC"][1]
    for head in ("ISC License\n\nCopyright (c) 2020, Jane Doe\n\n", "Copyright (c) 2020, Jane Doe\n\n"):
        for wording in (isc, isc.replace(" ", "\n *    ")):
            assert [n for n, _, _ in licenses.Scanner().scan(head + wording)] == ["ISC"]
    for n in range(150, 260):
        text = "Copyright " + "x" * n + " SPDX-License-Identifier: Apache-2.0 x"
        assert licenses.Scanner().scan(text) == [("Apache-2.0", n + 11, len(text) - 2)]


@pytest.mark.parametrize("apart", ["\n", "\n// file b\n"])
def test_licenses_repeated(apart):
    scanner = licenses.Scanner()
    for name, wordings in licenses.TEMPLATES.items():
        for t in wordings:
            text = apart.join([t] * 5)
            hits = scanner.scan(text)
            assert [n for n, _, _ in hits] == [name] * 5 and all(text[a:b] == t.rstrip(".") for _, a, b in hits)


def test_licenses_repeated_with_other_words():
    """A long wording, too much of it changed, before one with a word changed."""
    mit = licenses.TEMPLATES["MIT"][3]
    text = mit.replace("copy", "xerox").replace("the", "das") + "\n" + mit.replace("granted", "given") + "\n" + mit
    assert [(n, a) for n, a, _ in licenses.Scanner().scan(text)] == [("MIT", text.index("Permission is hereby given")), ("MIT", text.rindex("Permission"))]


@pytest.mark.parametrize("seed", range(12))
def test_licenses_brute(seed):
    """Wordings of all kinds, whole or slightly changed, in prose that holds cues of its own."""
    rng = np.random.default_rng(seed)
    everything = [t for ts in licenses.TEMPLATES.values() for t in ts]
    prose = "the license of the house and its copyright reserved a permission to use public domain mit version 2.0 under spdx gnu general software of this".split()
    parts = []
    for _ in range(6):
        parts.append(" ".join(rng.choice(prose, rng.integers(0, 40))))
        words = everything[rng.integers(len(everything))].split(" ")
        if len(words) > licenses.SHORT:
            for i in rng.choice(np.arange(8, len(words) - 8), rng.integers(0, len(words) // 40 + 1), replace=False):
                words[i] = "xylophone"
        parts.append(rng.choice([" ", "\n", "\n# ", " " * 300]).join(words))
    text = "\n".join(parts)
    assert licenses.Scanner().scan(text) == brute.licenses(text, licenses.TEMPLATES)


def test_licenses_far_from_a_cue():
    """Near cues, none of which is left out: after white space, and far apart."""
    for apart in (" " * 150, " " * 185, " " * 300, "\n * " * 70):
        text = f"all rights reserved{apart}released under the MIT License{apart}SPDX-License-Identifier: MIT{apart}SPDX-License-Identifier: MIT"
        assert [n for n, _, _ in licenses.Scanner().scan(text)] == ["Proprietary", "MIT", "MIT", "MIT"]
        assert [n for n, _, _ in licenses.Scanner().scan(f"licensed under the{apart}MIT License, all rights{apart}reserved")] == ["MIT", "Proprietary"]
    scanner = licenses.Scanner()
    assert all(scanner._cue.search(t) for ts in licenses.TEMPLATES.values() for t in ts)
    many = "copyright of a word " * 3000 + "SPDX-License-Identifier: MIT " * 2000
    assert [n for n, _, _ in scanner.scan(many)] == ["MIT"] * 2000
