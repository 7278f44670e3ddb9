"""Slow, plain versions of the training-data operators, to test against."""

import base64
import functools
import hashlib
import re
import zlib

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@functools.cache
def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


def word_ids(texts):
    t = tokenizer("word_bpe_49k.json")
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def store_rows(rows):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = word_ids([text])[0]
        out.append((doc, start, len(ids), zlib.crc32(raw(ids))))
        start += len(ids)
    return out


def rules_base(text):
    text = text or ""
    words = SPACE.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def simhash(text):
    from xxhash import xxh64_intdigest

    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows):
    prints = [(d, simhash(t)) for d, t in rows]
    distinct = np.array(sorted({f for _, f in prints}), np.uint64)
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i] = parent[parent[i]]
        return i

    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(distinct ^ f) <= 2):
            parent[root(int(j))] = root(i)
    at = {int(f): i for i, f in enumerate(distinct)}
    low = {}
    for d, f in prints:
        r = root(at[f])
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, f"{f:016x}", low.get(root(at[f]))) for d, f in prints]


def warc_rows(rows):
    top = {}
    for page, html in rows:
        h = (html or "").encode()
        top[h] = max(top.get(h, page), page, key=lambda p: (p is not None, p or 0))
    out = []
    for page, html in rows:
        h = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        first = top[h] == page
        out.append((page, len(h), digest, "response" if first else "revisit", None if first else top[h]))
    return out


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (2 * d > 9)
        total += d
    return total % 10 == 0


KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def personal(text):
    text = text or ""
    out = {}
    for kind, pattern in KINDS.items():
        out[kind] = []
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                ok = 13 <= len(digits) <= 19 and luhn(digits)
            elif kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out[kind].append(m.span())
    return out


def personal_row(doc, text):
    s = personal(text)
    joined = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in s[k])
    return (doc, *(len(s[k]) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest())


def nearest(rows, k=10, step=100):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % step == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def _same(a, b):
    """Length of the longest common subsequence with every prefix of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row


def licenses(text, templates, short=40):
    """Every wording at every word of a text, cues or not; of one template's that
    overlap the one with the fewest words different, then of all the longest."""
    words = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]+(?:[.'-][^\W_]+)*", text)]
    block, found = [w for w, _, _ in words], []
    for name, texts in templates.items():
        for t in texts:
            want = [m[0].lower() for m in re.finditer(r"[^\W_]+(?:[.'-][^\W_]+)*", t)]
            n = len(want)
            off, own = 0 if n <= short else n // 20, []
            for i in range(len(block)):
                if block[i] not in want[: off + 1]:
                    continue
                if not off:
                    if block[i : i + n] == want:
                        own.append((0, words[i][1], words[i + n - 1][2]))
                    continue
                some = block[i : i + n + off]
                same = _same(want, some)
                ends = [(n - same[k] + k - same[k], k) for k in range(1, len(some) + 1) if n - same[k] <= off and k - same[k] <= off and same[k] > same[k - 1]]
                if ends:
                    different, k = min(ends, key=lambda e: (e[0], -e[1]))
                    own.append((different, words[i][1], words[i + k - 1][2]))
            for different, a, b in sorted(own):  # of one template, the nearest to it
                if all(f[2] != t or b <= f[0] or f[1] <= a for f in found):
                    found.append((a, b, t, different, name))
    kept = []
    for a, b, _, _, name in sorted(found, key=lambda f: (f[0] - f[1], f[3], f[0], f[4])):
        if all(b <= x or y <= a for x, y, _ in kept):
            kept.append((a, b, name))
    return [(name, a, b) for a, b, name in sorted(kept)]


def quality(docs, known, parameters):
    """Dictionaries and scores of the classifier, for samples below its bound."""
    import zstandard

    fitted = {q: sorted((d, t.encode()) for d, t in docs if t and known.get(d) == q and zlib.crc32(str(d).encode()) % 3 != 1) for q in (0, 1)}
    ids = {q: sorted(d for d, k in known.items() if k == q and zlib.crc32(str(d).encode()) % 3 != 1) for q in (0, 1)}
    halves = {q: [[t for d, t in fitted[q] if ids[q].index(d) % 2 == part] for part in (0, 1)] for q in (0, 1)}
    raw = {q: zstandard.train_dictionary(min(parameters.DICTIONARY_BYTES, max(1024, sum(map(len, halves[q][0])) // 4)), halves[q][0]).as_bytes() for q in (0, 1)}

    def size(q, data):
        dictionary = zstandard.ZstdCompressionDict(raw[q])
        dictionary.precompute_compress(level=parameters.LEVEL)
        coder = zstandard.ZstdCompressor(level=parameters.LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)
        return len(coder.compress(data)) - len(coder.compress(b""))

    def gap(text):
        data, step = text.encode(), parameters.SEGMENT_BYTES
        return sum(size(0, data[i : i + step]) - size(1, data[i : i + step]) for i in range(0, len(data), step)) / len(data) if data else 0.0

    x = np.array([gap(t.decode()) for q in (0, 1) for t in halves[q][1]])
    y = np.array([q for q in (0, 1) for _ in halves[q][1]])
    weight = np.array([len(ids[q]) / (y == q).sum() for q in y])
    weight, c, s = weight / weight.mean(), 0.0, 0.0
    for _ in range(200):  # damped Newton steps on the two parameters
        p = 1 / (1 + np.exp(-(c + s * x)))
        gc, gs, r = (weight * (y - p)).sum() - 1e-3 * c, (weight * (y - p) * x).sum() - 1e-3 * s, weight * p * (1 - p)
        hcc, hcs, hss = r.sum() + 1e-3, (r * x).sum(), (r * x * x).sum() + 1e-3
        det = hcc * hss - hcs * hcs
        c, s = c + np.clip((hss * gc - hcs * gs) / det, -10, 10), s + np.clip((hcc * gs - hcs * gc) / det, -10, 10)
    return raw[1], raw[0], {d: float(1 / (1 + np.exp(-(c + s * gap(t or ""))))) for d, t in docs}


CUES = {
    "secret": ("token", "secret", "api_key", "api-key", "api key", "apikey", "password", "passwd", "access_key", "access-key", "accesskey", "private_key", "private-key", "privatekey"),
    "ssn": ("ssn", "social security"),
    "credential": ("://",),
}
BEHIND = {
    "secret": r"""["']?[ \t]*[=:][ \t]*["']?([A-Za-z0-9_/+.~-]{16,})""",
    "ssn": r"[^0-9\n]{0,24}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])",
    "credential": r"""([^\s/?#@:<>"']+:[^\s/?#@<>"']+)(?=@)""",
}


def personal_added(text):
    """Added kinds, tried at every place of a text."""
    out = {k: [] for k in (*CUES, "iban")}
    for kind, cues in CUES.items():
        past = 0
        for end in range(1, len(text) + 1):
            if end - 1 < past or not any(text[max(0, end - len(c)) : end].lower() == c for c in cues):
                continue
            m = re.compile(BEHIND[kind]).match(text, end)
            if m and kind == "secret" and not (any(c.isdigit() and c.isascii() for c in m[1]) and any(c.isalpha() for c in m[1])):
                continue
            if m and kind == "ssn" and (m[1][:3] in ("000", "666") or m[1][0] == "9" or m[1][4:6] == "00" or m[1][7:] == "0000"):
                continue
            if m:
                out[kind].append(m.span(1))
                past = m.end(1) if kind != "credential" else 0
    at = 0
    while at < len(text):
        m = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])").match(text, at)
        if m and not (at and text[at - 1].isalnum()):
            s = m[0].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                out["iban"].append(m.span())
                at = m.end()
                continue
        at += 1
    return out
