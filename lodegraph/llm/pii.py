"""Personal data by anchor expansion (operator 7).

One Aho-Corasick pass over a text finds anchors: at-signs, ``+`` before a digit,
digits, URL schemes and identifier cues. From each a deterministic parser
expands to the boundaries of what may stand there and validates it. Parsers
move on from where the last one of their kind ended, so a text is read in time
that follows its length, whatever it holds.

Base kinds: email, ip (four parts of at most 255), card (13 to 19 digits, Luhn)
and phone (9 to 15 digits). Added kinds, all with validation: credential
(``user:password@`` in a URL), iban (mod 97), secret (a value of 16 characters or
more, letters and digits among them, after a cue such as ``token =``), ssn (at
most 24 characters past its cue, without digits or line breaks between). Cues
are found in upper and lower case.

Defined results: null text counts as empty and has no spans; offsets are in code
points, ends exclusive; repeated rows are read alike; an empty table gives no
rows; a null doc_id is carried along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

BASE = ("email", "ip", "card", "phone")
ADDED = ("credential", "iban", "secret", "ssn")
_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\"']?[ \t]*+[=:][ \t]*+[\"']?([A-Za-z0-9_/+.~-]{16,}+)")
_SSN = re.compile(r"[^0-9\n]{0,24}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")
_USER = re.compile(r"[^\s/?#@:<>\"']++:[^\s/?#@<>\"']++(?=@)")
#: In lower case; found in any.
_SECRET_CUES = ("token", "secret", "api_key", "api-key", "api key", "apikey", "password", "passwd", "access_key", "access-key", "accesskey", "private_key", "private-key", "privatekey")
_SSN_CUES = ("ssn", "social security")
_LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words = {"@": "at", "://": "scheme"} | {d: "digit" for d in _DIGITS} | {f"+{d}": "plus" for d in _DIGITS}
    words |= dict.fromkeys(_SECRET_CUES, "secret") | dict.fromkeys(_SSN_CUES, "ssn")
    for w, what in words.items():
        a.add_word(w, what)
    a.make_automaton()
    return a


_OPEN: list = []


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in order of its starts."""
    if not _OPEN:
        _OPEN.append(_automaton())
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    past = dict.fromkeys((*out, "dotted", "chain"), 0)  # where the next one of each may begin
    low = text.lower()
    if len(low) != len(text):  # a letter that is two in lower case
        low = text.translate(_LOWER)
    for end, what in _OPEN[0].iter(low):
        if what == "digit":
            if end >= past["dotted"]:
                run = _DOTTED.match(text, end).span()
                past["dotted"] = run[1]
                if text.find(".", *run) >= 0:
                    _ips(text, *run, out["ip"])
            if end >= past["chain"]:
                run = _CHAIN.match(text, end).span()
                past["chain"] = run[1]
                if run[1] - run[0] >= 13:
                    digits = text[slice(*run)].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(run)
            if end >= past["iban"] and end >= 2 and text[end - 1].isupper():
                at = end - 2
                if (at == 0 or not text[at - 1].isalnum()) and (m := _IBAN.match(text, at)) and _mod97(m[0]):
                    out["iban"].append(m.span())
                    past["iban"] = m.end()
        elif what == "at":
            start, least = end, past["email"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (m := _DOMAIN.match(text, end + 1)):
                out["email"].append((start, m.end()))
                past["email"] = m.end()
        elif what == "plus":
            if m := _PHONE.match(text, end - 1):
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif what == "scheme":
            if m := _USER.match(text, end + 1):
                out["credential"].append(m.span())
        elif what == "secret":
            if end >= past["secret"] and (m := _SECRET.match(text, end + 1)):
                value = m[1]
                if any(c in _DIGITS for c in value) and any(c.isalpha() for c in value):
                    out["secret"].append(m.span(1))
                    past["secret"] = m.end()
        elif end >= past["ssn"] and (m := _SSN.match(text, end + 1)):
            out["ssn"].append(m.span(1))
            past["ssn"] = m.end()
    return out


def _ips(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    """Of a run of numbers with single dots between, each four in turn."""
    parts, at = [], start
    for part in text[start:end].split("."):
        parts.append((at, at + len(part), part))
        at += len(part) + 1
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        if all(len(p := x[2].lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
            out.append((four[0][0], four[3][1]))


def _mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of spans that
    overlap, the one that begins first (then the longest) gives the name."""
    spans = sorted((a, -b, k) for k, v in find(text).items() for a, b in v)
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [find(t or "") for t in batch.column(1).to_pylist()]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE]
            base = pa.array([hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, base, pa.array([joined(f, BASE + ADDED) for f in found], pa.string()), pa.array([sum(map(len, f.values())) for f in found], pa.int64())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    rows = columns(docs, key, text).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with masked texts (null stays null); other columns as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            new = pa.array([None if t is None else masked(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
