"""Byte-level BPE by a streaming transducer with bounded lookahead (operator 5).

The encoder reads bytes left to right and keeps, for each of the last
``lookahead`` positions, the last token of the tokenization of the text up to
there. A token may end a prefix if it and the last token before it stay apart
when merged together, which is decided by the merge list alone; exactly one
does. No token is longer than ``lookahead`` bytes (computed from the merge
list), so whatever follows continues from one of that many open prefixes, and a
token that all of them share is final: it is emitted and its state dropped. For
proper merge lists (each token's bytes encode to itself, which is verified) the
result equals that of applying the merges in order of their ranks.

The decoder turns ids into bytes and bytes into text by an incremental UTF-8
state machine; malformed parts give U+FFFD.

``encode_documents`` runs the transducer once for each distinct piece of a
batch. Pieces are cut at single spaces, where the pre-tokenizer always cuts;
texts with a space before other white space are pre-tokenized whole.

Defined results: null text counts as empty (no ids, empty text decoded); a
special token's string is its id, as in the library; repeated rows are encoded
alike; an empty table gives no rows; a null doc_id is carried along.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns
from .ragged import gather, offsets_of
from .wordtok import byte_characters

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes between two looks for final tokens in a long piece.
_EMIT_EVERY = 256
BATCH_BYTES = 12 << 20
#: Pre-tokens whose ids are remembered at most.
MEMO = 300_000
_OPEN: dict[str, "Transducer"] = {}


class Transducer:
    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.vocabulary = vocabulary
        self.sizes = {i: len(b) for b, i in vocabulary.items()}
        #: By token: the two that it is made of, and the rank of that merge.
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.joined.setdefault((x, y), rank)
            if z not in self.parts:
                self.parts[z], self.rank[z] = (x, y), rank
        #: Longest token in bytes: more open prefixes than these can't matter.
        self.lookahead = max(map(len, vocabulary))
        self._apart: dict[tuple[int, int], bool] = {}
        #: Longest token by its last three bytes.
        self._longest: dict[bytes, int] = {}
        for b in vocabulary:
            if len(b) > self._longest.get(b[-3:], 2):
                self._longest[b[-3:]] = len(b)
        self.improper = [t for t in self.parts if not self._proper(t)]

    def _proper(self, token: int) -> bool:
        return self.stays_apart(*self.parts[token], below=self.rank[token])

    def stays_apart(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether the bytes of both, merged in order of rank, give just these
        two. The seam is undone merge by merge, the later one first; a merge
        over the seam that ranks before what it would break up wins."""
        limit = 1 << 60 if below is None else below
        joined, parts, rank = self.joined, self.parts, self.rank
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:  # of equal merges the one further left, that over the seam, comes first
                limit, right = b + 1, parts[right][0]

    def _may_follow(self, left: int, right: int) -> bool:
        got = self._apart.get((left, right))
        if got is None:
            if len(self._apart) > 1 << 20:
                self._apart.clear()
            got = self._apart[left, right] = self.stays_apart(left, right)
        return got

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that arrives in parts, each as soon as it is
        final; state is held for the open prefixes only."""
        vocabulary, longest, may = self.vocabulary, self.lookahead, self._may_follow
        held = bytearray()  # bytes from the last emitted boundary on
        last: list[int] = [-1]  # last token of the prefix that ends at each position of held
        for part in data:
            for byte in part:
                held.append(byte)
                i = len(held)
                for n in range(min(i, longest), 0, -1):
                    token = vocabulary.get(bytes(held[i - n : i]))
                    if token is not None and ((before := last[i - n]) < 0 or may(before, token)):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token ends in byte {byte}")
                if i % _EMIT_EVERY == 0:
                    yield from self._emit(held, last)
        yield from self._back(last, len(held))

    def _back(self, last: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at -= self.sizes[last[at]]
        return out[::-1]

    def _emit(self, held: bytearray, last: list[int]) -> list[int]:
        """Tokens that every open prefix shares; drops their state."""
        open_ = set(range(max(0, len(held) - self.lookahead + 1), len(held) + 1))
        while len(open_) > 1:
            top = max(open_)
            open_.discard(top)
            open_.add(top - self.sizes[last[top]])
        end = open_.pop()
        out = self._back(last, end)
        if end:
            del held[:end]
            del last[:end]  # last[0] is now the token before the boundary
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.vocabulary.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > self.lookahead:
            return list(self.stream((piece,)))
        # the same for a piece within the lookahead: nothing is final before its end
        get, apart, may = self.vocabulary.get, self._apart.get, self._may_follow
        last, n, longest = [-1], len(piece), self._longest.get
        for i in range(1, n + 1):
            for j in range(i - longest(piece[i - 3 : i], 2) if i > 2 else 0, i):
                if j < 0:
                    continue
                token = get(piece[j:i])
                if token is not None:
                    before = last[j]
                    if before < 0:
                        break
                    ok = apart((before, token))
                    if ok or ok is None and may(before, token):
                        break
            last.append(token)
        out = []
        sizes = self.sizes
        while n:
            token = last[n]
            out.append(token)
            n -= sizes[token]
        out.reverse()
        return out


class ByteText:
    """Pre-tokenizer, transducer, special tokens and decoder of a vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_characters())}
        raw = lambda token: bytes(back[c] for c in token)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.transducer = Transducer(vocabulary, [(raw(a), raw(b)) for a, b in pairs])
        if self.transducer.improper:
            raise ValueError("the merge list is improper: some tokens' bytes don't encode to them")
        self.special = special
        self._memo: dict[str, list[int]] = {}
        self.table = {i: b for b, i in vocabulary.items()} | {i: s.encode() for s, i in special.items()}
        self.split = regex.compile(_PATTERN).findall
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else lambda t: [t]

    @classmethod
    def of(cls, path: str) -> "ByteText":
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text or of a piece between pre-token boundaries."""
        out: list[int] = []
        memo = self._memo
        for part in self._cut(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                for token in self.split(part):
                    ids = memo.get(token)
                    if ids is None:
                        ids = self.transducer.encode(token.encode())
                        if len(memo) >= MEMO:
                            memo.clear()
                        if len(token) <= 32:
                            memo[token] = ids
                    out += ids
        return out

    def decode(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """Text of ids that arrive in parts."""
        step = codecs.getincrementaldecoder("utf-8")("replace").decode
        for part in ids:
            yield step(b"".join(map(self.table.__getitem__, part)))
        yield step(b"", True)

    def encode_batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of an Arrow array of texts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
        odd = pc.match_substring_regex(texts, r" [\s\x0b\x1c-\x1f\x85\p{Z}]")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        whole = [np.array(self.encode(t), np.uint32) for t in texts.filter(odd).to_pylist()]
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        pieces = split.flatten().dictionary_encode()
        outer = np.asarray(split.offsets) - split.offsets[0].as_py()
        index = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = pieces.dictionary.to_pylist()
        first = np.zeros(len(index), bool)
        first[outer[:-1]] = True
        lead = np.unique(index[first])  # pieces that begin a text have no space before them
        rank = np.full(len(words), -1, np.int64)
        rank[lead] = np.arange(len(lead)) + len(words)
        index = np.where(first, rank[index], index)
        flat: list[int] = []
        lengths = np.zeros(len(words) + len(lead), np.int64)
        for i, w in enumerate([*(" " + w for w in words), *(words[k] for k in lead)]):
            ids = self.encode(w)
            lengths[i] = len(ids)
            flat += ids
        values, offsets = gather(np.array(flat, np.uint32), offsets_of(lengths), index)
        ends = offsets[outer]
        if not whole:
            return values, ends
        order = np.arange(len(texts))
        order[odd.to_numpy(zero_copy_only=False)] = np.arange(len(whole)) + len(texts)
        return gather(np.concatenate([values, *whole]), np.concatenate([ends, ends[-1] + np.cumsum([len(w) for w in whole])]), order)


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit)``, decoded``."""
    return _run(docs, vocabulary, key, text, lambda raw, decoded: (raw, decoded), ("ids binary", "decoded string"))


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _run(docs, vocabulary, key, text, lambda raw, decoded: (sha(raw), sha(decoded.encode())), ("ids_sha256 string", "decoded_sha256 string"))


def _run(docs: DataFrame, vocabulary: str, key: str, text: str, last, kinds: tuple[str, str]) -> DataFrame:
    names = [k.split()[0] for k in kinds]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        coder = ByteText.of(vocabulary)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
                ids, offsets = coder.encode_batch(batch.column(1).slice(at, to - at))
                out = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    part = ids[a:b]
                    out.append(last(part.astype("<u4").tobytes(), "".join(coder.decode(part[i : i + 8192].tolist() for i in range(0, len(part), 8192)))))
                kind = [pa.binary() if "binary" in k else pa.string() for k in kinds]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(np.diff(offsets)), *(pa.array([o[i] for o in out], kind[i]) for i in (0, 1))], names=["doc_id", "n_tokens", *names])
                at = to

    rows = columns(docs, key, text).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {kinds[0]}, {kinds[1]}")
