"""Whole texts to token ids by the tokenizers library, each word once a batch.

The tokenizer (lower case, white space dropped, merges inside words) never joins
two chunks that ASCII white space parts, so the ids of a text are those of its
chunks, one after the other. A batch of texts is split, its distinct chunks and
then their distinct words are found by Arrow, each distinct word goes to the
library's own BPE model, and the ids are gathered back. Chunks with characters
other than printable ASCII or Latin letters below U+0250, and those that may
hold a special token, go through the library's whole encode(). Nothing is kept
from batch to batch, so memory follows the batch alone.
"""

from __future__ import annotations

import os

import numpy as np

from .ragged import flatten, gather, offsets_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text that are encoded at a time.
BATCH_BYTES = 12 << 20
_OPEN: dict[tuple, "WordEncoder"] = {}
_WORDS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
_PLAIN = "^[!-~¡-įıĲ-ɏ]*$"


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        self._model = self._tokenizer.model
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._end = end_id
        self._stand = dict(enumerate(byte_characters()))

    @classmethod
    def of(cls, path: str, end_id: int) -> "WordEncoder":
        """The one of this Python worker."""
        if (path, end_id) not in _OPEN:
            _OPEN[path, end_id] = cls(path, end_id)
        return _OPEN[path, end_id]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        lengths = np.zeros(len(words), np.int64)
        merge, stand = self._model.tokenize, self._stand
        for i, word in enumerate(words):
            got = merge(word if word.isascii() else word.encode().decode("latin-1").translate(stand))
            lengths[i] = len(got)
            flat += [t.id for t in got]
        return np.array(flat, np.uint32), offsets_of(lengths)

    def _chunks(self, chunks) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of distinct chunks."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.and_(pc.match_substring_regex(chunks, _PLAIN), pc.invert(pc.match_substring(chunks, "<|")))
        odd = chunks.filter(pc.invert(plain))
        text = pc.utf8_lower(pc.if_else(plain, chunks, ""))  # already composed: no combining marks
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(text, _WORDS, r"\1 "))
        words = split.flatten().dictionary_encode()
        values, offsets = gather(*self._ids(words.dictionary.to_pylist()), words.indices.to_numpy(zero_copy_only=False))
        offsets = flatten(np.asarray(split.offsets) - split.offsets[0].as_py(), offsets)
        if not len(odd):
            return values, offsets
        whole = [np.array(self._tokenizer.encode(c, add_special_tokens=False).ids, np.uint32) for c in odd.to_pylist()]
        index = np.arange(len(chunks))
        index[~plain.to_numpy(zero_copy_only=False)] = np.arange(len(whole)) + len(chunks)
        joined = np.concatenate([values, *whole])
        return gather(joined, np.concatenate([offsets, offsets[-1] + np.cumsum([len(w) for w in whole])]), index)

    def _batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        chunks = split.flatten().dictionary_encode()
        values, offsets = gather(*self._chunks(chunks.dictionary), chunks.indices.to_numpy(zero_copy_only=False))
        ends = flatten(np.asarray(split.offsets) - split.offsets[0].as_py(), offsets)
        n = len(texts)
        out = np.full(len(values) + n, self._end, np.uint32)
        at = np.arange(len(values)) + np.repeat(np.arange(n), np.diff(ends))
        out[at] = values
        return out, ends + np.arange(n + 1)

    def encode(self, texts):
        """``(ids, offsets)`` of an Arrow array of texts, in parts of about
        ``BATCH_BYTES``; null counts as empty, each text ends with the end id."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.cast(texts, pa.large_string())
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
            yield at, to, *self._batch(texts.slice(at, to - at))
            at = to
