"""Lists of unequal length as flat arrays: values and offsets."""

from __future__ import annotations

import numpy as np


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number ``index[0], index[1], ...``, one after the other."""
    starts = offsets[index]
    lengths = offsets[index + 1] - starts
    out = offsets_of(lengths)
    at = np.repeat(starts - out[:-1], lengths)
    at += np.arange(out[-1])
    return values[at], out


def flatten(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Offsets of the values of lists of lists."""
    return inner[outer]
