"""Searches for many vectors: what a task holds."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lodegraph.operators import knn


def lists(x):
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.astype(np.float32).ravel())


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_a_block_is_bound_in_memory(metric):
    """A full block of vectors and 512 queries in single-precision lists: no Python
    numbers, no more scores at a time than the bound; the same as one by one."""
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((knn.BLOCK_ROWS, 64)), rng.standard_normal((512, 64))
    x[5], x[6], q[0] = 0, x[7], x[7]
    ids = rng.permutation(len(x)) << 20
    left, right = pa.table({"id": ids, "v": lists(x)}), pa.table({"q": lists(q)})
    tracemalloc.start()
    out = knn.search(left, right, metric, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    x, q = x.astype(np.float32).astype(np.float64), q.astype(np.float32).astype(np.float64)
    got = out.column("id").to_numpy().reshape(512, 3)
    for i in (0, 1, 511):
        d = knn.distances(metric, q[i : i + 1], x)[0]
        assert got[i].tolist() == ids[np.lexsort((ids, d.round(12)))[:3]].tolist()


def test_a_block_of_uneven_vectors():
    left = pa.table({"id": [1, 2], "v": pa.array([[1.0], [1.0, 2.0]], pa.list_(pa.float32()))})
    with pytest.raises(ValueError):
        knn.search(left, pa.table({"q": pa.array([[1.0]], pa.list_(pa.float32()))}), "dot", 1)
