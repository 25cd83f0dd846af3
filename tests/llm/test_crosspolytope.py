"""Links by hashing against all pairs, with clusters, copies and vectors that link with nothing."""

from __future__ import annotations

import numpy as np
import pytest

from colophon.llm import crosspolytope as cp

SCHEMA = "vec_id long, embedding array<float>, label int, key string, class string"


def brute(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for i in range(len(x)):
        for j in np.flatnonzero(near[i]):
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    return near.sum(axis=1), label


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(cp.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(cp.hadamard(cp.hadamard(x)), x)


@pytest.mark.parametrize("cos", [0.9, 0.95])
def test_recall_of_pairs_at_the_threshold(cos):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    b = cos * a + np.sqrt(1 - cos**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    ka, kb = cp.buckets(a, cp.TABLES, cp.PROBES), cp.buckets(b, cp.TABLES, cp.PROBES)
    assert (ka[:, :, None] == kb[:, None, :]).any(axis=(1, 2)).mean() >= 0.99


def test_links_and_components(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(30, 64))
    x = np.concatenate([rng.normal(size=(200, 64)), *[c + 0.1 * rng.normal(size=(12, 64)) for c in centre], centre[0] + 0.05 * rng.normal(size=(150, 64))])
    x = np.concatenate([x, x[:5], x[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), None, "x", "y") for i, v in enumerate(x)]
    odd = [[0.0] * 64, None, [float("nan")] * 64, [None, *[1.0] * 63], [float("inf"), *[1.0] * 63], [], [1e-30] * 64]
    rows += [(1000 + i, v, 0, "x", "y") for i, v in enumerate(odd)] + [(None, None, 0, "x", "y")]
    frame = spark.createDataFrame(rows, SCHEMA)
    n, label = brute(x.astype(np.float64))
    for block_rows in (cp.BLOCK_ROWS, 40):
        got = {r.vec_id: r for r in cp.near_duplicates(frame, block_rows=block_rows).collect()}
        assert len(got) == len(rows)
        for i in range(len(x)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], label[i], label[i] == i)
        for r in (got[1000 + i] for i in range(len(odd))):
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        assert got[None].component_id is None and got[None].n_links == 0


def test_empty_table(spark):
    assert cp.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
