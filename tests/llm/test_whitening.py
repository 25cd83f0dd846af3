"""Whitening against a dense eigensolver, counts against eigenvalues, and defined results for odd rows."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from colophon.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string"


def brute(rows):
    """n, deviations, covariance by the definition, in exact integers and double precision."""
    single = lambda c: struct.unpack("f", struct.pack("f", c))[0]
    x = [[math.floor(64 * single(c)) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * e - s) ** 2 for e, s in zip(v, sums)) for v in x]
    centred = np.array([[e - s / n for e, s in zip(v, sums)] for v in x])
    return n, deviation, centred, centred.T @ centred / n


@pytest.mark.parametrize("n,width", [(400, 64), (50, 40), (3000, 5)])
def test_equals_a_dense_solver(spark, n, width):
    rng = np.random.default_rng(n)
    rows = (rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) * 0.3).tolist()
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], SCHEMA).repartition(5)
    got = whitening.whiten(df).toPandas()
    count, deviation, centred, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(32, width, n - 1)
    assert len(got) == n * k and set(got["n"]) == {count} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-8
    assert got.groupby("vec_id")["deviation"].first().tolist() == deviation
    for c, part in got.sort_values("vec_id").groupby("component"):
        want = centred @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        w = part["whitened"].to_numpy()
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-7
        assert abs(part["explained"].iloc[0] * np.trace(cov) / values[c - 1] - 1) < 1e-10


def test_counts_and_repeated_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    values = np.array([9.0] * 4 + [5.0, 5.0 + 1e-9, 3.0] + [1.0] * 10 + [0.0] * 13)
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    for shift in (-1.0, 0.5, 1.5, 2.9, 4.0, 6.0, 10.0):
        assert whitening.count_above(matrix, shift) == (values > shift).sum()
    for _ in range(200):
        a = rng.normal(size=(9, 9)) * (rng.random((9, 9)) < 0.5)
        a = a + a.T
        assert whitening.count_above(a, 0.1) == (np.linalg.eigvalsh(a) > 0.1).sum()
    found, vectors = whitening.Slicer(matrix).leading(32)
    assert len(found) == 17 and np.allclose(found, np.sort(values)[::-1][:17], atol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(17)).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-10


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1, 0.5, -0.25], [0.3, -0.5, 0.75], [1.5, 0.5, 0.0], [0.1, 0.5, -0.25], [-2.0, 1.0, 0.5]]
    odd = [None, [], [0.1, None, 0.2], [nan, 0.0, 0.0], [0.0, inf, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(7 if i in (0, 3) else None if i == 4 else i, v, "x") for i, v in enumerate(good)] + [(100 + i, v, "y") for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("clash")).withColumn("x", F.lit(1))
    got = whitening.whiten(df).collect()
    assert len(got) == 15 and {r.n for r in got} == {5} and sum(r.vec_id is None for r in got) == 3
    assert len({(r.component, r.whitened) for r in got if r.vec_id == 7}) == 3  # repeated rows are equal
    _, deviation, _, _ = brute(good)
    assert sorted({r.deviation for r in got}) == sorted(set(deviation))
    for none in (df.limit(0), df.filter("vec_id >= 100").filter("size(embedding) = 2"), df.filter("vec_id = 7")):
        assert whitening.whiten(none).count() == 0


def test_exact_beyond_double_precision(spark):
    """Entries far apart: products no double holds are still summed exactly; a deviation beyond a long is null."""
    rng = np.random.default_rng(3)
    rows = [[float(v) for v in r] for r in (rng.integers(-(2**20), 2**20, size=(60, 3)) * 2.0**10)]
    vectors = whitening.prepared(spark.createDataFrame([(i, v, "") for i, v in enumerate(rows)], SCHEMA), "vec_id", "embedding")
    sums = whitening.add_up(vectors)
    n, deviation, centred, _ = brute(rows)
    cov = whitening.covariance(vectors, sums)
    x = [[int(v * 64) for v in r] for r in rows]
    exact = lambda i, j: (n * sum(r[i] * r[j] for r in x) - sum(r[i] for r in x) * sum(r[j] for r in x)) / (n * n)
    assert sums.n == n and all(cov[i, j] == exact(i, j) for i in range(3) for j in range(3))
    model = whitening.fit(vectors)
    assert sorted(int(r.deviation) for r in whitening.transform(vectors, model).collect()) == sorted(deviation)
    limit = 2**63
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame([(i, v, "") for i, v in enumerate(rows)], SCHEMA)).collect()}
    assert got == {i: (d if d < limit else None) for i, d in enumerate(deviation)}
