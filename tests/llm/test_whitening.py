"""Whitening against a dense computation of the same contract, and odd vectors."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def check(rows, got, components=16):
    """Rows (id, vector) that count, against the operator's."""
    x = [tuple(math.floor(64.0 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in rows]
    fit = np.array(sorted(set(x)), dtype=object)
    n, sums = len(fit), fit.sum(0)
    apart = np.array([[Fraction(int(a) * n - int(s), n) for a, s in zip(r, sums)] for r in fit.tolist()], dtype=object).astype(float)
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values[0] * 1e-20 * len(values)).sum()), len(values))
    assert sorted((r.vec_id is not None, r.vec_id, r.component) for r in got) == sorted((i is not None, i, c) for i, _ in rows for c in range(1, k + 1))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    at = {i: v for (i, _), v in zip(rows, x)}
    sign = {}
    for r in got:
        v = at[r.vec_id]
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))
        c = r.component - 1
        assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
        want = float(np.array([Fraction(int(a) * n - int(s), n) for a, s in zip(v, sums)], dtype=object).astype(float) @ vectors[:, c]) / math.sqrt(values[c])
        if abs(want) > 1e-3:
            s = math.copysign(1, want * r.whitened)
            assert sign.setdefault(c, s) == s
        assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-7)


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.geomspace(3, 0.3, d)
    return [(i, [float(c) for c in np.float32(rng.normal(size=d) @ mix)]) for i in range(n)]


@pytest.mark.parametrize("n,d", [(300, 20), (40, 7), (30, 1)])
def test_against_a_dense_computation(spark, n, d):
    rows = vectors(n, d)
    rows += [(n + i, rows[i % n][1]) for i in range(n // 2)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(5)
    check(rows, W.whiten(df).collect())


def test_many_triangles_meet(spark, monkeypatch):
    monkeypatch.setattr(W, "GROUP", 3)
    monkeypatch.setattr(W, "BLOCK", 4)
    rows = vectors(200, 6)
    x = spark.createDataFrame([([math.floor(64 * c) + 1_000_000 for c in v],) for _, v in rows], "x array<long>").repartition(23)
    a = np.array([r.x for r in x.collect()])
    r = W.triangle(x, len(a), a.sum(0))
    apart = a - a.mean(0)
    assert r.shape == (6, 6) and np.allclose(r.T @ r, apart.T @ apart, rtol=1e-10)


def test_small_deviations_keep_their_digits():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    graded = (rng.normal(size=(9, 9)) / 3 + np.eye(9)) * np.geomspace(1, 1e-12, 9)
    size, v = W.jacobi(np.linalg.qr(graded, mode="r"))
    assert np.allclose(v.T @ v, np.eye(9), atol=1e-13)
    w = graded @ v
    off = (w.T @ w) / np.outer(size, size) - np.eye(9)
    assert np.abs(off).max() < 1e-10  # orthogonal relative to each column's own length
    assert np.allclose(W.jacobi(np.diag([3.0, 5.0, 4.0]) @ q[:3, :3])[0], np.linalg.svd(np.diag([3.0, 5.0, 4.0]) @ q[:3, :3])[1])
    assert W.jacobi(np.zeros((4, 4)))[0].tolist() == [0.0] * 4 and W.jacobi(np.zeros((0, 3)))[0].tolist() == [0.0] * 3


def test_odd_vectors(spark):
    rows = vectors(60, 5, 1)
    inf, nan = float("inf"), float("nan")
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [nan] * 5), (903, [inf, 0.0, 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, []), (906, [3e38] * 5), (907, [-inf] * 5)]
    kept = [*rows, (7, rows[8][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in [*kept, *odd]], SCHEMA).repartition(4)
    got = W.whiten(df).collect()
    assert len(got) == 62 * 5
    check(rows, [r for r in W.whiten(df.where("vec_id is not null and not (vec_id = 7 and embedding[0] = %r)" % rows[8][1][0])).collect()])
    twin = {(r.component, r.whitened) for r in got if r.vec_id is None}
    assert {c for c, _ in twin} == {1, 2, 3, 4, 5}
    clash = df.withColumns({c: F.lit("clash") for c in ("x", "component", "n", "whitened", "r", "k")})
    assert W.whiten(clash).count() == len(got)
    empty = spark.createDataFrame([], SCHEMA)
    assert W.whiten(empty).collect() == [] and W.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert W.whiten(df.where("vec_id >= 900")).count() in (0, 2)
    assert W.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(9)], SCHEMA)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)], SCHEMA)
    assert {r.component for r in W.whiten(flat).collect()} == {1}


def test_a_deviation_that_passes_a_long_is_null(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.uniform(-1e10, 1e10) for _ in range(3)], 0) for i in range(40)], SCHEMA)
    rows = W.whiten(df, components=2).collect()
    assert len(rows) == 80 and any(r.deviation is None for r in rows)
