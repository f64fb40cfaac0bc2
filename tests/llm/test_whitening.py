"""Whitening: eigenvectors against numpy, exact sums, dropped rows, degenerate tables."""

import math

import numpy as np
import pytest

from dialsieve.llm import whitening as W
from dialsieve.llm.common import prepare

KIND = "vec_id long, embedding array<float>, n int, component int, whitened string"


def run(spark, rows, kind=KIND):
    prepare(spark)
    width = len(kind.split(", ")) - 2
    df = spark.createDataFrame([(i, v, *[None] * width) for i, v in rows], kind)
    model = W.fit(df)
    return model, [r.asDict() for r in W.components_of(W.whiten(df, model), model).collect()]


def grid(rows, dims):
    return np.array([[math.floor(256 * c) for c in v] + [0] * (dims - len(v)) for _, v in rows], dtype=object)


def check(model, got, rows, dims):
    x = grid(rows, dims)
    fit = np.unique(x.astype(np.int64), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    d = fit - s / n
    cov = d.T @ d / n
    values, vectors = np.linalg.eigh(cov)
    k = min(4, dims)
    assert model.n == n and model.sums == s.tolist()
    assert np.allclose(model.values, values[::-1][:k], rtol=1e-9, atol=1e-9 * max(values))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert len(got) == k * len(rows)
    for (i, _), row in zip(rows, x):
        own = sorted(by[i], key=lambda r: r["component"])
        assert {r["component"] for r in own} == set(range(1, k + 1)) and all(r["n"] == n for r in own)
        assert all(r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for r in own)
        for r in own:
            c = r["component"] - 1
            if r["whitened"] is not None and values[::-1][c] > 1e-6:
                want = (row.astype(float) - s / n) @ model.vectors[:, c] / math.sqrt(values[::-1][c])
                assert r["whitened"] == pytest.approx(want, rel=1e-8, abs=1e-8)
                assert r["explained"] == pytest.approx(values[::-1][c] / np.trace(cov), rel=1e-6)
    return cov


def test_matches_numpy_and_counts_copies_once(spark):
    rng = np.random.default_rng(1)
    scale = np.array([9, 5, 3, 2, 1, .5, .2, .1])
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8) * scale]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]
    model, got = run(spark, rows)
    cov = check(model, got, rows, 8)
    for c in range(4):
        v = model.vectors[:, c]
        assert np.allclose(cov @ v, model.values[c] * v, atol=1e-10 * np.trace(cov)) and np.linalg.norm(v) == pytest.approx(1, abs=1e-14)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_rows_that_are_dropped(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (None, [3.0, 5.0]),
            (6, [-0.0, 0.25]), (6, [-0.0, 0.25])]
    model, got = run(spark, rows)
    assert sorted({r["vec_id"] or 0 for r in got}) == [0, 1, 6] and len(got) == 2 * 4 and model.n == 3


def test_short_and_empty_vectors_are_filled_up(spark):
    rows = [(1, []), (2, [1.0]), (3, [1.0, 0.0, 0.0]), (4, [0.5, 2.0, 7.0]), (5, [3.0, 1.0])]
    model, got = run(spark, rows)
    assert model.n == 4 and model.dims == 3                    # 2 and 3 are one vector
    check(model, got, rows, 3)


def test_no_variance_no_rows_no_dims(spark):
    model, got = run(spark, [(1, [1.0, 2.0])] * 3)
    assert model.n == 1 and [r["whitened"] for r in got] == [None] * 6 and {r["explained"] for r in got} == {None}
    assert {r["deviation"] for r in got} == {0} and {r["identity_error"] for r in got} == {None}
    assert run(spark, [(1, None)]) == (None, [])
    assert run(spark, []) == (None, [])
    assert run(spark, [(1, [])])[1] == []


def test_huge_entries(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [1e5, 3.0])]
    model, got = run(spark, rows)
    assert model.sums[0] == (1 << 63) - 1 - (1 << 63) + math.floor(256 * float(np.float32(1e5)))
    assert {r["vec_id"]: r["deviation"] for r in got}[1] is None


def test_double_vectors_and_other_id_types(spark):
    model, got = run(spark, [("a", [0.1, 0.9, 4.0]), ("b", [0.4, 0.2, 1.0]), ("c", [2.0, 2.5, 3.0])],
                     "vec_id string, embedding array<double>, n int")
    assert {r["vec_id"] for r in got} == {"a", "b", "c"} and model.n == 3


@pytest.mark.parametrize("name", ["close", "equal", "diagonal", "rank one", "two", "one", "graded"])
def test_eigenvectors(name):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    m = {"close": (q * np.concatenate([[5, 5 - 1e-12, 5 - 2e-12, 4.999999], np.linspace(1, 0, 36)])) @ q.T,
         "equal": (q * np.concatenate([[3.0] * 6, [1.0] * 34])) @ q.T, "diagonal": np.diag(np.arange(9.0)),
         "rank one": np.outer(q[0], q[0]), "two": np.array([[2.0, 1.0], [1.0, 2.0]]), "one": np.array([[7.0]]),
         "graded": (q * 10.0 ** -np.arange(40)) @ q.T}[name]
    m = (m + m.T) / 2
    values, vectors = W.leading_eigen(m, 4)
    want = np.linalg.eigvalsh(m)[::-1][:len(values)]
    size = np.abs(m).max()
    assert np.allclose(values, want, atol=1e-13 * size * len(m))
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert np.allclose(m @ vectors, vectors * values, atol=1e-11 * size * len(m))


def test_too_many_dimensions_raise(spark, monkeypatch):
    monkeypatch.setattr(W, "MAX_DIMS", 2)
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0, 2.0, 3.0])])


def test_sums_and_matrix_do_not_depend_on_the_partitions(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=6)]) for i in range(200)], "vec_id long, embedding array<float>")
    a, b = W.fit(df.repartition(7)), W.fit(df.coalesce(1))
    assert a.sums == b.sums and a.n == b.n and np.allclose(a.values, b.values, rtol=1e-13)
