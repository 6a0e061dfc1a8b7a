from __future__ import annotations

import math

import numpy as np
import pytest

from triagemill.llm.queries import QUERIES
from triagemill.llm.whitening import deviations, fit_list, leading_pairs, whiten

SF = "/root/testdata/sf0.01"


def brute(vectors):
    """x of each vector, n, S and eigenpairs of the covariance of the distinct ones, by NumPy."""
    x = [tuple(math.floor(256 * float(c)) for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), object)
    sums = fit.sum(axis=0)
    centred = (fit - sums / len(fit)).astype(float)
    cov = centred.T @ centred / len(fit)
    values, pairs = np.linalg.eigh(cov)
    return x, len(fit), sums, values[::-1], pairs[:, ::-1], float(np.trace(cov))


def check(rows, vectors, ids):
    x, n, sums, values, pairs, trace = brute(vectors)
    k = int((values[:4] > 1e-12 * trace).sum())
    assert len(rows) == len(ids) * k
    by_row = {}
    for r in rows:
        by_row.setdefault(r["vec_id"], []).append(r)
    for i, own in zip(ids, x):
        want = sum((n * c - int(s)) ** 2 for c, s in zip(own, sums))
        assert all(r["deviation"] == want and r["n"] == n for r in by_row[i])
    for c in range(k):
        got = np.array([next(r for r in by_row[i] if r["component"] == c + 1)["whitened"] for i in ids])
        want = (np.array(x, float) - np.array(sums / n, float)) @ pairs[:, c] / math.sqrt(values[c])
        sign = np.sign(got @ want)
        assert np.abs(got - sign * want).max() < 1e-8
    assert all(abs(r["explained"] - values[r["component"] - 1] / trace) < 1e-9 for r in rows)
    assert max(r["identity_error"] for r in rows) < 1e-10


def test_whole_table(spark):
    rows = QUERIES["op11_whitening"](spark, SF).collect()
    source = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(rows, [r["embedding"] for r in source], [r["vec_id"] for r in source])


@pytest.mark.parametrize("shape", ["near", "spread", "flat"])
def test_pairs_of_a_matrix(shape):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((90, 90)))
    values = {
        "near": np.r_[10, 9.999, 9.99, 9.9, 9.8, np.linspace(9.7, 1, 85)],
        "spread": 2.0 ** -np.arange(90),
        "flat": np.r_[3.0, 2.0, 1.0, 1e-3, np.zeros(86)],
    }[shape]
    a = (q * values) @ q.T
    calls = []
    found, vectors = leading_pairs(lambda v: calls.append(1) or a @ v, 90, 4, values.sum())
    assert np.abs(found - values[:4]).max() < 1e-13 * values[0]
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() < 1e-13 * values[0]
    assert np.abs(np.abs((q[:, :4] * vectors).sum(axis=0)) - 1).max() < 1e-12
    assert len(calls) < 400


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [[float(c) for c in v] for v in rng.normal(size=(300, 6)) * [5, 4, 3, 2, 1, 0.5]]
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(1000 + i, good[7]) for i in range(150)]  # one vector in a third of all rows
    rows += [(1500, [-0.0] * 6), (1501, [0.0] * 6), (1502, [-1e-300] * 6)]
    kept = list(rows)
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [nan] * 6)]
    rows += [(2004, [inf] + [0.0] * 5), (2005, [-inf] + [0.0] * 5), (2006, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<double>, x long, n string")
    check(whiten(df).collect(), [v for _, v in kept], [i for i, _ in kept])
    assert whiten(df.limit(0)).count() == 0
    assert whiten(df.filter("vec_id >= 2000 and vec_id < 2006")).count() == 0
    assert whiten(df.filter("vec_id >= 1000 and vec_id < 1150")).count() == 0
    two = df.filter("vec_id < 3")
    check(whiten(two).collect(), good[:3], [0, 1, 2])


def test_exact_sums(spark):
    x = np.array([[2**40, -(2**40)], [3, 5]])
    sums = np.array([2**40 + 3, 5 - 2**40], object)
    want = [sum((2 * int(c) - int(s)) ** 2 for c, s in zip(r, sums)) for r in x]
    assert deviations(x, 2, sums).to_pylist() == [w if w < 2**63 else None for w in want]
    fit = fit_list(spark.createDataFrame([(r.tolist(),) for r in x] * 2, "x array<long>"))
    assert (fit.n, fit.sums.tolist(), fit.squares) == (2, sums.tolist(), 2 * 2**80 + 34)
