from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagemill.llm.neighbours import nearest_neighbours
from triagemill.llm.queries import QUERIES


def brute(ids, vectors, asked, k):
    d = np.sqrt(((vectors - vectors[ids.index(asked)]) ** 2).sum(axis=1))
    order = sorted((x, i) for x, i in zip(d.tolist(), ids) if i != asked)
    return order[:k]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r["vec_id"] for r in rows]
    vectors = np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in QUERIES["op6_nearest_neighbours"](spark, d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(got) == {i for i in ids if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11))
        assert [(x[1], x[2]) for x in found] == sorted((x[1], x[2]) for x in found)
        want = brute(ids, vectors, q, 10)
        hits += len({i for _, i in want} & {x[2] for x in found})
        at = {i: n for n, i in enumerate(ids)}
        for _, score, i in found:
            assert math.isclose(score, float(np.linalg.norm(vectors[at[i]] - vectors[at[q]])), rel_tol=1e-12)
    assert hits / (10 * len(got)) >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (100, None, 1), (200, [nan, 1.0], 1), (300, [0.0, 0.0], 1), (1, [1.0, 0.0], 2),
            (2, [1.0, None], 2), (3, [inf, 0.0], 2), (4, [0.0, 1.0], 2), (5, [0.0, 1.0], 2), (5, [0.0, 1.0], 2),
            (400, [1.0, 1.0, 1.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got) == [
        (0, 1, 1, 0.0), (0, 2, 4, 1.414214), (0, 3, 5, 1.414214)]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_many_copies(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(500 + i, [float(i), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_neighbours(df, F.col("vec_id") == 300).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10)) and all(r["score"] == 0 for r in got)
