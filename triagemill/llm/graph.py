"""Connected components of links whose nodes may be very popular, and star reduction inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagemill.operators.skew import HOT_SHARE
from triagemill.session import materialize

HOT_ROWS = 10_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the links a-b but the smallest."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(at, 2)
    low = np.arange(len(names))
    while True:
        least = np.minimum(low[a], low[b])
        now = low.copy()
        np.minimum.at(now, low[a], least)
        np.minimum.at(now, low[b], least)
        now = now[now]
        if (now == low).all():
            break
        low = now
    moved = low != np.arange(len(names))
    return names[moved], names[low[moved]]


class Stars:
    """Links of a task, reduced to stars whenever many have come together."""

    def __init__(self, most: int = 1 << 18) -> None:
        self._a: list[np.ndarray] = []
        self._b: list[np.ndarray] = []
        self._size, self._most = 0, most

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self._a.append(a)
            self._b.append(b)
            self._size += len(a)
            if self._size > self._most:
                self._reduce()

    def _reduce(self) -> None:
        a, b = stars(np.concatenate(self._a), np.concatenate(self._b))
        self._a, self._b, self._size = [a], [b], len(a)
        self._most = max(self._most, 2 * len(a))

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        self._reduce()
        return self._a[0], self._b[0]


def join_facts(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, one row for each value of ``key``, hot keys apart.

    ``facts`` should be written data; ``weight`` says how many rows carry the key. Keys with more
    than one in ``HOT_SHARE`` of all rows (fewer than that many keys), if that is many rows at all,
    meet their rows by broadcast, the others by Spark's own choice of join.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = facts.filter(F.col(weight) > max(HOT_ROWS, total // HOT_SHARE))
    if hot.isEmpty():
        return rows.join(facts, key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(facts, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of the edges (a, b), longs.

    Each round takes the smallest label among the neighbours and then that label's label, and is
    written to the shared folder; it ends when no label changes. A node may be the centre of a
    third of all edges, and a root that of a third of all nodes: their labels go to the rows by
    broadcast, those of all others by a shuffle.
    """
    both = edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    both = materialize(both.filter("a <> b").distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("degree"))
    labels = materialize(
        labels.select(F.col("a").alias("node"), F.least("a", "b").alias("root"), "degree"), "labels"
    )
    while True:
        facts = labels.select(F.col("node").alias("b"), "root", "degree")
        near = join_facts(both, facts, "b", "degree")
        near = near.groupBy("a").agg(F.min("root").alias("_near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", "degree", F.col("root").alias("_was"), F.least("root", "_near").alias("_low")
        )
        lower = materialize(lower, "labels")
        users = lower.groupBy("_low").agg(F.count("*").alias("_users"))
        above = lower.select(F.col("node").alias("_node"), F.col("_low").alias("root"))
        above = above.join(users, F.col("_node") == F.col("_low")).select("_low", "root", "_users")
        moved = join_facts(lower, materialize(above, "roots"), "_low", "_users")
        moved = materialize(moved.select("node", "root", "degree", "_was"), "labels")
        labels = moved.select("node", "root", "degree")
        if moved.filter("_was <> root").isEmpty():
            return labels.select("node", "root")
