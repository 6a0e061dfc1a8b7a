"""Approximate nearest neighbours: random-projection trees, one queue for all trees, exact ranks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagemill.session import materialize

SAMPLE_ROWS = 16_384
TREES = 12
LEAF_ROWS = 128
SEARCH_ROWS = 12_000
GROUP_ROWS = 16_384
SEED = 11


@dataclass(frozen=True)
class Forest:
    """Inner nodes of all trees in one numbering; a child below zero is leaf -child - 1."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaf_rows: np.ndarray  # rows of the sample in each leaf


def build_forest(
    sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = SEED
) -> Forest:
    """Split at the plane halfway between two random rows until ``leaf_rows`` or fewer are left."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, roots, sizes = [], [], [], [], []

    def leaf(rows: np.ndarray) -> int:
        sizes.append(len(rows))
        return -len(sizes)

    for _ in range(trees):
        roots.append(None)
        todo = [(np.arange(len(sample)), len(roots) - 1, None)]  # rows, owner, side
        while todo:
            rows, owner, side = todo.pop()
            node = None
            if len(rows) > leaf_rows:
                for _ in range(8):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    normal = a - b
                    offset = float(normal @ (a + b)) / 2
                    right = sample[rows] @ normal > offset
                    if right.any() and not right.all():
                        node = len(normals)
                        normals.append(normal)
                        offsets.append(offset)
                        children.append([0, 0])
                        todo.append((rows[~right], node, 0))
                        todo.append((rows[right], node, 1))
                        break
            value = leaf(rows) if node is None else node
            if side is None:
                roots[owner] = value
            else:
                children[owner][side] = value
    dim = sample.shape[1]
    return Forest(
        np.array(normals, float).reshape(-1, dim),
        np.array(offsets, float),
        np.array(children, np.int64).reshape(-1, 2),
        np.array(roots, np.int64),
        np.array(sizes, np.int64),
    )


def leaves_of(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """Leaf of each vector in each tree (rows x trees)."""
    out = np.empty((len(vectors), len(forest.roots)), np.int32)
    for t, root in enumerate(forest.roots):
        at = np.full(len(vectors), root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            margin = np.einsum("ij,ij->i", vectors[inner], forest.normals[node]) - forest.offsets[node]
            at[inner] = forest.children[node, (margin > 0).astype(np.int64)]
        out[:, t] = -at - 1
    return out


def probe(forest: Forest, query: np.ndarray, search_rows: int) -> list[int]:
    """Leaves of all trees, nearest planes first, until they hold ``search_rows`` sampled rows.

    The shared queue holds branches not taken; a branch's priority is the smallest margin on its
    way, negative once a plane had to be crossed.
    """
    norms = np.linalg.norm(forest.normals, axis=1)
    margins = (forest.normals @ query - forest.offsets) / np.where(norms > 0, norms, 1)
    queue = [(-np.inf, t, int(root)) for t, root in enumerate(forest.roots)]
    heapq.heapify(queue)
    found, rows, number = [], 0, len(queue)
    while queue and rows < search_rows:
        cost, _, at = heapq.heappop(queue)
        while at >= 0:
            near = int(margins[at] > 0)
            number += 1
            away = max(cost, abs(float(margins[at])))
            heapq.heappush(queue, (away, number, int(forest.children[at, 1 - near])))
            at = int(forest.children[at, near])
        found.append(-at - 1)
        rows += int(forest.leaf_rows[-at - 1])
    return found


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    search_rows: int = SEARCH_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query row.

    Planes come from a sample of at most ``sample_rows`` different vectors (those with the
    smallest hash of their key); every row is indexed. Equal vectors are one point of the index
    with its ``k + 1`` smallest keys, all that a list of ``k`` can name, so many copies cost
    nothing. A leaf's rows meet the queries that visit it in one group, cut into salted parts as
    the table outgrows the sample; each part ranks its rows by exact Euclidean distance in double
    precision, ties by key, and passes on ``k + 1`` for each query, so no pair is a row. A query's
    own key is never named. ``search_rows`` suits vectors without any structure, where near ones
    are hardly nearer than others; clustered ones need far less.
    Vectors that are not ``usable``, have another length than most, or a null key take no part;
    of rows that repeat a key and vector one counts; other columns are ignored; an empty table
    gives an empty result. Where there are fewer than ``k`` other rows, all are returned.
    """
    rows = vectors.select(
        F.col(key).alias("_id"),
        F.col(vector).cast("array<double>").alias("_v"),
        is_query.alias("_query"),
    ).filter(F.col("_id").isNotNull() & usable(F.col("_v")))
    # adding zero makes the two zeros one
    rows = rows.withColumn("_v", F.transform("_v", lambda x: x + F.lit(0.0))).distinct()
    rows = materialize(rows, "ann-rows")
    kind = rows.schema["_id"].dataType.simpleString()
    dim = (
        rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    )
    rows = rows.filter(F.size("_v") == (dim["d"] if dim else 0))
    same = Window.partitionBy("_v").orderBy("_id")
    points = (
        rows.select("_id", "_v")
        .withColumn("_nth", F.row_number().over(same))
        .filter(F.col("_nth") <= k + 1)
        .groupBy("_v")
        .agg(F.min("_id").alias("_point"), F.array_sort(F.collect_list("_id")).alias("_ids"))
    )
    points = materialize(points, "ann-points")
    sample = (
        points.orderBy(F.xxhash64("_point"), "_point").limit(sample_rows).select("_v").toPandas()
    )
    if sample.empty:
        return rows.select(
            F.col("_id").alias("query_id"),
            F.lit(1).alias("rank"),
            F.col("_id").alias("vec_id"),
            F.lit(0.0).alias("score"),
        ).limit(0)
    forest = build_forest(np.stack(sample["_v"].to_list()).astype(float), trees, leaf_rows)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = leaves_of(forest, _matrix(batch.column(1)))
                each = pa.array(np.repeat(np.arange(len(leaves)), leaves.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(each) for c in batch.columns), pa.array(leaves.reshape(-1))],
                    names=["_point", "_v", "_ids", "_leaf"],
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [probe(forest, q, search_rows) for q in _matrix(batch.column(1))]
                each = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.take(each) for c in batch.columns),
                        pa.array(np.concatenate(found).astype(np.int32)),
                    ],
                    names=["_asked", "_q", "_leaf"],
                )

    queries = rows.filter("_query").select(F.col("_id").alias("_asked"), F.col("_v").alias("_q"))
    # a leaf grows with the table beyond the sample; salts keep a group near GROUP_ROWS rows
    expected = max(leaf_rows, points.count() * leaf_rows // len(sample))
    salts = max(1, -(-expected // GROUP_ROWS))
    indexed = points.select("_point", "_v", "_ids").mapInArrow(
        index, f"_point {kind}, _v array<double>, _ids array<{kind}>, _leaf int"
    )
    visits = queries.mapInArrow(search, f"_asked {kind}, _q array<double>, _leaf int")
    indexed = indexed.withColumn("_salt", F.pmod(F.xxhash64("_point"), F.lit(salts)).cast("int"))
    visits = visits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def rank_leaf(own: pa.Table, asked: pa.Table) -> pa.Table:
        own, asked = own.combine_chunks(), asked.combine_chunks()
        picked, scores, counts = [], [], []
        if own.num_rows and asked.num_rows:
            matrix, names = _matrix(own["_v"].chunk(0)), own["_point"].to_numpy()
            for q in _matrix(asked["_q"].chunk(0)):
                score = np.sqrt(((matrix - q) ** 2).sum(axis=1))
                order = np.lexsort((names, score))[: k + 1]
                picked.append(order)
                scores.append(score[order])
                counts.append(len(order))
        each = pa.array(np.repeat(np.arange(len(counts)), counts).astype(np.int64))
        rows_of = pa.array(np.concatenate(picked).astype(np.int64) if picked else [], pa.int64())
        return pa.table(
            {
                "_asked": asked["_asked"].take(each),
                "_point": own["_point"].take(rows_of),
                "_ids": own["_ids"].take(rows_of),
                "score": pa.array(np.concatenate(scores) if scores else [], pa.float64()),
            }
        )

    near = (
        indexed.groupBy("_leaf", "_salt")
        .cogroup(visits.groupBy("_leaf", "_salt"))
        .applyInArrow(
            rank_leaf, f"_asked {kind}, _point {kind}, _ids array<{kind}>, score double"
        )
    )
    # a point of several trees' leaves is found in each
    once = near.groupBy("_asked", "_point").agg(
        F.first("_ids").alias("_ids"), F.first("score").alias("score")
    )
    named = once.withColumn("vec_id", F.explode("_ids")).filter(
        F.col("vec_id") != F.col("_asked")
    )
    order = Window.partitionBy("_asked").orderBy("score", "vec_id")
    return (
        named.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("_asked").alias("query_id"), "rank", "vec_id", "score")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[
        column.offsets[0].as_py() : column.offsets[-1].as_py()
    ].reshape(len(column), -1)
