"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.session import materialize

ORDERS = (3, 4, 5)
BUCKET_BITS = 20
MAX_ROWS_PER_CLASS = 6_000
MAX_FEATURES = 8_192
SMOOTHING = 1.0
REG_PARAM = 1e-3
THRESHOLD = 0.3
_HELD_OUT = 2


@dataclass(frozen=True)
class ToxicityModel:
    """Weights (log-count ratio times coefficient) of the chosen n-gram buckets."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BUCKET_BITS


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == _HELD_OUT, F.lit(False))


def ngram_buckets(texts: list[str], orders=ORDERS, bits=BUCKET_BITS) -> Iterator[tuple]:
    """(buckets, order, text sizes, text ends) per order; bucket i is that of the n-gram at i.

    Texts are lower-cased and padded with spaces; n-grams are runs of code points. Those that
    cross the end of a text are to be left out by the caller.
    """
    padded = [f"  {t.lower()}  " for t in texts]
    data = "".join(padded).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(data, "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        rolled = codes.copy()
        for n in range(2, max(orders) + 1):
            # rolled[i] holds the n-gram that starts at i
            rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            if n in orders:
                mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield (mixed >> np.uint64(64 - bits)).astype(np.int32), n, sizes, ends


def _present(texts: list[str], chosen: np.ndarray, orders, bits) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and positions in the table ``chosen`` (bucket -> position or -1) present."""
    found = []
    for bucket, n, _, ends in ngram_buckets(texts, orders, bits):
        position = chosen[bucket]
        hit = np.flatnonzero(position >= 0)
        row = np.searchsorted(ends, hit, "right")
        inside = hit + n <= ends[row]
        found.append((row[inside] << 32) | position[hit[inside]].astype(np.int64))
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


def _slices(texts: list[str | None], most: int = 1 << 17) -> Iterator[list[str]]:
    """Consecutive texts (null: empty) of about ``most`` characters."""
    own, size = [], 0
    for t in texts:
        own.append(t or "")
        size += len(own[-1])
        if size >= most or len(own) >= 4096:
            yield own
            own, size = [], 0
    if own:
        yield own


def training_rows(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int
) -> DataFrame:
    """(y, text): labelled rows outside the held-out quarter, ``most`` of each class.

    Where a class has more, those with the smallest hash of their key are taken. A key labelled
    more than once counts as toxic if any label says so.
    """
    known = (
        labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"))
        .filter(F.col("_key").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("_key")))
        .groupBy("_key")
        .agg(F.max("y").alias("y"))
    )
    own = docs.select(F.col(key).alias("_doc"), F.col(text).cast("string").alias("text"))
    sides = [
        known.filter(F.col("y") == y).orderBy(F.xxhash64("_key"), "_key").limit(most)
        for y in (0, 1)
    ]
    # the smaller side has at most 2 * most rows of a key and a label
    picked = F.broadcast(sides[0].unionByName(sides[1]))
    return own.join(picked, F.col("_doc") == F.col("_key")).select("y", "text")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most: int = MAX_ROWS_PER_CLASS,
    features: int = MAX_FEATURES,
) -> ToxicityModel:
    """Fit on at most ``most`` labelled rows of each class (the documented sample bound).

    Document frequencies of hashed n-grams in either class give log-count ratios; the
    ``features`` buckets with the largest ratio, weighed by the root of their frequency, become
    features that hold their ratio where present. Logistic regression is fitted on them by Spark,
    and its intercept is moved from the sample's class shares to those of all labels learnt
    from. With no row of one class, every score is the smoothed share of the other.
    """
    rows = materialize(training_rows(docs, labels, key, text, label, most), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    shares = _class_counts(labels, key, label)
    prior = float(np.log((shares[1] + SMOOTHING) / (shares[0] + SMOOTHING)))
    if not sizes.get(0) or not sizes.get(1):
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), prior)
    counts = rows.mapInArrow(_frequencies, "bucket int, negative long, positive long")
    counts = counts.groupBy("bucket").agg(
        F.sum("negative").alias("negative"), F.sum("positive").alias("positive")
    )
    ratio = F.log(
        (F.col("positive") + SMOOTHING) / (sizes[1] + 2 * SMOOTHING)
    ) - F.log((F.col("negative") + SMOOTHING) / (sizes[0] + 2 * SMOOTHING))
    ranked = (
        counts.withColumn("ratio", ratio)
        .withColumn("_strength", F.abs("ratio") * F.sqrt(F.col("positive") + F.col("negative")))
        .orderBy(F.desc("_strength"), "bucket")
        .limit(features)
        .select("bucket", "ratio")
        .toPandas()
    )
    buckets, ratios = ranked["bucket"].to_numpy(np.int64), ranked["ratio"].to_numpy(float)
    coefficients, intercept = _regression(rows, buckets, ratios)
    intercept += prior - float(np.log(sizes[1] / sizes[0]))
    return ToxicityModel(buckets, coefficients * ratios, intercept)


def _class_counts(labels: DataFrame, key: str, label: str) -> dict[int, int]:
    known = labels.filter(~held_out(F.col(key)) & F.col(key).isNotNull())
    row = known.select(
        *[F.count(F.when(F.col(label).cast("int") == y, 1)).alias(f"n{y}") for y in (0, 1)]
    ).first()
    return {0: row["n0"], 1: row["n1"]}


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class that hold an n-gram of each bucket, over the rows of a task."""
    total = np.zeros((2, 1 << BUCKET_BITS), np.int32)  # at most the rows of a task
    every = np.arange(1 << BUCKET_BITS, dtype=np.int32)
    for batch in batches:
        at = 0
        y = batch.column(0).to_numpy()
        for texts in _slices(batch.column(1).to_pylist()):
            own = y[at : at + len(texts)]
            at += len(texts)
            row, bucket = _present(texts, every, ORDERS, BUCKET_BITS)
            for side in (0, 1):
                total[side] += np.bincount(
                    bucket[own[row] == side], minlength=total.shape[1]
                ).astype(np.int32)
    seen = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen.astype(np.int32)), *[pa.array(t[seen].astype(np.int64)) for t in total]],
        names=["bucket", "negative", "positive"],
    )


def _regression(rows: DataFrame, buckets: np.ndarray, ratios: np.ndarray):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT

    table = np.full(1 << BUCKET_BITS, -1, np.int64)
    table[buckets] = np.arange(len(buckets))

    @F.udf(VectorUDT())
    def vector(text: str | None):
        _, position = _present([text or ""], table, ORDERS, BUCKET_BITS)
        return SparseVector(len(ratios), position, ratios[position])

    # bounded by the sample and its features
    data = materialize(
        rows.repartition(24).select(F.col("y").cast("double").alias("label"), vector("text").alias("features")),
        "toxic-features",
    )
    model = LogisticRegression(regParam=REG_PARAM, maxIter=100, standardization=False).fit(data)
    return model.coefficients.toArray(), float(model.intercept)


def _score(texts: list[str | None], model: ToxicityModel, table: np.ndarray) -> np.ndarray:
    out = []
    for own in _slices(texts):
        row, position = _present(own, table, model.orders, model.bits)
        logit = np.bincount(row, model.weights[position], len(own)) + model.intercept
        out.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
    return np.concatenate(out) if out else np.empty(0)


def _table(model: ToxicityModel) -> np.ndarray:
    table = np.full(1 << model.bits, -1, np.int32)
    table[model.buckets] = np.arange(len(model.buckets))
    return table


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, without a shuffle.

    A score depends on the text alone. Null and empty texts get the score of a text that holds
    none of the features' n-grams; null keys are not held out; repeated rows are scored each;
    other columns are ignored; an empty table gives an empty result.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in batches:
            scores = _score(batch.column(2).to_pylist(), model, table)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def drop_toxic(
    docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, all columns kept."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in batches:
            scores = _score(batch.column(at).to_pylist(), model, table)
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(keep, docs.schema)
