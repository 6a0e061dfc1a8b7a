"""Classifiers, their fold evaluation and what is read off them.

Naive Bayes and the majority class are plain aggregations with the fold as a key. The
iterative models are Spark ML fits on feature tables written once; independent fits run from
a small driver thread pool.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagemill.constants import HIERARCHIES, LABELS
from triagemill.functions.labels import invert, lookup
from triagemill.operators.linear import Candidate

MAX_ITER = 2000
FIT_THREADS = 8
ROWS_PER_TASK = 5_000


def in_parallel(tasks: list, threads: int = FIT_THREADS) -> list:
    """Run independent driver-side fits with bounded parallelism, results in order."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(lambda task: task(), tasks))


def fixed_order_argmax(scores: list[Column], labels: list[str]) -> Column:
    """Label of the first maximum in ``labels`` order."""
    best = F.greatest(*scores)
    chosen = F.lit(labels[-1])
    for score, label in reversed(list(zip(scores[:-1], labels[:-1]))):
        chosen = F.when(score == best, F.lit(label)).otherwise(chosen)
    return chosen


# ---- closed-form models ------------------------------------------------------------------


def majority_class(train: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Most frequent training label (per key), ties to the smaller label."""
    counts = train.groupBy(*(by or []), label).agg(F.count("*").alias("_n"))
    return counts.groupBy(*(by or [])).agg(
        F.min_by(F.col(label), F.struct(-F.col("_n"), F.col(label))).alias("predicted_label")
    )


def naive_bayes_tables(
    weighted: DataFrame, members: DataFrame, labels: list[str], alpha: float, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(likelihoods per term, priors) of multinomial naive Bayes per ``keys``.

    Likelihoods are wide: one row per term with one column per label, so the scoring side
    stays within folds x vocabulary rows.
    """
    train = weighted.filter(F.col("role") == "train")
    sums = train.groupBy(*keys, "branch", "term").agg(
        *[
            F.sum(F.when(F.col("label") == x, F.col("w")).otherwise(0.0)).alias(f"_s{i}")
            for i, x in enumerate(labels)
        ]
    )
    likelihood = _likelihoods(sums, keys, ["branch", "term"], labels, alpha)
    return likelihood, _priors(members, labels, keys)


def _likelihoods(
    sums: DataFrame, keys: list[str], term: list[str], labels: list[str], alpha: float
) -> DataFrame:
    """Smoothed log likelihoods ll_i of ``sums(*keys, *term, _s0, ...)``."""
    totals = sums.groupBy(*keys).agg(
        F.count("*").alias("_v"),
        *[F.sum(f"_s{i}").alias(f"_t{i}") for i in range(len(labels))],
    )
    return sums.join(F.broadcast(totals), keys).select(
        *keys,
        *term,
        *[
            F.log(
                (F.col(f"_s{i}") + alpha) / (F.col(f"_t{i}") + F.lit(alpha) * F.col("_v"))
            ).alias(f"ll_{i}")
            for i in range(len(labels))
        ],
    )


def _priors(members: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    counted = (
        members.filter(F.col("role") == "train")
        .groupBy(*keys)
        .agg(
            F.count("*").alias("_n"),
            *[F.count_if(F.col("label") == x).alias(f"_c{i}") for i, x in enumerate(labels)],
        )
    )
    # a label without training rows can never win
    return counted.select(
        *keys,
        *[
            F.when(F.col(f"_c{i}") == 0, F.lit(float("-inf")))
            .otherwise(F.log(F.col(f"_c{i}") / F.col("_n")))
            .alias(f"prior_{i}")
            for i in range(len(labels))
        ],
    )


def vector_bayes_tables(
    vectors: DataFrame, size: int, labels: list[str], alpha: float
) -> tuple[DataFrame, DataFrame]:
    """(likelihoods by fold and idx, priors) as :func:`naive_bayes_tables`, from rows of vectors.

    ``vectors(fold, role, label, features)`` with plain structs of ``size`` features. A task adds
    its rows up in an array of labels x features for each fold, and only these sums move.
    """
    train = vectors.filter(F.col("role") == "train")
    rows = train.select(
        F.col("fold").cast("int").alias("fold"), "label", "features.indices", "features.values"
    )
    names = ["fold", "idx", *[f"_s{i}" for i in range(len(labels))]]
    place = {x: i for i, x in enumerate(labels)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.column("indices").value_lengths().to_numpy()
            at = pc.list_flatten(batch.column("indices")).to_numpy()
            value = pc.list_flatten(batch.column("values")).to_numpy()
            own = np.array([place.get(x, -1) for x in batch.column("label").to_pylist()], np.int64)
            fold, own = np.repeat(batch.column("fold").to_numpy(), n), np.repeat(own, n)
            for f in np.unique(fold).tolist():
                total = found.setdefault(f, np.zeros(size * len(labels)))
                mine = fold == f
                seen.setdefault(f, np.zeros(size, bool))[at[mine]] = True
                mine &= own >= 0
                total += np.bincount(own[mine] * size + at[mine], value[mine], len(total))
        for f, total in found.items():
            used = np.flatnonzero(seen[f])
            columns = [pa.array(x[used]) for x in total.reshape(-1, size)]
            columns = [pa.array(np.full(len(used), f, np.int32)), pa.array(used.astype(np.int32)), *columns]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(["fold int", "idx int", *[f"{c} double" for c in names[2:]]])
    sums = rows.mapInArrow(add, schema).groupBy("fold", "idx")
    sums = sums.agg(*[F.sum(c).alias(c) for c in names[2:]])
    return _likelihoods(sums, ["fold"], ["idx"], labels, alpha), _priors(vectors, labels, ["fold"])


def vector_bayes_predict(
    vectors: DataFrame, size: int, likelihood: DataFrame, priors: DataFrame, labels: list[str], key: str
) -> DataFrame:
    """Predictions of the validation rows; a row without known terms falls to the prior."""
    columns = [f"ll_{i}" for i in range(len(labels))]
    tables: dict[int, np.ndarray] = {}
    # bounded by folds x max_features x labels
    table = likelihood.select("fold", "idx", *columns).toArrow()
    folds, index = table["fold"].to_numpy(), table["idx"].to_numpy()
    values = np.column_stack([table[c].to_numpy() for c in columns])
    for f in np.unique(folds).tolist():
        tables[f] = np.zeros((size, len(labels)))
        tables[f][index[folds == f]] = values[folds == f]
    sent = vectors.sparkSession.sparkContext.broadcast(tables)
    held = vectors.filter(F.col("role") == "validation")
    rows = held.select(
        key, F.col("fold").cast("int").alias("fold"), "label", "features.indices", "features.values"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("indices").value_lengths().to_numpy().cumsum()
            at = pc.list_flatten(batch.column("indices")).to_numpy()
            value = pc.list_flatten(batch.column("values")).to_numpy()
            out = np.zeros((batch.num_rows, len(labels)))
            for row, fold in enumerate(batch.column("fold").to_pylist()):
                low, high = ends[row - 1] if row else 0, ends[row]
                if fold in sent.value:
                    out[row] = value[low:high] @ sent.value[fold][at[low:high]]
            scores = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * len(labels), pa.int32()), pa.array(out.reshape(-1))
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (key, "fold", "label")], scores],
                names=[key, "fold", "label", "scores"],
            )

    fields = [rows.schema[c] for c in (key, "fold", "label")]
    scored = rows.mapInArrow(
        score, T.StructType([*fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])
    ).join(F.broadcast(priors), "fold")
    # rounding keeps the winner independent of summation order
    total = [F.round(F.col(f"prior_{i}") + F.col("scores")[i], 9) for i in range(len(labels))]
    return scored.select(
        key, "fold", F.col("label").alias("true_label"),
        fixed_order_argmax(total, labels).alias("predicted_label"),
    )


def naive_bayes_predict(
    weighted: DataFrame,
    members: DataFrame,
    likelihood: DataFrame,
    priors: DataFrame,
    labels: list[str],
    key: str,
    keys: list[str],
) -> DataFrame:
    """Predictions of the validation side; a row without known terms falls to the prior."""
    rows = members.filter(F.col("role") == "validation")
    scores = (
        weighted.filter(F.col("role") == "validation")
        .join(F.broadcast(likelihood), [*keys, "branch", "term"])
        .groupBy(key, *keys)
        .agg(
            *[F.sum(F.col("w") * F.col(f"ll_{i}")).alias(f"_s{i}") for i in range(len(labels))]
        )
    )
    total = [
        F.col(f"prior_{i}") + F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(len(labels))
    ]
    # rounding keeps the winner independent of summation order
    total = [F.round(x, 9) for x in total]
    return (
        rows.join(scores, [key, *keys], "left")
        .join(F.broadcast(priors), keys)
        .select(
            key,
            *keys,
            F.col("label").alias("true_label"),
            fixed_order_argmax(total, labels).alias("predicted_label"),
        )
    )


def influential_terms(likelihood: DataFrame, labels: list[str], keys: list[str], top: int = 30):
    """Highest log likelihoods per label, ties to the smaller term."""
    long = likelihood.select(
        *keys,
        "term",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(x).alias("label"), F.col(f"ll_{i}").alias("coefficient"))
                    for i, x in enumerate(labels)
                ]
            )
        ).alias("e"),
    ).select(*keys, "term", "e.label", F.round("e.coefficient", 9).alias("coefficient"))
    rank = F.row_number().over(
        Window.partitionBy(*keys, "label").orderBy(F.desc("coefficient"), "term")
    )
    return long.withColumn("rank", rank).filter(F.col("rank") <= top)


def feature_overlap(features: DataFrame, project: str, feature: str) -> DataFrame:
    """Pairwise Jaccard overlap of the projects' feature sets."""
    sizes = features.groupBy(project).agg(F.count("*").alias("n"))
    a = features.select(F.col(project).alias("project_a"), feature)
    b = features.select(F.col(project).alias("project_b"), feature)
    # sets are at most top-n features per project
    shared = (
        a.join(b, feature)
        .filter(F.col("project_a") < F.col("project_b"))
        .groupBy("project_a", "project_b")
        .agg(F.count("*").alias("shared"))
    )
    left = sizes.select(F.col(project).alias("project_a"), F.col("n").alias("na"))
    right = sizes.select(F.col(project).alias("project_b"), F.col("n").alias("nb"))
    pairs = left.crossJoin(F.broadcast(right)).filter(F.col("project_a") < F.col("project_b"))
    common = F.coalesce("shared", F.lit(0))
    return pairs.join(shared, ["project_a", "project_b"], "left").select(
        "project_a",
        "project_b",
        (common / F.greatest(F.col("na") + F.col("nb") - common, F.lit(1))).alias("jaccard"),
    )


# ---- class weights -----------------------------------------------------------------------


def class_weights(train: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Balanced, square-root and capped weights per label (and key)."""
    keys = by or []
    counts = train.groupBy(*keys, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    balanced = F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))
    return counts.select(
        *keys,
        "label",
        "n",
        balanced.alias("balanced"),
        F.sqrt(balanced).alias("sqrt_inverse_frequency"),
        F.least(balanced, F.lit(3.0)).alias("capped_balanced_3"),
    )


def validate_weights(weights: dict[str, float], labels: list[str]) -> dict[str, float]:
    if set(weights) != set(labels):
        raise ValueError("Class weights must define exactly the fixed labels")
    for label, value in weights.items():
        if not 0 < float(value) <= 10:
            raise ValueError(f"Class weight of {label} must be finite and in (0, 10]")
    return {x: float(weights[x]) for x in labels}


def _resolve_weights(
    train: DataFrame, label: str, scheme
) -> tuple[dict[str, float], dict[str, int]]:
    """Label -> weight and label -> rows; one row per label comes to the driver."""
    rows = class_weights(train, label).collect()
    if len(rows) < 2:
        raise ValueError("Every node requires at least two training classes")
    counts = {r["label"]: r["n"] for r in rows}
    if isinstance(scheme, dict):
        return scheme, counts
    if scheme is None:
        return {x: 1.0 for x in counts}, counts
    return {r["label"]: r[scheme] for r in rows}, counts


def sized_for_fit(rows: DataFrame, n: int) -> DataFrame:
    """Fewer tasks per iteration for small inputs; large ones keep their partitions."""
    return rows.coalesce(max(1, -(-n // ROWS_PER_TASK)))


# ---- Spark ML fits -----------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    family: str
    c: float = 1.0
    weighting: object = "balanced"
    # relative improvement of the objective at which a fit stops
    tolerance: float = 1e-6

    @property
    def name(self) -> str:
        shown = "none" if self.weighting is None else self.weighting
        return f"{self.family}|C={self.c}|weight={shown}"


# fixed values: candidate grid of the nested selection
def study_specs() -> list[Spec]:
    grid = [("LogisticRegression", c) for c in (0.25, 1.0, 4.0)]
    grid += [("LinearSVC", c) for c in (0.1, 0.5, 1.0, 2.0)]
    return [Spec(f, c, w) for f, c in grid for w in (None, "balanced")]


class Fitted:
    """A fitted classifier over ``labels``; ``score`` adds one column per label."""

    def __init__(self, labels: list[str], models: list, kind: str):
        self.labels, self.models, self.kind = labels, models, kind

    def score(self, rows: DataFrame) -> DataFrame:
        columns = rows.columns
        if self.kind == "LogisticRegression":
            out = self.models[0].transform(rows)
            p = vector_to_array("probability")
            return out.select(*columns, *[p[i].alias(f"s_{i}") for i in range(len(self.labels))])
        out = rows
        for i, model in enumerate(self.models):
            m = model.copy({model.rawPredictionCol: f"_raw_{i}", model.predictionCol: f"_p_{i}"})
            out = m.transform(out)
        margins = [vector_to_array(f"_raw_{i}")[1] for i in range(len(self.models))]
        if len(margins) == 1:
            margins = [-margins[0], margins[0]]
        return out.select(*columns, *[m.alias(f"s_{i}") for i, m in enumerate(margins)])

    def predict(self, rows: DataFrame) -> DataFrame:
        scores = [F.col(f"s_{i}") for i in range(len(self.labels))]
        return self.score(rows).select(
            *rows.columns, fixed_order_argmax(scores, self.labels).alias("predicted_label")
        )

    def coefficients(self) -> list[tuple[str, list[float], float]]:
        """(label, weights, intercept) rows: labels x features values on the driver."""
        if self.kind == "LogisticRegression":
            model = self.models[0]
            matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
            if len(self.labels) == 2:
                return [
                    (self.labels[0], (-matrix[0]).tolist(), float(-bias[0])),
                    (self.labels[1], matrix[0].tolist(), float(bias[0])),
                ]
            return [
                (x, matrix[i].tolist(), float(bias[i])) for i, x in enumerate(self.labels)
            ]
        pairs = [(m.coefficients.toArray(), float(m.intercept)) for m in self.models]
        if len(pairs) == 1:
            w, b = pairs[0]
            pairs = [(-w, -b), (w, b)]
        return [(x, w.tolist(), b) for x, (w, b) in zip(self.labels, pairs)]


def fit_classifier(train: DataFrame, spec: Spec, label: str = "label") -> Fitted:
    """Fit one model; ``train`` holds ``features`` and the label.

    The penalty is scaled so that the objective equals C times the summed weighted loss plus
    half the squared norm.
    """
    weights, counts = _resolve_weights(train, label, spec.weighting)
    labels = sorted(weights)
    position = {x: float(i) for i, x in enumerate(labels)}
    weighted = sized_for_fit(
        train.select(
            "features",
            lookup(F.col(label), position).alias("_y"),
            lookup(F.col(label), {x: float(weights[x]) for x in labels}).alias("_w"),
        ),
        sum(counts.values()),
    ).persist()
    try:
        if spec.family == "LogisticRegression":
            total = sum(weights[x] * counts[x] for x in labels)
            family = "binomial" if len(labels) == 2 else "multinomial"
            model = LogisticRegression(
                featuresCol="features", labelCol="_y", weightCol="_w", family=family,
                regParam=1.0 / (spec.c * total), elasticNetParam=0.0, standardization=False,
                maxIter=MAX_ITER, tol=spec.tolerance,
            ).fit(weighted)
            return Fitted(labels, [model], spec.family)
        if spec.family != "LinearSVC":
            raise ValueError(f"Unsupported model: {spec.family}")
        targets = labels[1:] if len(labels) == 2 else labels
        tasks = []
        for target in targets:
            # only the positive class carries its weight in a one-vs-rest fit
            y = (F.col("_y") == position[target]).cast("double")
            part = weighted.select(
                "features",
                y.alias("_y"),
                F.when(y == 1, F.lit(float(weights[target])))
                .otherwise(F.lit(float(weights[labels[0]]) if len(labels) == 2 else 1.0))
                .alias("_w"),
            )
            rest = sum(counts.values()) - counts[target]
            other = weights[labels[0]] if len(labels) == 2 else 1.0
            total = weights[target] * counts[target] + other * rest
            svc = LinearSVC(
                featuresCol="features", labelCol="_y", weightCol="_w",
                regParam=1.0 / (spec.c * total), standardization=False, maxIter=MAX_ITER, tol=spec.tolerance,
            )
            tasks.append(lambda svc=svc, part=part: svc.fit(part))
        return Fitted(labels, in_parallel(tasks), spec.family)
    finally:
        weighted.unpersist()


def fit_ridge(train: DataFrame, rank: str, alpha: float = 1.0):
    """Ridge on ranks. The penalty is rescaled because the solver scales the label."""
    facts = train.agg(F.stddev_samp(rank).alias("s"), F.count("*").alias("n")).first()
    return LinearRegression(
        featuresCol="features", labelCol=rank, regParam=alpha * (facts["s"] or 1.0) / facts["n"],
        elasticNetParam=0.0, standardization=False, solver="l-bfgs", maxIter=MAX_ITER, tol=1e-9,
    ).fit(sized_for_fit(train, facts["n"]))


def _side(rows: DataFrame, fold, role: str) -> DataFrame:
    return rows.filter((F.col("fold") == fold) & (F.col("role") == role))


def evaluate_folds(
    rows: DataFrame, folds: list, spec: Spec, key: str, label: str = "label"
) -> DataFrame:
    """Out-of-fold predictions (key, fold, true_label, predicted_label) of one model."""

    def one(fold):
        def run():
            model = fit_classifier(_side(rows, fold, "train"), spec, label)
            held = _side(rows, fold, "validation").select(
                key, "fold", F.col(label).alias("true_label"), "features"
            )
            return model.predict(held).drop("features")

        return run

    return union_all(in_parallel([one(f) for f in folds]))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def candidate_grid(
    grid: dict[str, list], method: str = "grid", iterations: int = 6, seed: int = 42
) -> list[dict]:
    """All combinations, or a seeded subset of them."""
    names = sorted(grid)
    combos = [dict(zip(names, v)) for v in itertools.product(*[grid[n] for n in names])]
    if method == "random" and len(combos) > iterations:
        picked = sorted(random.Random(seed).sample(range(len(combos)), iterations))
        combos = [combos[i] for i in picked]
    return combos


def rank_candidates(
    results: DataFrame, priority: str, feature_order: list[str], by: list[str] | None = None
) -> DataFrame:
    """Rank candidates over inner folds by the eight-key rule; rank 1 is selected.

    ``results`` has one row per candidate and fold: candidate, feature, macro_f1,
    minimum_recall, ``priority`` recall, feature_count, runtime_seconds.
    """
    keys = by or []
    order_of = {name: i for i, name in enumerate(feature_order)}
    means = results.groupBy(*keys, "candidate", "feature").agg(
        F.avg("macro_f1").alias("mean_macro_f1"),
        F.stddev_pop("macro_f1").alias("std_macro_f1"),
        F.avg("minimum_recall").alias("mean_minimum_recall"),
        F.avg(priority).alias("priority_recall"),
        F.avg("feature_count").alias("mean_features"),
        F.sum("runtime_seconds").alias("runtime"),
    )

    def near(c: str) -> Column:
        return F.round(c, 9)

    # as many rows as there are candidates
    order = Window.partitionBy(*keys).orderBy(
        near("mean_macro_f1").desc(),
        near("mean_minimum_recall").desc(),
        near("priority_recall").desc(),
        near("std_macro_f1"),
        lookup(F.col("feature"), order_of),
        "mean_features",
        "runtime",
        "candidate",
    )
    return means.withColumn("candidate_rank", F.row_number().over(order))


def first_best(results: DataFrame, tie_tolerance: float = 0.0) -> DataFrame:
    """Mean score per candidate, best first; within the tolerance the first listed wins.

    ``results``: candidate, position, macro_f1.
    """
    means = results.groupBy("candidate", "position").agg(
        F.avg("macro_f1").alias("mean_macro_f1"), F.stddev_pop("macro_f1").alias("std_macro_f1")
    )
    top = F.max("mean_macro_f1").over(Window.partitionBy())
    eligible = F.col("mean_macro_f1") >= top - F.lit(float(tie_tolerance)) - 1e-12
    first = F.min(F.when(eligible, F.col("position"))).over(Window.partitionBy())
    return means.withColumn("selected", F.col("position") == first)


# ---- hierarchies -------------------------------------------------------------------------


def hard_route(level1: DataFrame, children: DataFrame, key: list[str]) -> DataFrame:
    """Child prediction of the predicted group.

    ``level1(key, grp)``; ``children(key, grp, predicted_label)``.
    """
    return level1.join(children, [*key, "grp"])


def soft_route(
    group_scores: DataFrame, child_scores: DataFrame, key: list[str], labels: list[str]
) -> DataFrame:
    """Label of the largest P(group) x P(label | group), first in fixed label order."""
    order = {x: i for i, x in enumerate(labels)}
    composed = group_scores.join(child_scores, [*key, "grp"]).withColumn(
        "_score", F.round(F.col("group_score") * F.col("child_score"), 12)
    )
    # a row has as many scores as there are labels
    return composed.groupBy(*key).agg(
        F.max_by(
            "label", F.struct("_score", -lookup(F.col("label"), order))
        ).alias("predicted_label"),
        F.count("*").alias("labels_scored"),
    )


def hierarchy_nodes(name: str, spec: Spec) -> list[Candidate]:
    """Models of a two-level hierarchy: the groups first, then the labels of each group."""
    groups = HIERARCHIES[name]

    def node(which: str, target: dict[str, str]) -> Candidate:
        return Candidate(f"{name}|{which}", spec.family, spec.c, spec.weighting, tuple(sorted(target.items())))

    return [node("groups", invert(groups))] + [node(g, {x: x for x in own}) for g, own in groups.items()]


def evaluate_hierarchy(scores: DataFrame, name: str, key: str, first: int = 0) -> DataFrame:
    """Out-of-fold hard, soft and oracle predictions of a two-level hierarchy.

    ``scores(key, fold, label, scores)`` as :meth:`Bank.scores` gives them, with the hierarchy's
    nodes from number ``first`` on. A row's routes follow from its own scores, so no row moves.
    """
    groups = HIERARCHIES[name]

    def of(node: int, names: list[str]) -> dict[str, Column]:
        return {x: F.col("scores")[first + node][i] for i, x in enumerate(sorted(names))}

    def best(found: dict[str, Column], order: list[str]) -> Column:
        return fixed_order_argmax([found[x] for x in order], order)

    level1 = of(0, list(groups))
    children = {g: of(n + 1, own) for n, (g, own) in enumerate(groups.items())}
    chosen = best(level1, sorted(groups))
    truth = lookup(F.col("label"), invert(groups))
    by_group = {g: best(children[g], sorted(own)) for g, own in groups.items()}

    def child_of(group: Column) -> Column:
        return F.coalesce(*[F.when(group == g, by_group[g]) for g in groups])

    composed = {}
    for g, own in groups.items():
        for x in own:
            known = (level1[g] >= 0) & (children[g][x] >= 0)
            composed[x] = F.when(known, F.round(level1[g] * children[g][x], 12)).otherwise(-1.0)
    soft = best(composed, [x for x in LABELS if x in composed])
    routes = F.array(
        *[
            F.struct(F.lit(r).alias("routing"), p.alias("predicted_label"), g.alias("predicted_group"))
            for r, p, g in (
                ("hard", child_of(chosen), chosen), ("soft", soft, chosen), ("oracle", child_of(truth), truth)
            )
        ]
    )
    ids = [key, "fold"]
    return scores.select(
        *ids, F.explode(routes).alias("e"), F.col("label").alias("true_label"), truth.alias("true_group")
    ).select(*ids, "e.*", "true_label", "true_group")


# ---- ordinal models ----------------------------------------------------------------------


def threshold_models(ranked: list[str], spec: Spec) -> list[Candidate]:
    """A binary model for each threshold t: is the rank of a label greater than t."""
    return [
        Candidate(f"gt_{t}", spec.family, spec.c, spec.weighting, tuple((x, str(int(r > t))) for r, x in enumerate(ranked)))
        for t in range(len(ranked) - 1)
    ]


def evaluate_ordinal(scores: DataFrame, ranked: list[str], key: str) -> DataFrame:
    """Out-of-fold probability of rank > t for every threshold, as one array per row."""
    rank = lookup(F.col("label"), {x: i for i, x in enumerate(ranked)})
    q = F.transform("scores", lambda s: s[1])
    return scores.select(key, "fold", rank.alias("true_rank"), q.alias("q"))


# ---- persistence and scoring -------------------------------------------------------------


def save_linear(model: Fitted, vocabulary: DataFrame, path: str) -> None:
    """Store a fitted linear model as two tables: terms with weights, labels with intercepts."""
    spark = vocabulary.sparkSession
    rows = model.coefficients()
    weights = list(zip(*[w for _, w, _ in rows]))
    # vocabulary-sized, bounded by max_features
    table = spark.createDataFrame(
        [(i, [float(x) for x in w]) for i, w in enumerate(weights)],
        "idx int, coefficients array<double>",
    )
    vocabulary.select("branch", "term", "idx", "idf").join(table, "idx").write.mode(
        "errorifexists"
    ).parquet(f"{path}/terms")
    spark.createDataFrame(
        [(i, x, b) for i, (x, _, b) in enumerate(rows)],
        "position int, label string, intercept double",
    ).coalesce(1).write.mode("errorifexists").parquet(f"{path}/labels")


def load_linear(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/labels")


def score_linear(
    docs: DataFrame, key: str, branches, terms: DataFrame, labels: DataFrame
) -> DataFrame:
    """Score new texts with a stored linear model."""
    from triagemill.operators.features import counted_rows, weighted_rows

    facts = labels.orderBy("position").collect()  # labels only
    names, bias = [r["label"] for r in facts], np.array([r["intercept"] for r in facts])
    one = F.array(F.struct(F.lit(1).alias("fold")))
    counted = counted_rows(docs.withColumn("members", one), key, branches, ("members",))
    vocabulary = terms.select(F.lit(1).alias("fold"), "branch", "term", "idx", "idf")
    weighted = weighted_rows(counted, vocabulary, key, branches).select(key, "indices", "values")
    # bounded by max_features x labels
    table = terms.select("idx", "coefficients").toArrow().combine_chunks()
    index = table["idx"].to_numpy()
    weights = np.zeros((int(index.max(initial=-1)) + 1, len(names)))
    weights[index] = pc.list_flatten(table["coefficients"]).to_numpy().reshape(-1, len(names))
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("indices").value_lengths().to_numpy().cumsum()
            at = pc.list_flatten(batch.column("indices")).to_numpy()
            value = pc.list_flatten(batch.column("values")).to_numpy()
            out = np.tile(bias, (batch.num_rows, 1))
            for row, (low, high) in enumerate(zip(np.append(0, ends[:-1]), ends)):
                out[row] += value[low:high] @ sent.value[at[low:high]]
            best = pa.array(names).take(pa.array(out.argmax(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(key), best], names=[key, "predicted_label"])

    fields = [docs.schema[key], T.StructField("predicted_label", T.StringType())]
    return weighted.mapInArrow(add, T.StructType(fields))
