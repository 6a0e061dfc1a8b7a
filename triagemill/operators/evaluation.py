"""Metrics over prediction tables.

Everything starts from :func:`confusion`, a table of (keys, true, predicted, count) over a
fixed label list, so any key set (fold, model, project, slice) costs one aggregation of the
rows; what follows works on labels x labels cells per key. Division by zero gives zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagemill.functions.labels import lookup


def ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def _cells(
    preds: DataFrame, keys: list[str], labels: list[str], true: str, predicted: str
) -> DataFrame:
    """Observed (true, predicted) pairs and their rows, per key."""
    return preds.groupBy(*keys, F.col(true).alias("t"), F.col(predicted).alias("p")).agg(
        F.count("*").alias("n")
    )


def confusion(
    preds: DataFrame,
    keys: list[str],
    labels: list[str],
    true: str = "true_label",
    predicted: str = "predicted_label",
) -> DataFrame:
    """Dense confusion cells with the row-normalized value."""
    cells = _cells(preds, keys, labels, true, predicted)
    known = F.col("t").isin(labels) & F.col("p").isin(labels)
    per_key = cells.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.when(known, F.struct(F.struct("t", "p"), "n")))
        ).alias("_map")
    )
    names = F.array(*[F.lit(x) for x in labels])
    dense = (
        per_key.withColumn("true_label", F.explode(names))
        .withColumn("predicted_label", F.explode(names))
        .withColumn(
            "count",
            F.coalesce(
                F.try_element_at(
                    "_map",
                    F.struct(
                        F.col("true_label").alias("t"), F.col("predicted_label").alias("p")
                    ),
                ),
                F.lit(0),
            ),
        )
        .drop("_map")
    )
    total = F.sum("count").over(Window.partitionBy(*keys, "true_label"))
    return dense.withColumn("normalized", ratio(F.col("count"), total))


def class_metrics(
    preds: DataFrame,
    keys: list[str],
    labels: list[str],
    true: str = "true_label",
    predicted: str = "predicted_label",
) -> DataFrame:
    """Precision, recall, F1, support and predicted count per key and label.

    Labels outside the fixed list still count: a row predicted as an unknown label, or not at
    all, is a miss for its true label.
    """
    cells = _cells(preds, keys, labels, true, predicted)
    sides = cells.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.col("t").alias("label"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("p").alias("label"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        ).alias("s"),
    ).select(*keys, "s.*")
    per_label = sides.groupBy(*keys, "label").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"),
    )
    dense = per_label.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(
                F.when(
                    F.col("label").isin(labels),
                    F.struct("label", F.struct("support", "predicted", "hits")),
                )
            )
        ).alias("_map")
    ).withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    cell = F.try_element_at("_map", F.col("label"))
    dense = dense.select(
        *keys,
        "label",
        *[
            F.coalesce(cell[c], F.lit(0).cast("bigint")).alias(c)
            for c in ("support", "predicted", "hits")
        ],
    )
    precision = ratio(F.col("hits"), F.col("predicted"))
    recall = ratio(F.col("hits"), F.col("support"))
    f1 = ratio(2 * F.col("hits"), F.col("predicted") + F.col("support"))
    return dense.select(
        *keys,
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        "support",
        "predicted",
        "hits",
    )


def metrics(
    preds: DataFrame,
    keys: list[str],
    labels: list[str],
    true: str = "true_label",
    predicted: str = "predicted_label",
) -> DataFrame:
    """One row per key: macro, weighted and plain averages and the minimum recall.

    Macro averages run over the fixed list, balanced accuracy over labels present in truth.
    """
    per_label = class_metrics(preds, keys, labels, true, predicted)
    present = F.when(F.col("support") > 0, F.col("recall"))
    # labels outside the list and missing predictions are part of accuracy's denominator
    hits = F.coalesce(F.sum(F.when(F.col("t") == F.col("p"), F.col("n"))), F.lit(0))
    rows = (
        _cells(preds, keys, labels, true, predicted)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.when(F.sum("n") > 0, hits / F.sum("n")).alias("accuracy"),
        )
    )
    averaged = per_label.groupBy(*keys).agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.coalesce(F.avg(present), F.lit(0.0)).alias("balanced_accuracy"),
        F.min("recall").alias("minimum_recall"),
    )
    if not keys:
        return averaged.crossJoin(rows)
    return averaged.join(rows, keys)


def classification_report(
    preds: DataFrame, keys: list[str], labels: list[str]
) -> DataFrame:
    """Label rows followed by accuracy, macro and weighted rows."""
    per_label = class_metrics(preds, keys, labels)
    label_rows = per_label.select(*keys, "label", "precision", "recall", "f1", "support")
    total = F.sum("support").alias("support")
    macro = per_label.groupBy(*keys).agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        total,
    ).select(*keys, F.lit("macro avg").alias("label"), "precision", "recall", "f1", "support")
    weight = F.col("support")
    weighted = per_label.groupBy(*keys).agg(
        *[
            ratio(F.sum(F.col(c) * weight), F.sum(weight)).alias(c)
            for c in ("precision", "recall", "f1")
        ],
        total,
    ).select(*keys, F.lit("weighted avg").alias("label"), "precision", "recall", "f1", "support")
    accuracy = per_label.groupBy(*keys).agg(
        ratio(F.sum("hits"), F.sum("support")).alias("_acc"), total
    ).select(
        *keys,
        F.lit("accuracy").alias("label"),
        F.col("_acc").alias("precision"),
        F.col("_acc").alias("recall"),
        F.col("_acc").alias("f1"),
        "support",
    )
    return label_rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def bootstrap_macro_f1(
    preds: DataFrame,
    keys: list[str],
    labels: list[str],
    resamples: int = 1000,
    confidence: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Stratified bootstrap interval of macro-F1 per key.

    Resampling the n rows of a true class with replacement is one multinomial draw over that
    class's confusion row, so replicates are drawn from the cells and the cost does not
    depend on the number of rows. Replicates are spread over tasks by (key, replicate).
    """
    cells = _cells(preds, keys, labels, "true_label", "predicted_label").filter(
        F.col("t").isin(labels)
    )
    position = {label: i for i, label in enumerate(labels)}
    outside = len(labels)
    row = cells.withColumn("_t", lookup(F.col("t"), position)).withColumn(
        "_p", F.coalesce(lookup(F.col("p"), position), F.lit(outside))
    )
    packed = row.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_t", "_p", "n"))).alias("cells")
    )
    size = len(labels)

    @F.pandas_udf("double")
    def replicate_score(cells: pd.Series, replicate: pd.Series) -> pd.Series:
        out = []
        for entries, index in zip(cells, replicate):
            matrix = np.zeros((size, size + 1))
            for e in entries:
                matrix[e["_t"], e["_p"]] += e["n"]
            rng = np.random.default_rng([seed, int(index)])
            drawn = np.zeros_like(matrix)
            for i in range(size):
                n = int(matrix[i].sum())
                if n:
                    drawn[i] = rng.multinomial(n, matrix[i] / n)
            hits = np.diag(drawn[:, :size])
            denominator = drawn.sum(axis=1) + drawn[:, :size].sum(axis=0)
            f1 = np.divide(
                2 * hits, denominator, out=np.zeros(size), where=denominator > 0
            )
            out.append(float(f1.mean()))
        return pd.Series(out)

    alpha = (1.0 - confidence) / 2.0
    scored = (
        packed.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
        .repartition(*keys, "replicate")
        .withColumn("macro_f1", replicate_score("cells", "replicate"))
    )
    return scored.groupBy(*keys).agg(
        F.percentile("macro_f1", alpha).alias("lower"),
        F.percentile("macro_f1", 1.0 - alpha).alias("upper"),
        F.avg("macro_f1").alias("mean"),
    )


def common_confusions(preds: DataFrame, keys: list[str]) -> DataFrame:
    return (
        preds.filter(F.col("true_label") != F.col("predicted_label"))
        .groupBy(*keys, "true_label", "predicted_label")
        .agg(F.count("*").alias("errors"))
    )


def error_sides(preds: DataFrame) -> DataFrame:
    """Errors by true class and by predicted class in one table."""
    errors = preds.filter(F.col("true_label") != F.col("predicted_label"))
    return (
        errors.select(
            F.explode(
                F.array(
                    F.struct(F.lit("true").alias("side"), F.col("true_label").alias("label")),
                    F.struct(
                        F.lit("predicted").alias("side"), F.col("predicted_label").alias("label")
                    ),
                )
            ).alias("s")
        )
        .groupBy("s.side", "s.label")
        .agg(F.count("*").alias("errors"))
    )


def length_statistics(preds: DataFrame, length: Column) -> DataFrame:
    """Mean and exact median text length of right and of wrong predictions."""
    return (
        preds.select((F.col("true_label") == F.col("predicted_label")).alias("correct"),
                     length.alias("_length"))
        .groupBy("correct")
        .agg(F.avg("_length").alias("mean_length"), F.median("_length").alias("median_length"))
    )


def representative_errors(preds: DataFrame, key: str, limit: int = 20) -> DataFrame:
    return (
        preds.filter(F.col("true_label") != F.col("predicted_label"))
        .orderBy("true_label", "predicted_label", key)
        .limit(limit)
    )


def errors_by_dimension(errors: DataFrame, dimensions: list[str]) -> DataFrame:
    """Error counts of several one-column groupings in a single pass."""
    entries = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
            for d in dimensions
        ]
    )
    return (
        errors.select(F.explode(entries).alias("e"))
        .groupBy("e.dimension", "e.value")
        .agg(F.count("*").alias("errors"))
    )


def first_rows_per_group(
    df: DataFrame, groups: list[str], order_by: list[str], limit: int, payload: list[str]
) -> DataFrame:
    """The first ``limit`` rows of every group, in order.

    Spark turns the rank filter into a per-task group limit ahead of the shuffle, so a hot
    group sends at most ``limit`` rows from each task.
    """
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order_by))
    return (
        df.withColumn("rank_in_group", rank)
        .filter(F.col("rank_in_group") <= limit)
        .select(*groups, *[c for c in payload if c not in groups], "rank_in_group")
    )


def metric_slices(
    preds: DataFrame, keys: list[str], dimensions: list[str], labels: list[str]
) -> DataFrame:
    """Macro-F1 and mean absolute rank error by (dimension, value)."""
    entries = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
            for d in dimensions
        ]
    )
    sliced = preds.withColumn("_e", F.explode(entries)).select(
        *keys,
        F.col("_e.dimension").alias("dimension"),
        F.col("_e.value").alias("value"),
        "true_label",
        "predicted_label",
        F.abs(F.col("predicted_rank") - F.col("true_rank")).alias("_distance"),
    )
    by = [*keys, "dimension", "value"]
    distance = sliced.groupBy(*by).agg(F.avg("_distance").alias("mean_absolute_error"))
    scored = metrics(sliced, by, labels).select(*by, "rows", "macro_f1")
    return scored.join(distance, by)


def routing_errors(preds: DataFrame) -> DataFrame:
    """Tag rows as correct, routed to the wrong group, or wrong inside the right group."""
    return preds.withColumn(
        "error_type",
        F.when(F.col("true_label") == F.col("predicted_label"), "correct")
        .when(F.col("true_group") != F.col("predicted_group"), "routing_error")
        .otherwise("within_group_error"),
    )


def routing_summary(tagged: DataFrame, keys: list[str]) -> DataFrame:
    kinds = ("correct", "routing_error", "within_group_error")
    return tagged.groupBy(*keys).agg(
        *[F.count_if(F.col("error_type") == k).alias(f"{k}_count") for k in kinds],
        *[
            F.avg((F.col("error_type") == k).cast("double")).alias(f"{k}_rate")
            for k in kinds
        ],
    )


def routing_details(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Routing errors by (true label, predicted group); inner errors by child node."""
    routing = (
        tagged.filter(F.col("error_type") == "routing_error")
        .groupBy(*keys, "error_type", F.col("predicted_group").alias("node"), "true_label")
        .agg(F.count("*").alias("errors"))
        .withColumn("predicted_label", F.lit(""))
    )
    inside = (
        tagged.filter(F.col("error_type") == "within_group_error")
        .groupBy(
            *keys, "error_type", F.col("true_group").alias("node"), "true_label",
            "predicted_label",
        )
        .agg(F.count("*").alias("errors"))
    )
    return routing.unionByName(inside)


def rank_cells(preds: DataFrame, keys: list[str]) -> DataFrame:
    """(true rank, predicted rank) cells per key; everything ordinal derives from them."""
    return preds.groupBy(*keys, "true_rank", "predicted_rank").agg(F.count("*").alias("n"))


def ordinal_metrics(preds: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Ordinal error measures per key, from the rank cells."""
    cells = rank_cells(preds, keys)
    n = F.col("n")
    truth, guess = F.col("true_rank").cast("double"), F.col("predicted_rank").cast("double")
    signed = guess - truth
    distance = F.abs(signed)
    total = F.sum("n")

    def share(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0)) / total

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0)).cast("bigint")

    basic = cells.groupBy(*keys).agg(
        total.alias("rows"),
        (F.sum(distance * n) / total).alias("mean_absolute_error"),
        F.percentile(distance, 0.5, n).alias("median_absolute_error"),
        F.sqrt(F.sum(signed * signed * n) / total).alias("root_mean_squared_error"),
        share(distance == 0).alias("exact_rank_accuracy"),
        share(distance <= 1).alias("within_one_accuracy"),
        share(distance <= 2).alias("within_two_accuracy"),
        (F.sum(signed * n) / total).alias("mean_signed_error"),
        share(signed > 0).alias("overestimation_rate"),
        share(signed < 0).alias("underestimation_rate"),
        count(distance >= 3).alias("extreme_error_count"),
        share(distance >= 3).alias("extreme_error_rate"),
        F.sum(signed * signed * n).alias("_observed"),
        *[count(distance == d).alias(f"distance_{d}_count") for d in range(classes)],
        *[share(distance == d).alias(f"distance_{d}_rate") for d in range(classes)],
    )
    # chance disagreement: sum over i, j of (i - j)^2 * row_i * col_j / N
    expected = cells.groupBy(*keys).agg(
        *[
            (
                F.sum(truth * truth * n) + F.sum(guess * guess * n)
                - 2 * F.sum(truth * n) * F.sum(guess * n) / total
            ).alias("_expected")
        ]
    )
    correlated = _rank_correlation(cells, keys)
    joined = basic.join(expected, keys).join(correlated, keys)
    return joined.select(
        *[c for c in basic.columns if c != "_observed"],
        F.when(F.col("_expected") == 0, F.lit(None).cast("double"))
        .otherwise(1 - F.col("_observed") / F.col("_expected"))
        .alias("quadratic_weighted_kappa"),
        "spearman_correlation",
    )


def _rank_correlation(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman correlation with average ranks for ties, from the cells."""

    def ranks(column: str, name: str) -> DataFrame:
        by_value = cells.groupBy(*keys, column).agg(F.sum("n").alias("_n"))
        before = F.sum("_n").over(
            Window.partitionBy(*keys).orderBy(column).rowsBetween(
                Window.unboundedPreceding, Window.currentRow
            )
        ) - F.col("_n")
        return by_value.select(*keys, column, (before + (F.col("_n") + 1) / 2).alias(name))

    ranked = cells.join(ranks("true_rank", "_rt"), [*keys, "true_rank"]).join(
        ranks("predicted_rank", "_rp"), [*keys, "predicted_rank"]
    )
    n, x, y = F.col("n"), F.col("_rt"), F.col("_rp")
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").cast("double").alias("c"),
        F.sum(n * x).alias("sx"),
        F.sum(n * y).alias("sy"),
        F.sum(n * x * x).alias("sxx"),
        F.sum(n * y * y).alias("syy"),
        F.sum(n * x * y).alias("sxy"),
    )
    vx = F.col("c") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("c") * F.col("syy") - F.col("sy") * F.col("sy")
    cov = F.col("c") * F.col("sxy") - F.col("sx") * F.col("sy")
    return sums.select(
        *keys,
        F.when((vx <= 0) | (vy <= 0), F.lit(0.0))
        .otherwise(cov / F.sqrt(vx * vy))
        .alias("spearman_correlation"),
    )


def named_rank_errors(preds: DataFrame, keys: list[str], ordered: list[str]) -> DataFrame:
    """Distances, extremes, misses of the two top classes and adjacent confusions."""
    top, second = len(ordered) - 1, len(ordered) - 2
    third = len(ordered) - 3
    t, p = F.col("true_rank"), F.col("predicted_rank")

    def pair(a: int, b: int) -> Column:
        return F.count_if((t == a) & (p == b))

    return preds.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if(F.abs(t - p) >= 3).alias("extreme_errors"),
        F.count_if(t == top).alias("top_support"),
        pair(top, top).alias("top_exact"),
        pair(top, second).alias("top_as_second"),
        F.count_if((t == top) & (p <= top - 2)).alias("top_at_least_two_lower"),
        F.count_if((t == top) & (p <= top - 3)).alias("top_at_least_three_lower"),
        F.count_if(t == second).alias("second_support"),
        pair(second, second).alias("second_exact"),
        pair(second, top).alias("second_as_top"),
        F.count_if((t == second) & (p <= second - 2)).alias("second_at_least_two_lower"),
        F.count_if((t == second) & (p <= second - 3)).alias("second_at_least_three_lower"),
        F.count_if((t == 0) & (p >= 2)).alias("lowest_at_least_two_higher"),
        pair(third, third - 1).alias("third_as_fourth"),
        pair(third - 1, third).alias("fourth_as_third"),
        pair(third - 2, third - 1).alias("fifth_as_fourth"),
        pair(third - 1, third - 2).alias("fourth_as_fifth"),
        F.count_if(p == third - 1).alias("fourth_predictions"),
    )


def paired_comparison(
    preds: DataFrame, baseline: str, model: str = "model", keys: tuple[str, ...] = ("id", "fold")
) -> DataFrame:
    """Rows corrected, worsened and moved closer against the baseline model."""
    distance = F.abs(F.col("predicted_rank") - F.col("true_rank"))
    scored = preds.withColumn("_d", distance)
    base = scored.filter(F.col(model) == baseline).select(*keys, F.col("_d").alias("_b"))
    return _against_baseline(
        scored.filter(F.col(model) != baseline).join(base, list(keys)), model
    )


def compared_cases(
    cases: DataFrame, models: list[str], baseline: str, true_rank: str = "true_rank"
) -> DataFrame:
    """:func:`paired_comparison` where one row holds the ranks of all models of its case.

    Each of ``models`` is a column of ranks; rows meet their baseline without a join.
    """

    def distance(model: str) -> Column:
        return F.abs(F.col(model) - F.col(true_rank))

    others = [
        F.struct(F.lit(m).alias("model"), distance(m).alias("d")) for m in models if m != baseline
    ]
    paired = cases.select(
        distance(baseline).alias("_b"), F.explode(F.array(*others)).alias("_m")
    ).select("_b", "_m.model", F.col("_m.d").alias("_d"))
    return _against_baseline(paired, "model")


def _against_baseline(paired: DataFrame, model: str) -> DataFrame:
    """Counts by model over its distance ``_d`` and the baseline's distance ``_b``."""
    return paired.groupBy(model).agg(
        F.count_if((F.col("_d") == 0) & (F.col("_b") > 0)).alias("corrected"),
        F.count_if(F.col("_d") > F.col("_b")).alias("worsened"),
        F.count_if(F.col("_d") < F.col("_b")).alias("closer"),
    )


def over_folds(fold_metrics: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean and both standard deviations of fold metrics."""
    return fold_metrics.groupBy(*keys).agg(
        F.count("*").alias("folds"),
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"sample_std_{c}") for c in columns],
    )


def threshold_results(scored: DataFrame, keys: list[str], thresholds: int) -> DataFrame:
    """Binary results of every cumulative threshold; ``q`` is the probability array."""
    exploded = scored.select(
        *keys, "true_rank", F.posexplode("q").alias("threshold", "_q")
    ).filter(F.col("threshold") < thresholds)
    actual = F.col("true_rank") > F.col("threshold")
    guess = F.col("_q") >= 0.5
    cells = exploded.groupBy(*keys, "threshold").agg(
        F.count("*").alias("rows"),
        F.count_if(~actual & ~guess).alias("tn"),
        F.count_if(~actual & guess).alias("fp"),
        F.count_if(actual & ~guess).alias("fn"),
        F.count_if(actual & guess).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    positive_f1 = ratio(2 * tp, 2 * tp + fp + fn)
    negative_f1 = ratio(2 * tn, 2 * tn + fp + fn)
    # labels absent from truth and prediction do not enter the binary averages
    has_pos = ((tp + fn + fp) > 0).cast("int")
    has_neg = ((tn + fp + fn) > 0).cast("int")
    in_truth = ((tp + fn) > 0).cast("int") + ((tn + fp) > 0).cast("int")
    return cells.select(
        *keys,
        "threshold",
        ((positive_f1 * has_pos + negative_f1 * has_neg) / (has_pos + has_neg)).alias(
            "binary_macro_f1"
        ),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / in_truth).alias("balanced_accuracy"),
        ratio(tp, tp + fp).alias("positive_precision"),
        ratio(tp, tp + fn).alias("positive_recall"),
        positive_f1.alias("positive_f1"),
        (tp + fn).alias("positive_support"),
        (tn + fp).alias("negative_support"),
        ((tp + fp) / F.col("rows")).alias("predicted_positive_rate"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def precision_recall_curve(scored: DataFrame, actual: Column, score: Column) -> DataFrame:
    """Cumulative hits by descending distinct score.

    Rows collapse to distinct scores first. The running totals then go by score range: each
    score bucket is summed, bucket totals are accumulated, and the window only runs inside a
    bucket.
    """
    by_score = scored.groupBy(score.alias("threshold")).agg(
        F.count_if(actual).alias("_p"), F.count_if(~actual).alias("_n")
    )
    # x / (1 + |x|) keeps the order and maps any score into (-1, 1): 65,537 buckets at most, and
    # large margins still spread over many of them
    squashed = F.col("threshold") / (1 + F.abs("threshold"))
    bucketed = by_score.withColumn("_bucket", F.floor(squashed * 32_768).cast("bigint"))
    totals = bucketed.groupBy("_bucket").agg(
        F.sum("_p").alias("_bp"), F.sum("_n").alias("_bn")
    )
    descending = Window.orderBy(F.desc("_bucket"))
    starts = totals.select(
        "_bucket",
        (F.sum("_bp").over(descending) - F.col("_bp")).alias("_sp"),
        (F.sum("_bn").over(descending) - F.col("_bn")).alias("_sn"),
        F.sum("_bp").over(Window.partitionBy()).alias("_positives"),
        F.sum("_bn").over(Window.partitionBy()).alias("_negatives"),
    )
    inside = (
        Window.partitionBy("_bucket")
        .orderBy(F.desc("threshold"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    tp = F.sum("_p").over(inside) + F.col("_sp")
    fp = F.sum("_n").over(inside) + F.col("_sn")
    return bucketed.join(F.broadcast(starts), "_bucket").select(
        "threshold",
        tp.alias("tp"),
        fp.alias("fp"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("_positives")).alias("recall"),
        ratio(fp, F.col("_negatives")).alias("false_positive_rate"),
        F.col("_p").alias("step_positives"),
        F.col("_n").alias("step_negatives"),
        F.col("_positives").alias("positives"),
        F.col("_negatives").alias("negatives"),
    )


def curve_areas(curve: DataFrame) -> DataFrame:
    """Trapezoid PR-AUC and ROC-AUC. The previous point follows from the step counts alone."""
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("step_positives"), fp - F.col("step_negatives")
    before = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0 / (tp0 + fp0))
    pr = F.col("step_positives") / F.col("positives") * (F.col("precision") + before) / 2
    roc = (
        F.col("step_negatives")
        / F.col("negatives")
        * (tp + tp0)
        / F.col("positives")
        / 2
    )
    return curve.agg(F.sum(pr).alias("pr_auc"), F.sum(roc).alias("roc_auc"))


def predicted_distribution(preds: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Dominant share and plausibility: every label predicted, none at 85 % or more."""
    counts = preds.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col("predicted_label") == x).alias(f"_c{i}")
          for i, x in enumerate(labels)],
    )
    cols = [F.col(f"_c{i}") for i in range(len(labels))]
    most = F.greatest(*cols)
    return counts.select(
        *keys,
        "rows",
        F.explode(
            F.array(
                *[F.struct(F.lit(x).alias("label"), c.alias("predictions"))
                  for x, c in zip(labels, cols)]
            )
        ).alias("_e"),
        (most / F.col("rows")).alias("dominant_share"),
        ((F.least(*cols) > 0) & (most / F.col("rows") < 0.85)).alias("plausible"),
    ).select(
        *keys, "rows", F.col("_e.label").alias("label"),
        F.col("_e.predictions").alias("predictions"), "dominant_share", "plausible",
    )


def monotonicity_audit(scored: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows whose raw probabilities rise, and how far the projection moves them."""
    from triagemill.functions.ordinal import project_monotonic

    q = F.col("q")
    moved = F.zip_with(q, project_monotonic(q, size), lambda a, b: F.abs(a - b))
    rises = F.exists(
        F.zip_with(
            F.slice(q, 1, size - 1), F.slice(q, 2, size - 1), lambda a, b: b - a
        ),
        lambda d: d > 1e-12,
    )
    per_row = scored.select(*keys, moved.alias("_moved"), rises.alias("_rises"))
    total = F.aggregate("_moved", F.lit(0.0), lambda acc, x: acc + x)
    return per_row.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if("_rises").alias("violating_rows"),
        F.avg(F.col("_rises").cast("double")).alias("violation_rate"),
        F.avg(total / size).alias("mean_absolute_correction"),
        F.max(F.array_max("_moved")).alias("maximum_absolute_correction"),
    )
