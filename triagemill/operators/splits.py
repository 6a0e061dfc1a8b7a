"""Holdouts, expanding folds, purges and their audits.

Every function takes a narrow table with ``pos`` and ``n_rows`` from
:func:`triagemill.operators.positions.with_position`, or a key to order by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.operators.positions import with_position
from triagemill.operators.skew import attach_facts


def _fail_if_any(df: DataFrame, message: str) -> None:
    """Raise when ``df`` has rows; reads at most a handful."""
    rows = df.limit(5).collect()
    if rows:
        shown = ", ".join(str(tuple(r)) for r in rows)
        raise ValueError(f"{message}: {shown}")


def cut_position(n_rows: Column, fraction: float) -> Column:
    return F.floor(n_rows * F.lit(float(fraction)))


def chronological_holdout(
    df: DataFrame, time: str, tie: str, label: str, fraction: float = 0.8, checked: bool = True
) -> DataFrame:
    """First floor(n * fraction) rows in time order are ``development``, the rest ``test``."""
    positioned = with_position(df, [time, tie])
    out = positioned.withColumn(
        "partition",
        F.when(F.col("pos") < cut_position(F.col("n_rows"), fraction), "development").otherwise(
            "test"
        ),
    )
    if checked:
        facts = out.agg(
            F.count_if(F.col(time).isNull()).alias("missing"),
            F.count_if(F.col("partition") == "development").alias("development"),
            F.count_if(F.col("partition") == "test").alias("test"),
        ).first()
        if facts["missing"]:
            raise ValueError(
                f"Chronological split found {facts['missing']} rows without a timestamp"
            )
        if not facts["development"] or not facts["test"]:
            raise ValueError("Chronological split produced an empty side")
        _fail_if_any(labels_only_in_test(out, label), "Labels only in the test period")
    return out


def holdout_with_fallback(
    df: DataFrame,
    time: str,
    tie: str,
    label: str,
    fraction: float = 0.8,
    allow_missing_dates: bool = False,
    seed: int = 42,
) -> DataFrame:
    """Chronological when every row has a time; stratified when allowed and some do not."""
    if allow_missing_dates and df.filter(F.col(time).isNull()).limit(1).count():
        return stratified_holdout(df, tie, label, fraction, seed)
    return chronological_holdout(df, time, tie, label, fraction)


def labels_only_in_test(split: DataFrame, label: str) -> DataFrame:
    """Labels that occur in ``test`` but not in ``development``."""
    name = F.lower(F.trim(F.col(label))).alias("label")
    return (
        split.groupBy(name)
        .agg(
            F.max((F.col("partition") == "development").cast("int")).alias("_dev"),
            F.max((F.col("partition") == "test").cast("int")).alias("_test"),
        )
        .filter((F.col("_dev") == 0) & (F.col("_test") == 1))
        .select("label")
    )


def purge_test(split: DataFrame, group: str, checked: bool = True) -> DataFrame:
    """Drop test rows whose duplicate group already occurs in development."""
    marked = mark_purged_test(split, group)
    kept = marked.filter(~F.col("purged")).drop("purged")
    if checked and not kept.filter(F.col("partition") == "test").limit(1).count():
        raise ValueError("Purge removed the entire test set")
    return kept


def mark_purged_test(split: DataFrame, group: str) -> DataFrame:
    """``purged`` is true for test rows of a group seen in development, never without a group."""
    dev_groups = (
        split.filter(F.col(group).isNotNull())
        .groupBy(F.col(group).alias(group))
        .agg(
            F.max((F.col("partition") == "development").cast("int")).alias("_in_dev"),
            F.count("*").alias("_group_rows"),
        )
    )
    spread = F.col("pos") if "pos" in split.columns else F.struct(*split.columns)
    joined = attach_facts(split, dev_groups, group, "_group_rows", spread, "left")
    return joined.withColumn(
        "purged",
        (F.col("partition") == "test") & (F.coalesce(F.col("_in_dev"), F.lit(0)) == 1),
    ).drop("_in_dev", "_group_rows")


def fold_bounds(k: int, n_rows: Column) -> Column:
    """ARRAY of (fold, start, stop): validation window of each expanding fold."""
    size = F.floor(n_rows / F.lit(k + 1)).cast("bigint")
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("fold"),
                (n_rows - (k - i + 1) * size).alias("start"),
                (n_rows - (k - i) * size).alias("stop"),
            )
            for i in range(1, k + 1)
        ]
    )


def held_fold(k: int) -> Column:
    """The fold in whose validation window a row lies, 0 before the first window."""
    bounds = fold_bounds(k, F.col("n_rows"))
    return sum((F.col("pos") >= bounds[i]["start"]).cast("int") for i in range(k))


def groups_across_folds(positioned: DataFrame, k: int, group: str) -> DataFrame:
    """Groups with rows in more than one window, with ``_first_fold``, the earliest of these.

    Only they can leak from train into validation, and there are far fewer than groups. A row
    without a group is a group of its own.
    """
    return (
        positioned.filter(F.col(group).isNotNull())
        .select(F.col(group).alias(group), held_fold(k).alias("_fold"))
        .groupBy(group)
        .agg(
            F.min("_fold").alias("_first_fold"),
            F.max("_fold").alias("_last_fold"),
            F.count("*").alias("_group_rows"),
        )
        .filter(F.col("_first_fold") < F.col("_last_fold"))
        .select(group, "_first_fold", "_group_rows")
    )


def with_first_fold(df: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Add ``_first_fold`` of the row's group, null unless the group is in several windows."""
    return attach_facts(df, groups, group, "_group_rows", F.col("pos"), "left").drop("_group_rows")


def expanding_folds(
    positioned: DataFrame, k: int = 3, group: str | None = "duplicate_group"
) -> DataFrame:
    """One row per (row, fold, role). Validation rows of a group seen in train are dropped."""
    base = positioned
    if group:
        base = with_first_fold(base, groups_across_folds(positioned, k, group), group)
    exploded = (
        base.withColumn("_bound", F.explode(fold_bounds(k, F.col("n_rows"))))
        .filter(F.col("pos") < F.col("_bound.stop"))
        .withColumn("fold", F.col("_bound.fold"))
        .withColumn(
            "role",
            F.when(F.col("pos") < F.col("_bound.start"), "train").otherwise("validation"),
        )
    )
    if group:
        exploded = exploded.filter(
            (F.col("role") == "train")
            | F.col("_first_fold").isNull()
            | (F.col("_first_fold") >= F.col("fold"))
        ).drop("_first_fold")
    return exploded.drop("_bound")


def validation_rows(df: DataFrame, groups: DataFrame, k: int, group: str) -> DataFrame:
    """The validation rows of :func:`expanding_folds`, each in its one fold, without train rows.

    ``groups`` comes from :func:`groups_across_folds` over all positions.
    """
    held = df.withColumn("fold", held_fold(k)).filter(F.col("fold") > 0)
    return (
        with_first_fold(held, groups, group)
        .filter(F.col("_first_fold").isNull() | (F.col("_first_fold") >= F.col("fold")))
        .drop("_first_fold")
    )


def check_folds(folds: DataFrame, k: int) -> DataFrame:
    """Refuse a fold plan in which some fold has no validation row."""
    found = folds.filter(F.col("role") == "validation").select("fold").distinct().count()
    if found != k:
        raise ValueError("Duplicate purge removed an entire validation fold")
    return folds


def _hash_order(key: str, seed: int) -> list[Column]:
    """Seeded pseudo-random order that any engine can reproduce."""
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))), F.col(key)]


def with_label_position(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Position in seeded hash order inside each label, without a per-label window."""
    shuffled = df.withColumn("_shuffle", _hash_order(key, seed)[0])
    return with_position(shuffled, ["_shuffle", key], scope=label).drop("_shuffle")


def stratified_holdout(
    df: DataFrame, key: str, label: str, fraction: float = 0.8, seed: int = 42
) -> DataFrame:
    positioned = with_label_position(df, key, label, seed)
    dev = F.col("pos") < F.round(F.col("n_rows") * F.lit(float(fraction)))
    return positioned.withColumn("partition", F.when(dev, "development").otherwise("test"))


def stratified_folds(
    df: DataFrame, key: str, label: str, k: int = 3, seed: int = 42
) -> DataFrame:
    positioned = with_label_position(df, key, label, seed)
    return positioned.withColumn("fold", (F.col("pos") % k + 1).cast("int"))


def learning_subsets(
    positioned: DataFrame, fractions: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0)
) -> DataFrame:
    """Rows of every chronological prefix, keyed by ``fraction``."""
    if not fractions or any(f <= 0 or f > 1 for f in fractions):
        raise ValueError("Learning fractions must be in (0, 1]")
    limits = F.array(
        *[
            F.struct(
                F.lit(float(f)).alias("fraction"),
                F.greatest(F.lit(4), F.floor(F.col("n_rows") * F.lit(float(f)))).alias("limit"),
            )
            for f in fractions
        ]
    )
    return (
        positioned.withColumn("_limit", F.explode(limits))
        .filter(F.col("pos") < F.col("_limit.limit"))
        .withColumn("fraction", F.col("_limit.fraction"))
        .drop("_limit")
    )


def inner_folds(positioned: DataFrame, label: str, labels: list[str], group: str) -> DataFrame:
    """Two expanding folds whose sides hold every label, else one 75/25 cut."""
    folds = expanding_folds(positioned, 2, group)
    covered = (
        folds.groupBy("fold", "role")
        .agg(F.count_distinct(F.when(F.col(label).isin(labels), F.col(label))).alias("_n"))
        .groupBy("fold")
        .agg(F.min("_n").alias("_least"), F.count("*").alias("_sides"))
        .filter((F.col("_least") == len(labels)) & (F.col("_sides") == 2))
        .select("fold")
    )
    usable = [r["fold"] for r in covered.collect()]  # at most two rows
    if usable:
        return folds.filter(F.col("fold").isin(usable))
    boundary = F.greatest(F.lit(1), F.floor(F.col("n_rows") * F.lit(0.75)))
    fallback = positioned.withColumn("fold", F.lit(1)).withColumn(
        "role", F.when(F.col("pos") < boundary, "train").otherwise("validation")
    )
    present = (
        fallback.filter((F.col("role") == "train") & F.col(label).isin(labels))
        .agg(F.count_distinct(label).alias("n"))
        .first()["n"]
    )
    if present != len(labels):
        raise ValueError("Insufficient inner class support")
    return fallback


def row_set_fingerprints(folds: DataFrame, key: str) -> DataFrame:
    """Order-free fingerprint of every fold side: row count, xor and sum of row hashes.

    The hash is the low 60 bits of an MD5, so another engine can recompute it.
    """
    text = F.concat(F.col("pos").cast("string"), F.lit(":"), F.col(key).cast("string"))
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return (
        folds.withColumn("_digest", digest)
        .groupBy("fold", "role")
        .agg(
            F.count("*").alias("rows"),
            F.bit_xor("_digest").alias("row_set_xor"),
        )
    )


def verify_fingerprints(actual: DataFrame, expected: DataFrame) -> None:
    """Refuse folds whose row sets differ from a stored fingerprint table."""
    _fail_if_any(
        actual.exceptAll(expected.select(*actual.columns)), "Fold membership differs"
    )


def leave_one_project_out(df: DataFrame, project: str, group: str) -> DataFrame:
    """Each project is the test side once; groups shared with other projects are purged.

    A group leaks into a project's test side exactly when it spans more than one project; a row
    without a group is never purged.
    """
    spans = (
        df.filter(F.col(group).isNotNull())
        .groupBy(F.col(group).alias(group))
        .agg(F.min(project).alias("_low"), F.max(project).alias("_high"), F.count("*").alias("_n"))
    )
    marked = attach_facts(df, spans, group, "_n", F.struct(*df.columns), "left")
    return marked.withColumn(
        "purged", F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))
    ).drop("_low", "_high", "_n")


def shuffled_labels(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Permute labels over rows: row i of one hash order takes the label of row i of another."""
    left = df.withColumn("_shuffle", _hash_order(key, seed)[0])
    right = df.withColumn("_shuffle", _hash_order(key, seed + 1)[0])
    rows = with_position(left.drop(label), ["_shuffle", key]).drop("_shuffle", "n_rows")
    labels = with_position(right.select(key, label, "_shuffle"), ["_shuffle", key]).select(
        "pos", label
    )
    return rows.join(labels, "pos").drop("pos")


def class_counts(df: DataFrame, side: list[str], label: str, labels: list[str]) -> DataFrame:
    """Counts per side over a fixed label list, zeros included."""
    counts = df.groupBy(*side, F.col(label).alias("severity")).agg(F.count("*").alias("_n"))
    dense = counts.groupBy(*side).agg(
        F.map_from_entries(
            F.collect_list(
                F.when(F.col("severity").isin(labels), F.struct("severity", "_n"))
            )
        ).alias("_counts"),
        F.sum("_n").alias("side_rows"),
    )
    return dense.select(
        *side,
        F.explode(F.array(*[F.lit(x) for x in labels])).alias("severity"),
        "_counts",
        "side_rows",
    ).select(
        *side,
        "severity",
        F.coalesce(F.try_element_at("_counts", F.col("severity")), F.lit(0)).alias("count"),
        "side_rows",
    )


def coverage_gaps(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("count") == 0)


def require_coverage(counts: DataFrame) -> DataFrame:
    _fail_if_any(coverage_gaps(counts), "A side lacks a fixed class")
    return counts
