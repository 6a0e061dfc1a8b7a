"""Which reports may enter a modelling view, and why the others may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.constants import LABEL_EXCLUSIONS, LABELS
from triagemill.functions.labels import grouped_label, normalize_label
from triagemill.functions.text import is_blank, text_or_empty


def filter_labels(
    df: DataFrame, label: str, exclusions: list[str] = LABEL_EXCLUSIONS
) -> DataFrame:
    """Normalize the label and keep rows that are neither blank nor excluded."""
    banned = [x.strip().lower() for x in exclusions]
    normalized = df.withColumn(label, normalize_label(F.col(label)))
    return normalized.filter((F.col(label) != "") & ~F.col(label).isin(banned))


def filter_dataset(
    df: DataFrame,
    label: str,
    text_columns: list[str],
    exclusions: list[str] = LABEL_EXCLUSIONS,
    groups: dict | None = None,
) -> DataFrame:
    out = ensure_text(df, text_columns)
    out = filter_labels(out, label, exclusions)
    return out.withColumn(label, grouped_label(F.col(label), groups)) if groups else out


def ensure_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns(
        {
            c: text_or_empty(F.col(c)) if c in df.columns else F.lit("")
            for c in columns
        }
    )


def coerce_time(df: DataFrame, column: str) -> DataFrame:
    """Parse text to a UTC timestamp; what does not parse becomes NULL."""
    return df.withColumn(column, F.try_to_timestamp(F.col(column).cast("string")))


def eligibility_flags(
    labels: list[str] = LABELS, exclusions: list[str] = LABEL_EXCLUSIONS
) -> dict[str, Column]:
    label = normalize_label(F.col("severity"))
    banned = [x.strip().lower() for x in exclusions]
    blank = label == ""
    excluded = label.isin(banned)
    unexpected = ~blank & ~excluded & ~label.isin(labels)
    bad_date = F.col("creation_time").isNull()
    bad_text = is_blank(F.col("summary")) & is_blank(F.col("description"))
    return {
        "is_blank_label": blank,
        "is_excluded": excluded,
        "is_unexpected": unexpected,
        "is_bad_date": bad_date,
        "is_bad_text": bad_text,
        "is_eligible": ~(blank | excluded | unexpected | bad_date | bad_text),
    }


def eligible_reports(
    core: DataFrame, labels: list[str] = LABELS, exclusions: list[str] = LABEL_EXCLUSIONS
) -> DataFrame:
    keep = eligibility_flags(labels, exclusions)["is_eligible"]
    return core.filter(keep).withColumn("severity", normalize_label(F.col("severity")))


def eligibility_summary(
    core: DataFrame, labels: list[str] = LABELS, exclusions: list[str] = LABEL_EXCLUSIONS
) -> DataFrame:
    """Counts per reason, each on its own, plus the effect of deduplication.

    Two levels: rows collapse to one row per text hash first, so that no hash group has to
    be held together and the final aggregate is a plain sum.
    """
    flags = eligibility_flags(labels, exclusions)
    label = normalize_label(F.col("severity"))
    per_hash = (
        core.withColumns(flags)
        .withColumn("_label", label)
        .groupBy("exact_text_hash")
        .agg(
            F.count("*").alias("_rows"),
            *[F.count_if(F.col(c)).alias(c) for c in flags],
            F.min(F.when(F.col("is_eligible"), F.col("_label"))).alias("_low"),
            F.max(F.when(F.col("is_eligible"), F.col("_label"))).alias("_high"),
        )
    )
    later = F.greatest(F.col("is_eligible") - 1, F.lit(0))
    return per_hash.agg(
        F.sum("_rows").alias("raw_core_rows"),
        F.sum("is_blank_label").alias("missing_or_blank_label_rows"),
        F.sum("is_excluded").alias("configured_excluded_label_rows"),
        F.sum("is_unexpected").alias("unexpected_or_unmapped_label_rows"),
        F.sum("is_bad_date").alias("invalid_creation_time_rows"),
        F.sum("is_bad_text").alias("invalid_text_rows"),
        F.sum("is_eligible").alias("eligible_before_exact_deduplication"),
        F.sum(later).alias("later_exact_duplicates_removed"),
        F.count_if(F.col("_low") != F.col("_high")).alias("conflicting_exact_text_groups"),
        F.sum(F.col("is_eligible") - later).alias(
            "modeling_rows_after_filtering_and_deduplication"
        ),
    )


def exclude_ids(df: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    """Drop rows listed in ``excluded`` (a sensitivity run without known conflicts)."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def retained_levels(train: DataFrame, column: str, minimum: int = 5) -> DataFrame:
    """Category levels frequent enough in training; NULL counts as its own level."""
    level = F.coalesce(F.col(column).cast("string"), F.lit("[MISSING]"))
    return (
        train.groupBy(level.alias("level"))
        .agg(F.count("*").alias("level_rows"))
        .filter(F.col("level_rows") >= minimum)
    )


def apply_rare_levels(df: DataFrame, column: str, retained: DataFrame, key: str) -> DataFrame:
    """Levels not retained, unseen ones included, become ``[RARE]``."""
    from triagemill.operators.skew import attach_facts

    level = F.coalesce(F.col(column).cast("string"), F.lit("[MISSING]"))
    facts = retained.withColumn("_kept", F.lit(True)).withColumnRenamed("level", "_level")
    marked = attach_facts(
        df.withColumn("_level", level), facts, "_level", "level_rows", F.col(key), "left"
    )
    return marked.withColumn(
        column, F.when(F.col("_kept"), F.col("_level")).otherwise("[RARE]")
    ).drop("_level", "_kept", "level_rows")
