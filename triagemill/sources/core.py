"""The core layer: row builder, contract checks, Parquet sink, manifest, fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagemill.constants import (
    CORE_COLUMNS,
    FORBIDDEN_COLUMNS,
    INELIGIBLE_PREDICTORS,
    LABEL_EXCLUSIONS,
)
from triagemill.functions.labels import normalize_label
from triagemill.functions.text import exact_text_hash, strip, text_or_empty
from triagemill.session import materialize

_BOOLEAN = {c for c in CORE_COLUMNS if c.startswith(("has_", "is_"))}
CORE_SCHEMA = T.StructType(
    [
        T.StructField(
            c,
            T.BooleanType()
            if c in _BOOLEAN
            else T.TimestampType()
            if c == "creation_time"
            else T.StringType(),
        )
        for c in CORE_COLUMNS
    ]
)


def core_rows(
    raw: DataFrame,
    project: Column,
    source_file: Column,
    exclusions: list[str] = LABEL_EXCLUSIONS,
) -> DataFrame:
    """Build the 20-column layer from canonical raw columns. Never drops a row."""
    have = set(raw.columns)

    def text(name: str) -> Column:
        return text_or_empty(F.col(name)) if name in have else F.lit("")

    time = F.col("creation_time")
    if isinstance(raw.schema["creation_time"].dataType, T.StringType):
        time = F.try_to_timestamp(time)
    issue_id = strip(text("issue_id"))
    key = F.concat(project, F.lit(":"), issue_id)
    label = normalize_label(text("severity"))
    link = strip(text("dupe_of"))
    has_summary = strip(text("summary")) != ""
    has_description = strip(text("description")) != ""
    return raw.select(
        text("issue_url").alias("issue_url"),
        issue_id.alias("issue_id"),
        project.alias("source_project"),
        source_file.alias("source_file"),
        key.alias("global_report_key"),
        text("product").alias("product"),
        text("component").alias("component"),
        text("summary").alias("summary"),
        text("description").alias("description"),
        text("severity").alias("severity"),
        time.cast("timestamp").alias("creation_time"),
        text("dupe_of").alias("dupe_of"),
        has_summary.alias("has_valid_summary"),
        has_description.alias("has_valid_description"),
        (has_summary | has_description).alias("has_valid_text"),
        (label != "").alias("has_valid_severity"),
        label.isin([x.strip().lower() for x in exclusions]).alias("is_excluded_label"),
        time.isNotNull().alias("has_valid_creation_time"),
        exact_text_hash(text("summary"), text("description")).alias("exact_text_hash"),
        F.when(link != "", F.concat(project, F.lit(":"), link))
        .otherwise(key)
        .alias("duplicate_group_id"),
    )


def check_core_schema(df: DataFrame) -> DataFrame:
    """Schema half of the contract; needs no job."""
    forbidden = sorted(set(df.columns) & set(FORBIDDEN_COLUMNS))
    if forbidden:
        raise ValueError(f"Forbidden columns in the core layer: {forbidden}")
    missing = sorted(set(CORE_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"Core layer lacks columns: {missing}")
    if not isinstance(df.schema["issue_id"].dataType, T.StringType):
        raise ValueError("issue_id must be a string")
    if not isinstance(df.schema["creation_time"].dataType, T.TimestampType):
        raise ValueError("creation_time must be a UTC timestamp")
    return df


def contract_facts(df: DataFrame) -> DataFrame:
    """Per partition: rows, distinct projects in the rows and distinct source files."""
    return (
        check_core_schema(df)
        .groupBy("source_project")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct("source_file").alias("source_files"),
            F.min("source_file").alias("source_file"),
            F.count_if(
                ~F.startswith("global_report_key", F.concat("source_project", F.lit(":")))
            ).alias("foreign_keys"),
        )
    )


def check_contract(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Refuse partitions that differ from ``expected(source_project, source_file, rows)``."""
    facts = contract_facts(df)
    bad = (
        facts.alias("f")
        .join(expected.alias("e"), "source_project", "full_outer")
        .filter(
            ~F.col("f.rows").eqNullSafe(F.col("e.rows"))
            | ~F.col("f.source_file").eqNullSafe(F.col("e.source_file"))
            | (F.col("source_files") != 1)
            | (F.col("foreign_keys") != 0)
        )
        .limit(5)
        .collect()
    )
    if bad:
        raise ValueError(f"Core layer contract violated: {[r['source_project'] for r in bad]}")
    return facts


def eligible_predictors(requested: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Judge requested predictor names against the eligibility table.

    ``requested(name)``; ``eligibility(normalized_name, eligibility_status)``.
    """
    banned = [name.lower() for name in INELIGIBLE_PREDICTORS]
    named = requested.select(F.lower(strip(F.col("name"))).alias("normalized_name")).distinct()
    return named.join(eligibility, "normalized_name", "left").select(
        "normalized_name",
        (
            ~F.col("normalized_name").isin(banned)
            & (F.coalesce(F.col("eligibility_status"), F.lit("")) == "PRIMARY_ELIGIBLE")
        ).alias("allowed"),
    )


def require_predictors(requested: DataFrame, eligibility: DataFrame) -> None:
    refused = eligible_predictors(requested, eligibility).filter(~F.col("allowed"))
    names = [r["normalized_name"] for r in refused.limit(20).collect()]
    if names:
        raise ValueError(f"Ineligible predictors: {sorted(names)}")


def write_core(df: DataFrame, path: str, max_records_per_file: int = 5_000_000) -> None:
    """Replace the partitions present in ``df``; other projects stay untouched.

    No shuffle by project: a project with a third of all rows would land in one task.
    """
    (
        check_core_schema(df)
        .select(*CORE_COLUMNS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("source_project")
        .parquet(path)
    )


def read_core(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(CORE_SCHEMA).parquet(path)
    return df.select(*(columns or CORE_COLUMNS))


def write_once(df: DataFrame, path: str) -> None:
    """Study results refuse to overwrite."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def config_fingerprint(exclusions: list[str] = LABEL_EXCLUSIONS) -> str:
    payload = {
        "core_columns": CORE_COLUMNS,
        "label_exclusions": exclusions,
        "schema_version": 1,
    }
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def row_digest(columns: list[str]) -> Column:
    """60-bit row hash that another engine can recompute."""
    text = F.concat_ws(
        "\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    )
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def source_fingerprints(raw: DataFrame, project: str, columns: list[str]) -> DataFrame:
    """Order-free content fingerprint of every source."""
    return (
        raw.select(F.col(project).alias("source_project"), row_digest(columns).alias("_digest"))
        .groupBy("source_project")
        .agg(F.count("*").alias("row_count"), F.bit_xor("_digest").alias("content_xor"))
        .withColumn(
            "content_fingerprint",
            F.concat_ws(":", F.col("row_count"), F.col("content_xor")),
        )
    )


def changed_sources(
    current: DataFrame, manifest: DataFrame, config_fp: str, force: bool = False
) -> DataFrame:
    """Decision per source: ``skipped_unchanged``, ``built`` or ``rebuilt``."""
    known = manifest.filter(F.col("completion_status") == "complete").select(
        "source_project",
        F.col("content_fingerprint").alias("_known_fp"),
        F.col("configuration_fingerprint").alias("_known_config"),
    )
    same = (F.col("content_fingerprint") == F.col("_known_fp")) & (
        F.col("_known_config") == F.lit(config_fp)
    )
    unchanged = F.coalesce(same, F.lit(False)) & F.lit(not force)
    return current.join(known, "source_project", "left").select(
        "source_project",
        "content_fingerprint",
        F.when(unchanged, "skipped_unchanged")
        .otherwise("rebuilt" if force else "built")
        .alias("resume_status"),
    )


def _row_states(raw: DataFrame, project: str, key: str, columns: list[str]) -> DataFrame:
    """source_project, row_key, state: what a key holds, however often and in whatever order."""
    return (
        raw.select(
            F.col(project).alias("source_project"),
            F.col(key).cast("string").alias("row_key"),
            row_digest(columns).cast("decimal(38,0)").alias("_digest"),
        )
        .groupBy("source_project", "row_key")
        .agg(F.concat_ws(":", F.count("*"), F.sum("_digest")).alias("state"))
    )


def _project_states(states: DataFrame) -> DataFrame:
    digest = F.xxhash64("row_key", "state").cast("decimal(38,0)")
    return states.groupBy("source_project").agg(
        F.count("*").alias("keys"), F.concat_ws(":", F.count("*"), F.sum(digest)).alias("content_state")
    )


def store_build(
    raw: DataFrame,
    path: str,
    project: str,
    key: str,
    columns: list[str],
    config_fp: Column | str,
    status: Column | str = "complete",
) -> None:
    """Write what ``build_delta`` compares a later state with: row states, then the projects' states.

    The second table is written last: a build that was broken off has none and counts as no build.
    """
    _row_states(raw, project, key, columns).write.mode("errorifexists").parquet(f"{path}/rows")
    states = raw.sparkSession.read.parquet(f"{path}/rows")
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    _project_states(states).select(
        "*",
        as_column(config_fp).alias("configuration_fingerprint"),
        as_column(status).alias("completion_status"),
    ).write.mode("errorifexists").parquet(f"{path}/projects")


def build_delta(
    raw: DataFrame, path: str, project: str, key: str, columns: list[str], config_fp: str
) -> DataFrame:
    """What a build has to do about every project, against the build stored under ``path``.

    ``resume_status``: 'built' (new), 'lost', 'resumed' (the stored build of it is incomplete),
    'rebuilt' (other configuration), 'changed' or 'skipped_unchanged'; and the keys that were added,
    changed, lost or stayed the same. Projects whose state is unchanged are settled by their sums;
    only the rows of the others meet. Null projects are one project.
    """
    spark = raw.sparkSession
    now = materialize(_row_states(raw, project, key, columns), "row-states")
    try:
        known = spark.read.parquet(f"{path}/projects")
        before = spark.read.parquet(f"{path}/rows")
    except AnalysisException:
        known = _project_states(now.limit(0)).select(
            "*", F.lit("").alias("configuration_fingerprint"), F.lit("").alias("completion_status")
        )
        before = now.limit(0)
    n, k = _project_states(now).alias("n"), known.alias("k")
    both = n.join(k, F.col("n.source_project").eqNullSafe(F.col("k.source_project")), "full_outer")
    status = (
        F.when(F.col("k.keys").isNull(), "built")
        .when(F.col("n.keys").isNull(), "lost")
        .when(F.col("k.completion_status") != "complete", "resumed")
        .when(F.col("k.configuration_fingerprint") != config_fp, "rebuilt")
        .when(F.col("n.content_state") != F.col("k.content_state"), "changed")
        .otherwise("skipped_unchanged")
    )
    # a row for each project
    decided = materialize(
        both.select(
            F.coalesce("n.source_project", "k.source_project").alias("source_project"),
            status.alias("resume_status"),
            F.coalesce("n.keys", "k.keys").alias("keys"),
        ),
        "decisions",
    )
    open_ = decided.filter("resume_status <> 'skipped_unchanged'").select(
        F.col("source_project").alias("_project")
    )

    def touched(states: DataFrame) -> DataFrame:
        return states.join(open_, F.col("source_project").eqNullSafe(F.col("_project")), "left_semi")

    a, b = touched(now).alias("a"), touched(before).alias("b")
    same_key = F.col("a.source_project").eqNullSafe(F.col("b.source_project")) & F.col(
        "a.row_key"
    ).eqNullSafe(F.col("b.row_key"))
    left, right = F.col("a.state"), F.col("b.state")
    rows = a.join(b, same_key, "full_outer").groupBy(
        F.coalesce("a.source_project", "b.source_project").alias("_project")
    )
    counted = rows.agg(
        F.count_if(right.isNull()).alias("added"),
        F.count_if(left.isNotNull() & right.isNotNull() & (left != right)).alias("changed"),
        F.count_if(left.isNull()).alias("lost"),
        F.count_if(left == right).alias("same"),
    )
    skipped = F.col("resume_status") == "skipped_unchanged"
    zero = F.lit(0).cast("long")
    return decided.join(
        counted, F.col("source_project").eqNullSafe(F.col("_project")), "left"
    ).select(
        "source_project",
        "resume_status",
        *[F.coalesce(c, zero).alias(c) for c in ("added", "changed", "lost")],
        F.when(skipped, F.col("keys")).otherwise(F.coalesce("same", zero)).alias("same"),
    )


def unchanged_guard(before: DataFrame, after: DataFrame) -> None:
    """Refuse when a source changed between two fingerprint tables."""
    columns = ["source_project", "content_fingerprint"]
    moved = before.select(*columns).exceptAll(after.select(*columns)).limit(5).collect()
    if moved:
        raise ValueError(f"Raw source changed: {[r['source_project'] for r in moved]}")


def manifest(core: DataFrame, config_fp: str) -> DataFrame:
    """One row per project with counters, label distribution and status."""
    label = normalize_label(F.col("severity"))
    per_label = (
        core.groupBy("source_project", label.alias("_label"))
        .agg(
            F.count("*").alias("_n"),
            F.count_if(~F.col("has_valid_text")).alias("_no_text"),
            F.count_if(~F.col("has_valid_creation_time")).alias("_no_time"),
        )
        .groupBy("source_project")
        .agg(
            F.sum("_n").alias("raw_row_count"),
            F.sum("_n").alias("output_row_count"),
            F.sum("_no_text").alias("missing_text_count"),
            F.sum("_no_time").alias("invalid_date_count"),
            F.to_json(
                F.map_from_entries(F.array_sort(F.collect_list(F.struct("_label", "_n"))))
            ).alias("severity_distribution"),
        )
    )
    repeats = (
        core.groupBy("source_project", "exact_text_hash")
        .agg((F.count("*") - 1).alias("_extra"))
        .groupBy("source_project")
        .agg(F.sum("_extra").alias("exact_duplicate_row_count"))
    )
    return per_label.join(repeats, "source_project").select(
        "*",
        F.lit(config_fp).alias("configuration_fingerprint"),
        F.lit("complete").alias("completion_status"),
    )


def provenance(run: DataFrame, manifest_table: DataFrame) -> DataFrame:
    """Attach source facts of the manifest to a run's rows by project."""
    return run.join(
        manifest_table.select(
            "source_project", "content_fingerprint", "configuration_fingerprint"
        ),
        "source_project",
        "left",
    )
