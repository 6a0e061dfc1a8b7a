"""Column names: normalization, alias resolution, audits and lineage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.constants import CORE_ALIASES, FORBIDDEN_COLUMNS, REQUIRED_FIELDS

_SUFFIX = "_dataset_issues"


def normalize_name(name: str) -> str:
    name = name.lstrip("﻿").strip().lower()
    return re.sub(r"[^a-z0-9]+", "_", name).strip("_")


def normalize_name_column(name: Column) -> Column:
    """The same normalization as an expression, for tables of names."""
    lowered = F.lower(F.trim(F.ltrim(name, F.lit("﻿"))))
    return F.btrim(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


def resolve_lenient(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Canonical name -> column; the canonical name first, then aliases, first hit wins."""
    by_name = {normalize_name(c): c for c in columns}
    found = {}
    for canonical, names in aliases.items():
        hits = [by_name[normalize_name(n)] for n in [canonical, *names]
                if normalize_name(n) in by_name]
        if hits:
            found[canonical] = hits[0]
    return found


def rename_lenient(df: DataFrame, aliases: dict[str, list[str]] = CORE_ALIASES) -> DataFrame:
    normalized = normalize_columns(df)
    mapping = resolve_lenient(normalized.columns, aliases)
    return normalized.withColumnsRenamed({v: k for k, v in mapping.items()})


def alias_table(spark: SparkSession, aliases: dict[str, list[str]] = CORE_ALIASES) -> DataFrame:
    rows = sorted(
        {(c, normalize_name(n)) for c, names in aliases.items() for n in [c, *names]}
    )
    return spark.createDataFrame(rows, "canonical string, normalized_name string")


def resolve_strict(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per (source, canonical): the candidate columns; more than one is ambiguous.

    ``names(source_project, raw_name)`` holds one row per source and column.
    """
    return (
        names.withColumn("normalized_name", normalize_name_column(F.col("raw_name")))
        .join(F.broadcast(aliases), "normalized_name")
        .groupBy("source_project", "canonical")
        .agg(F.array_sort(F.collect_set("raw_name")).alias("candidates"))
        .withColumn("is_ambiguous", F.size("candidates") > 1)
    )


def audit_schemas(names: DataFrame, aliases: DataFrame, probe: DataFrame) -> DataFrame:
    """PASS / FAIL per source with what is missing, ambiguous and mapped.

    ``probe(source_project, sample_rows_read)`` says how many of two probe rows parsed.
    """
    resolved = resolve_strict(names, aliases)
    per_source = resolved.groupBy("source_project").agg(
        F.array_sort(F.collect_set("canonical")).alias("_found"),
        F.array_sort(
            F.collect_set(F.when(F.col("is_ambiguous"), F.col("canonical")))
        ).alias("_ambiguous"),
        F.array_sort(
            F.collect_list(
                F.when(
                    ~F.col("is_ambiguous"),
                    F.concat("canonical", F.lit("="), F.col("candidates")[0]),
                )
            )
        ).alias("_mapped"),
    )
    missing = F.array_except(F.array(*[F.lit(c) for c in sorted(REQUIRED_FIELDS)]), "_found")
    ok = (F.size(missing) == 0) & (F.size("_ambiguous") == 0)
    return per_source.join(probe, "source_project", "left").select(
        "source_project",
        F.array_join(missing, ",").alias("missing_required_columns"),
        F.array_join("_ambiguous", ",").alias("ambiguous_columns"),
        F.array_join("_mapped", ",").alias("column_mappings"),
        F.when(ok, F.col("sample_rows_read")).otherwise(0).cast("bigint").alias(
            "sample_rows_read"
        ),
        F.when(ok, "PASS").otherwise("FAIL").alias("audit_status"),
    )


def require_mapping(columns: list[str], aliases: dict[str, list[str]] = CORE_ALIASES) -> dict:
    """Strict mapping of one header; refuses missing and ambiguous fields."""
    by_name: dict[str, list[str]] = {}
    for c in columns:
        by_name.setdefault(normalize_name(c), []).append(c)
    mapping, ambiguous = {}, {}
    for canonical, names in aliases.items():
        hits = sorted({c for n in [canonical, *names] for c in by_name.get(normalize_name(n), [])})
        if len(hits) == 1:
            mapping[canonical] = hits[0]
        elif hits:
            ambiguous[canonical] = hits
    missing = sorted(set(REQUIRED_FIELDS) - set(mapping) - set(ambiguous))
    if missing or ambiguous:
        raise ValueError(f"Schema audit failed: missing={missing}, ambiguous={ambiguous}")
    return mapping


def project_of_file(file_name: Column) -> Column:
    """Source project of an export's file name."""
    base = F.regexp_extract(file_name, r"([^/]+)$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"\.[^.]+$", ""), rf"(?i){_SUFFIX}$", "")


def lineage(names: DataFrame, aliases: DataFrame, forbidden=tuple(FORBIDDEN_COLUMNS)) -> DataFrame:
    """What becomes of every raw column: retained, forbidden or left out."""
    tagged = names.withColumn("normalized_name", normalize_name_column(F.col("raw_name")))
    return tagged.join(F.broadcast(aliases), "normalized_name", "left").select(
        "raw_name",
        F.when(F.col("canonical").isNotNull(), "retained")
        .when(F.col("normalized_name").isin(list(forbidden)), "forbidden")
        .otherwise("left_out")
        .alias("lineage"),
    ).distinct()


def column_fill(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Rows with a non-empty value per column, in one pass over the table."""
    counted = df.groupBy(*by).agg(
        *[
            F.count_if(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "").alias(f"_n{i}")
            for i, c in enumerate(columns)
        ]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("raw_name"), F.col(f"_n{i}").alias("filled_rows"))
            for i, c in enumerate(columns)
        ]
    )
    return counted.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")
