"""Sources, sinks and schema operators as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagemill.constants import CORE_ALIASES, SPLIT_COLUMNS
from triagemill.functions.text import redact
from triagemill.plans.oracle_views import NWS, digest, in_list, norm
from triagemill.plans.registry import query, rounded
from triagemill.session import new_table_path
from triagemill.sources import exports, schema, views
from triagemill.sources.core import (
    build_delta,
    changed_sources,
    config_fingerprint,
    contract_facts,
    eligible_predictors,
    manifest,
    provenance,
    read_core,
    source_fingerprints,
    store_build,
    unchanged_guard,
    write_core,
    write_once,
)

RAW_NAMES = {
    "issue_url": "Issue URL",
    "issue_id": "ID",
    "product": "Product",
    "component": "Component",
    "summary": "Summary",
    "description": "Description",
    "severity": "Severity",
    "creation_time": "Creation time",
    "dupe_of": "Dupe of",
}
EXTRA_NAMES = ["Comments", "Status", "Whiteboard"]
FINGERPRINT_COLUMNS = ["issue_id", "summary", "description", "severity", "dupe_of"]


def raw_export(spark, sf_dir):
    """The reports under the headers of a tracker export, extra columns included."""
    df = views.reports(spark, sf_dir)
    return df.select(
        "source_project",
        F.concat(F.lit("https://tracker.example/"), "issue_id").alias("Issue URL"),
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(RAW_NAMES[c])
            for c in RAW_NAMES
            if c != "issue_url"
        ],
        F.col("description").alias("Comments"),
        F.when(F.col("doc_key") % 2 == 0, "NEW").otherwise("").alias("Status"),
        F.lit("").alias("Whiteboard"),
    )


def raw_columns():
    return [*RAW_NAMES.values(), *EXTRA_NAMES]


def core_layer(spark, sf_dir) -> str:
    """Path of the written core layer, built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, "core_layer_path")
    if key not in views._memo:
        path = new_table_path(spark, "core")
        write_core(views.core(spark, sf_dir), path)
        views._memo[key] = path
    return views._memo[key]


@query(
    "src1",
    "SELECT issue_id, product, component, severity, dupe_of, CAST(length(summary) AS BIGINT) AS summary_chars,"
    " sha256(description) AS description_hash,"
    " coalesce(CAST(creation_time AS VARCHAR), '') AS creation_time FROM v_reports",
)
def src1(spark, sf_dir):
    """Write the export as CSV, scan it back by glob through strict header resolution."""
    folder = new_table_path(spark, "export")
    exports.write_csv(raw_export(spark, sf_dir).drop("source_project"), f"{folder}/all_issues.csv")
    sources = exports.resolve_sources(spark, glob=f"{folder}/*_issues.csv")
    scanned = exports.scan_exports(spark, sources)
    return scanned.select(
        "issue_id",
        "product",
        "component",
        "severity",
        "dupe_of",
        F.length("summary").cast("bigint").alias("summary_chars"),
        F.sha2("description", 256).alias("description_hash"),
        "creation_time",
    )


@query(
    "src2",
    "SELECT source_project, severity, CAST(creation_time AS VARCHAR) AS creation_time FROM v_core",
)
def src2(spark, sf_dir):
    """Core scan with projection: only three columns reach the reader."""
    df = read_core(
        spark, core_layer(spark, sf_dir), ["source_project", "severity", "creation_time"]
    )
    return rounded(df)


@query(
    "src3",
    "SELECT source_project, count(*) AS rows, count(DISTINCT exact_text_hash) AS texts,"
    " count(*) FILTER (WHERE creation_time IS NULL) AS undated FROM v_core GROUP BY 1",
)
def src3(spark, sf_dir):
    """Partitioned, zstd, replaced per project; status by reading back."""
    path = new_table_path(spark, "core")
    df = views.core(spark, sf_dir)
    write_core(df, path)
    return (
        read_core(spark, path)
        .groupBy("source_project")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct("exact_text_hash").alias("texts"),
            F.count_if(F.col("creation_time").isNull()).alias("undated"),
        )
    )


MANIFEST_SQL = f"""
WITH per_label AS (
  SELECT source_project, {norm('severity')} AS label, count(*) AS n,
    count(*) FILTER (WHERE NOT has_valid_text) AS no_text,
    count(*) FILTER (WHERE NOT has_valid_creation_time) AS no_time FROM v_core GROUP BY ALL),
repeats AS (
  SELECT source_project, CAST(sum(n - 1) AS BIGINT) AS extra
  FROM (SELECT source_project, exact_text_hash, count(*) AS n FROM v_core GROUP BY ALL) GROUP BY 1)
SELECT p.source_project, CAST(sum(n) AS BIGINT) AS raw_row_count, CAST(sum(n) AS BIGINT) AS output_row_count,
  CAST(sum(no_text) AS BIGINT) AS missing_text_count, CAST(sum(no_time) AS BIGINT) AS invalid_date_count,
  '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS severity_distribution,
  any_value(extra) AS exact_duplicate_row_count,
  '{config_fingerprint()}' AS configuration_fingerprint, 'complete' AS completion_status
FROM per_label p JOIN repeats r ON p.source_project = r.source_project GROUP BY 1"""


@query("src4", MANIFEST_SQL)
def src4(spark, sf_dir):
    return manifest(views.core(spark, sf_dir), config_fingerprint())


FP_TEXT = " || chr(31) || ".join(f"coalesce({c}, chr(0))" for c in FINGERPRINT_COLUMNS)
FINGERPRINT_SQL = f"""
SELECT source_project, count(*) || ':' || bit_xor({digest(FP_TEXT)}) AS content_fingerprint
FROM v_reports GROUP BY source_project"""


def known_manifest(fingerprints):
    """A manifest in which half the projects were built with an older configuration."""
    old = F.col("source_project") < "src15"
    return fingerprints.select(
        "source_project",
        "content_fingerprint",
        F.when(old, "older").otherwise(config_fingerprint()).alias("configuration_fingerprint"),
        F.lit("complete").alias("completion_status"),
    )


@query(
    "src5",
    f"SELECT source_project, content_fingerprint, CASE WHEN source_project < 'src15' THEN 'built'"
    f" ELSE 'skipped_unchanged' END AS resume_status FROM ({FINGERPRINT_SQL})",
)
def src5(spark, sf_dir):
    current = source_fingerprints(
        views.reports(spark, sf_dir), "source_project", FINGERPRINT_COLUMNS
    )
    return changed_sources(current, known_manifest(current), config_fingerprint())


DELTA_SQL = """
WITH e AS (SELECT source_project, issue_id, severity FROM v_reports
  WHERE NOT (source_project < 'src10' AND doc_key % 13 = 1) AND source_project <> 'src18'),
c AS (SELECT source_project, issue_id, CASE WHEN source_project < 'src10' AND doc_key % 10 = 3 THEN severity || '!' ELSE severity END AS severity
  FROM v_reports WHERE NOT (source_project < 'src10' AND doc_key % 17 = 5) AND source_project <> 'src19'),
j AS (SELECT coalesce(c.source_project, e.source_project) AS source_project, c.issue_id AS now_id, e.issue_id AS old_id,
  c.severity AS now_severity, e.severity AS old_severity FROM c FULL JOIN e ON c.source_project = e.source_project AND c.issue_id = e.issue_id)
SELECT source_project, CASE WHEN count(old_id) = 0 THEN 'built' WHEN count(now_id) = 0 THEN 'lost'
  WHEN source_project = 'src12' THEN 'resumed' WHEN source_project = 'src13' THEN 'rebuilt'
  WHEN count(*) FILTER (now_id IS NULL OR old_id IS NULL OR now_severity <> old_severity) > 0 THEN 'changed'
  ELSE 'skipped_unchanged' END AS resume_status,
  count(*) FILTER (old_id IS NULL) AS added, count(*) FILTER (now_severity <> old_severity) AS changed,
  count(*) FILTER (now_id IS NULL) AS lost, count(*) FILTER (now_severity = old_severity) AS same
FROM j GROUP BY source_project"""


@query("src5_delta", DELTA_SQL)
def src5_delta(spark, sf_dir):
    """Rows added, changed and lost since a stored earlier build, some of it incomplete or outdated."""
    rows = views.reports(spark, sf_dir)
    project, doc = F.col("source_project"), F.col("doc_key")
    early = project < "src10"
    earlier = rows.filter(~(early & (doc % 13 == 1)) & (project != "src18"))
    path = new_table_path(spark, "build")
    store_build(
        earlier, path, "source_project", "issue_id", FINGERPRINT_COLUMNS,
        F.when(project == "src13", "older").otherwise(config_fingerprint()),
        F.when(project == "src12", "incomplete").otherwise("complete"),
    )
    edited = F.when(early & (doc % 10 == 3), F.concat("severity", F.lit("!"))).otherwise(F.col("severity"))
    current = rows.filter(~(early & (doc % 17 == 5)) & (project != "src19")).withColumn("severity", edited)
    return build_delta(
        current, path, "source_project", "issue_id", FINGERPRINT_COLUMNS, config_fingerprint()
    )


LABEL_TABLE_SQL = f"SELECT {norm('severity')} AS severity, count(*) AS count FROM v_core GROUP BY 1"


@query(
    "src6",
    f"SELECT f.format, t.severity, t.count FROM ({LABEL_TABLE_SQL}) t"
    " CROSS JOIN (SELECT unnest(['csv', 'json']) AS format) f",
)
def src6(spark, sf_dir):
    """Write a report table as CSV and as JSON and read both back."""
    from triagemill.functions.labels import normalize_label

    report = (
        views.core(spark, sf_dir)
        .groupBy(normalize_label(F.col("severity")).alias("severity"))
        .agg(F.count("*").alias("count"))
    )
    folder = new_table_path(spark, "report")
    exports.write_csv(report, f"{folder}/table.csv")
    exports.write_json(report, f"{folder}/table.json")
    types = "severity string, count bigint"
    back_csv = spark.read.schema(types).option("header", "true").csv(f"{folder}/table.csv")
    back_json = spark.read.schema(types).json(f"{folder}/table.json")
    columns = [F.coalesce("severity", F.lit("")).alias("severity"), "count"]
    return back_csv.select(F.lit("csv").alias("format"), *columns).unionByName(
        back_json.select(F.lit("json").alias("format"), *columns)
    )


def redact_sql(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace({x}, '{NWS}*@{NWS}*', '[EMAIL]', 'g'),"
        f" '(?i)(https?://{NWS}+|www\\.{NWS}+)', '[URL]', 'g')"
    )


@query(
    "src7",
    f"SELECT issue_id AS id, sha256({redact_sql('summary')}) AS summary_hash,"
    f" sha256({redact_sql('description')}) AS description_hash, severity,"
    " CAST(creation_time AS VARCHAR) AS creation_time, product, component,"
    " duplicate_group_id AS duplicate_group FROM v_eligible",
)
def src7(spark, sf_dir):
    """Persist a split with the allowed columns only and redacted texts."""
    from triagemill.operators.eligibility import eligible_reports

    rows = eligible_reports(views.core(spark, sf_dir)).withColumnsRenamed(
        {"issue_id": "id", "duplicate_group_id": "duplicate_group"}
    )
    allowed = rows.select(*[c for c in SPLIT_COLUMNS if c in rows.columns]).withColumns(
        {c: redact(F.col(c)) for c in ("summary", "description")}
    )
    path = new_table_path(spark, "split")
    write_once(allowed, path)
    back = spark.read.schema(allowed.schema).parquet(path)
    return rounded(
        back.select(
            "id",
            F.sha2("summary", 256).alias("summary_hash"),
            F.sha2("description", 256).alias("description_hash"),
            "severity",
            "creation_time",
            "product",
            "component",
            "duplicate_group",
        )
    )


@query(
    "src8",
    f"WITH fp AS ({FINGERPRINT_SQL}), run AS (SELECT source_project, count(*) AS rows FROM v_eligible GROUP BY 1)"
    " SELECT run.source_project, rows, content_fingerprint, CASE WHEN run.source_project < 'src15'"
    f" THEN 'older' ELSE '{config_fingerprint()}' END AS configuration_fingerprint"
    " FROM run LEFT JOIN fp ON run.source_project = fp.source_project",
)
def src8(spark, sf_dir):
    from triagemill.operators.eligibility import eligible_reports

    run = (
        eligible_reports(views.core(spark, sf_dir))
        .groupBy("source_project")
        .agg(F.count("*").alias("rows"))
    )
    fps = source_fingerprints(views.reports(spark, sf_dir), "source_project", FINGERPRINT_COLUMNS)
    return provenance(run, known_manifest(fps))


@query(
    "src9",
    f"SELECT source_project, content_fingerprint, true AS unchanged FROM ({FINGERPRINT_SQL})",
)
def src9(spark, sf_dir):
    """Fingerprint, build, fingerprint again; refuse when a source moved meanwhile."""
    raw = views.reports(spark, sf_dir)
    before = source_fingerprints(raw, "source_project", FINGERPRINT_COLUMNS)
    core_layer(spark, sf_dir)
    after = source_fingerprints(raw, "source_project", FINGERPRINT_COLUMNS)
    unchanged_guard(before, after)
    return before.join(
        after.select("source_project", F.col("content_fingerprint").alias("_after")),
        "source_project",
    ).select(
        "source_project",
        "content_fingerprint",
        (F.col("content_fingerprint") == F.col("_after")).alias("unchanged"),
    )


RAW_SQL = """(SELECT source_project, 'https://tracker.example/' || issue_id AS issue_url, issue_id, product,
 component, summary, description, severity, coalesce(CAST(creation_time AS VARCHAR), '') AS creation_time,
 dupe_of, description AS comments, CASE WHEN doc_key % 2 = 0 THEN 'NEW' ELSE '' END AS status,
 '' AS whiteboard FROM v_reports)"""
NORMALIZED = {
    **{c: schema.normalize_name(raw) for c, raw in RAW_NAMES.items()},
    **{schema.normalize_name(x): schema.normalize_name(x) for x in EXTRA_NAMES},
}
RAW_OF = {**RAW_NAMES, **{schema.normalize_name(x): x for x in EXTRA_NAMES}}


def fill_sql(names: dict[str, str], by: str = "") -> str:
    """Filled rows per column; ``names`` maps the SQL column to the reported name."""
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{shown}' AS raw_name, count(*) FILTER (WHERE {c} <> '') AS filled_rows"
        f" FROM {RAW_SQL}{group}"
        for c, shown in names.items()
    )


@query("sch1", fill_sql(NORMALIZED))
def sch1(spark, sf_dir):
    df = schema.normalize_columns(raw_export(spark, sf_dir).drop("source_project"))
    return schema.column_fill(df, df.columns, [])


@query("sch2", fill_sql({c: c for c in NORMALIZED}))
def sch2(spark, sf_dir):
    df = schema.rename_lenient(raw_export(spark, sf_dir).drop("source_project"))
    return schema.column_fill(df, df.columns, [])


def source_names(spark, sf_dir):
    """(source, raw column) pairs that carry data, plus a second id column in one source."""
    df = raw_export(spark, sf_dir).withColumn(
        "Issue ID", F.when(F.col("source_project") == "src3", F.col("ID")).otherwise("")
    )
    filled = schema.column_fill(df, [*raw_columns(), "Issue ID"], ["source_project"])
    return filled.filter(F.col("filled_rows") > 0).select("source_project", "raw_name")


NAMES_SQL = (
    f"SELECT source_project, raw_name FROM ({fill_sql(RAW_OF, 'source_project')}) WHERE filled_rows > 0"
    " UNION ALL SELECT DISTINCT source_project, 'Issue ID' FROM v_reports WHERE source_project = 'src3'"
)
ALIAS_SQL = (
    "(SELECT * FROM (VALUES "
    + ", ".join(
        f"('{c}', '{n}')"
        for c, n in sorted(
            {(c, schema.normalize_name(a)) for c, al in CORE_ALIASES.items() for a in [c, *al]}
        )
    )
    + ") t(canonical, normalized_name))"
)
RESOLVED_SQL = f"""
SELECT source_project, canonical, string_agg(raw_name, ',' ORDER BY raw_name) AS candidates,
  count(*) > 1 AS is_ambiguous
FROM ({NAMES_SQL}) n
JOIN {ALIAS_SQL} a ON a.normalized_name = trim(regexp_replace(lower(raw_name), '[^a-z0-9]+', '_', 'g'), '_')
GROUP BY 1, 2"""


@query("sch3", RESOLVED_SQL)
def sch3(spark, sf_dir):
    resolved = schema.resolve_strict(source_names(spark, sf_dir), schema.alias_table(spark))
    return resolved.withColumn("candidates", F.array_join("candidates", ","))


@query(
    "sch4",
    f"""WITH r AS ({RESOLVED_SQL}),
probe AS (SELECT source_project, least(count(*), 2) AS n FROM v_reports GROUP BY 1)
SELECT r.source_project,
  array_to_string(list_filter(['creation_time', 'description', 'issue_id', 'severity', 'summary'],
    lambda x: NOT list_contains(list(canonical), x)), ',') AS missing_required_columns,
  coalesce(string_agg(canonical, ',' ORDER BY canonical) FILTER (WHERE is_ambiguous), '') AS ambiguous_columns,
  coalesce(string_agg(canonical || '=' || candidates, ',' ORDER BY canonical)
    FILTER (WHERE NOT is_ambiguous), '') AS column_mappings,
  CASE WHEN bool_or(is_ambiguous) OR count(*) FILTER (WHERE canonical IN
    ('creation_time', 'description', 'issue_id', 'severity', 'summary')) < 5 THEN 0 ELSE any_value(n) END
    AS sample_rows_read,
  CASE WHEN bool_or(is_ambiguous) OR count(*) FILTER (WHERE canonical IN
    ('creation_time', 'description', 'issue_id', 'severity', 'summary')) < 5 THEN 'FAIL' ELSE 'PASS' END
    AS audit_status
FROM r JOIN probe USING (source_project) GROUP BY 1""",
)
def sch4(spark, sf_dir):
    """Audit of every project's headers; two rows of its written exports are parsed."""
    folder = new_table_path(spark, "exports")
    raw = raw_export(spark, sf_dir).repartition("source_project")
    exports.write_csv(raw, folder, by="source_project")
    sources = exports.resolve_sources(spark, glob=f"{folder}/source_project=*")
    probe = (
        exports.probe_exports(spark, sources)
        .groupBy(F.regexp_replace("source_file", "^source_project=", "").alias("source_project"))
        .agg(F.least(F.sum("sample_rows_read"), F.lit(2)).alias("sample_rows_read"))
    )
    return schema.audit_schemas(source_names(spark, sf_dir), schema.alias_table(spark), probe)


@query("sch5", "SELECT source_project, count(*) AS rows FROM v_core GROUP BY 1")
def sch5(spark, sf_dir):
    return (
        views.core(spark, sf_dir)
        .groupBy(schema.project_of_file(F.col("source_file")).alias("source_project"))
        .agg(F.count("*").alias("rows"))
    )


@query(
    "sch6",
    "SELECT source_project, count(*) AS rows, count(DISTINCT source_file) AS source_files,"
    " min(source_file) AS source_file, count(*) FILTER (WHERE NOT starts_with(global_report_key,"
    " source_project || ':')) AS foreign_keys, 'product,component' AS refused_predictors"
    " FROM v_core GROUP BY 1",
)
def sch6(spark, sf_dir):
    """Contract facts per partition, and the predictors an eligibility table refuses."""
    requested = spark.createDataFrame(
        [("Summary",), ("Description",), ("Product",), ("Component",)], "name string"
    )
    status = spark.createDataFrame(
        [
            ("summary", "PRIMARY_ELIGIBLE"),
            ("description", "PRIMARY_ELIGIBLE"),
            ("product", "SENSITIVITY_ONLY"),
        ],
        "normalized_name string, eligibility_status string",
    )
    refused = eligible_predictors(requested, status).filter(~F.col("allowed")).agg(
        F.array_join(F.sort_array(F.collect_list("normalized_name"), asc=False), ",").alias(
            "refused_predictors"
        )
    )
    facts = contract_facts(read_core(spark, core_layer(spark, sf_dir)))
    return facts.crossJoin(F.broadcast(refused))


@query(
    "sch7",
    f"""SELECT raw_name, CASE WHEN canonical IS NOT NULL THEN 'retained'
  WHEN normalized IN {in_list(['comments', 'status'])} THEN 'forbidden' ELSE 'left_out' END AS lineage,
  filled_rows
FROM (SELECT raw_name, filled_rows, trim(regexp_replace(lower(raw_name), '[^a-z0-9]+', '_', 'g'), '_') AS normalized
      FROM ({fill_sql(RAW_OF)})) LEFT JOIN {ALIAS_SQL} a ON a.normalized_name = normalized""",
)
def sch7(spark, sf_dir):
    filled = schema.column_fill(raw_export(spark, sf_dir), raw_columns(), [])
    return schema.lineage(filled.select("raw_name"), schema.alias_table(spark)).join(
        F.broadcast(filled), "raw_name"
    )
