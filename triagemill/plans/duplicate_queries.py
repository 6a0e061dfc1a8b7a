"""Duplicates and links as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagemill.functions.text import normalized_text_hash
from triagemill.operators import duplicates as D
from triagemill.operators.eligibility import eligible_reports
from triagemill.operators.splits import mark_purged_test
from triagemill.plans.registry import query, rounded
from triagemill.plans.text_queries import COMBINED, tagged_sql
from triagemill.session import materialize
from triagemill.sources import views


@query(
    "dup1",
    "SELECT issue_id, source_project, severity, copies_removed FROM (SELECT issue_id, source_project,"
    " severity, row_number() OVER w AS rn, count(*) OVER (PARTITION BY summary, description) - 1 AS copies_removed"
    " FROM v_reports WINDOW w AS (PARTITION BY summary, description ORDER BY doc_key)) WHERE rn = 1",
)
def dup1(spark, sf_dir):
    df = views.reports(spark, sf_dir).drop("creation_time")
    return D.drop_exact_duplicates(df, ["summary", "description"], ["doc_key"]).select(
        "issue_id", "source_project", "severity", "copies_removed"
    )


@query(
    "dup2",
    """WITH r AS (SELECT *, row_number() OVER w AS rn, first_value(global_report_key) OVER w AS k,
  first_value(creation_time) OVER w AS t, first_value(severity) OVER w AS l FROM v_eligible
  WINDOW w AS (PARTITION BY exact_text_hash ORDER BY creation_time, global_report_key))
SELECT global_report_key AS removed_report_key, k AS retained_report_key,
  CAST(creation_time AS VARCHAR) AS removed_creation_time, CAST(t AS VARCHAR) AS retained_creation_time,
  severity AS removed_label, l AS retained_label, exact_text_hash,
  'removed_later_exact_duplicate' AS decision FROM r WHERE rn > 1""",
)
def dup2(spark, sf_dir):
    return rounded(D.removal_log(eligible_reports(views.core(spark, sf_dir))))


CONFLICT_SQL = """
SELECT exact_text_hash, string_agg(DISTINCT severity, ',' ORDER BY severity) AS labels,
  count(*) AS row_count, min(creation_time) AS first_time, max(creation_time) AS last_time
FROM v_eligible GROUP BY 1 HAVING count(DISTINCT severity) > 1"""


@query(
    "dup3",
    f"""SELECT c.exact_text_hash, labels, row_count, CAST(first_time AS VARCHAR) AS earliest_creation_time,
  CAST(last_time AS VARCHAR) AS latest_creation_time, global_report_key, severity
FROM v_eligible e JOIN ({CONFLICT_SQL}) c ON e.exact_text_hash = c.exact_text_hash""",
)
def dup3(spark, sf_dir):
    """Conflicting texts in review form: every member row with the facts of its group."""
    rows = materialize(
        eligible_reports(views.core(spark, sf_dir)).select(
            "global_report_key", "severity", "creation_time", "exact_text_hash"
        ),
        "text-hashes",
    )
    return rounded(
        D.conflict_members(rows).select(
            "exact_text_hash",
            "labels",
            "row_count",
            "earliest_creation_time",
            "latest_creation_time",
            "global_report_key",
            "severity",
        )
    )


@query(
    "dup4",
    "SELECT issue_id, CASE WHEN trim(dupe_of) <> '' THEN trim(dupe_of) ELSE issue_id END AS duplicate_group"
    " FROM v_reports",
)
def dup4(spark, sf_dir):
    return D.one_hop_group(views.reports(spark, sf_dir), "issue_id", "dupe_of").select(
        "issue_id", "duplicate_group"
    )


COMPONENTS_SQL = """WITH RECURSIVE edges AS (
  SELECT issue_id AS a, dupe_of AS b FROM v_reports WHERE dupe_of <> ''
  UNION SELECT dupe_of, issue_id FROM v_reports WHERE dupe_of <> ''),
reach(node, seen) AS (
  SELECT issue_id, issue_id FROM v_reports UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a)
SELECT node AS key, min(seen) AS duplicate_group FROM reach GROUP BY 1"""


@query("dup5", COMPONENTS_SQL)
def dup5(spark, sf_dir):
    return D.connected_groups(views.reports(spark, sf_dir), "issue_id", "dupe_of")


@query("dup5_batches", COMPONENTS_SQL)
def dup5_batches(spark, sf_dir):
    """The same components from a stored forest into which links are merged as reports come in."""
    reports = views.reports(spark, sf_dir)
    year = F.coalesce(F.year("creation_time"), F.lit(0))
    links = reports.select(
        F.col("issue_id").alias("a"), F.col("dupe_of").alias("b"), year.alias("year")
    )
    forest = D.empty_forest(spark)
    for first, last in ((1, 2017), (2018, 2020), (2021, 9999), (0, 0)):
        batch = links.filter(F.col("year").between(first, last)).drop("year")
        forest = D.merge_links(forest, batch)
    keys = reports.select(F.col("issue_id").cast("string").alias("key")).distinct()
    return keys.join(forest, "key", "left").select(
        "key", F.coalesce("root", "key").alias("duplicate_group")
    )


GROUPS_SQL = """
SELECT 'exact_text_hash' AS group_type, exact_text_hash AS group_id, exact_text_hash, count(*) AS row_count,
  count(DISTINCT source_project) AS project_count,
  string_agg(DISTINCT source_project, ',' ORDER BY source_project) AS projects,
  arg_min(global_report_key, (creation_time IS NULL, coalesce(creation_time, TIMESTAMP '1900-01-01'), global_report_key))
    AS preferred_report_key, 'earliest_valid_creation_time' AS retention_rule
FROM v_core GROUP BY exact_text_hash HAVING count(*) > 1
UNION ALL
SELECT 'dupe_of', source_project || ':' || dupe_of, '', count(*) + 1, 1, source_project,
  source_project || ':' || dupe_of, 'canonical_dupe_of_target'
FROM v_core WHERE dupe_of <> '' GROUP BY source_project, dupe_of"""


@query("dup6", GROUPS_SQL)
def dup6(spark, sf_dir):
    return D.duplicate_groups(views.core(spark, sf_dir))


SUMMARY_SQL = """
SELECT 'duplicate_project_issue_ids' AS metric, count(*) - count(DISTINCT (source_project, issue_id)) AS count FROM v_core
UNION ALL SELECT 'duplicate_global_report_keys', count(*) - count(DISTINCT global_report_key) FROM v_core
UNION ALL SELECT 'exact_duplicate_text_rows', count(*) - count(DISTINCT exact_text_hash) FROM v_core
UNION ALL SELECT 'linked_duplicate_rows', count(*) FILTER (WHERE dupe_of <> '') FROM v_core
UNION ALL SELECT 'cross_project_exact_duplicate_groups', count(*) FROM (SELECT exact_text_hash FROM v_core
  GROUP BY 1 HAVING count(DISTINCT source_project) > 1)"""


def audit_sql(kind: str, value: str) -> str:
    groups = "count(*)" if kind == "explicit_group" else "count(*) FILTER (WHERE n > 1)"
    return (
        f"SELECT 'audit_{kind}_groups' AS metric, {groups} AS count FROM (SELECT {value}, count(*) AS n"
        f" FROM v_core GROUP BY 1) UNION ALL SELECT 'audit_{kind}_rows', count(*) - count(DISTINCT {value}) FROM v_core"
    )


@query(
    "dup7",
    SUMMARY_SQL
    + " UNION ALL "
    + " UNION ALL ".join(
        audit_sql(k, v)
        for k, v in (
            ("exact", f"sha256({COMBINED})"),
            ("normalized", f"sha256({tagged_sql()})"),
            ("explicit_group", "duplicate_group_id"),
        )
    ),
)
def dup7(spark, sf_dir):
    core = views.core(spark, sf_dir)
    audit = D.duplicate_audit(core, "duplicate_group_id")
    entries = F.array(
        F.struct(
            F.concat(F.lit("audit_"), "type", F.lit("_groups")).alias("metric"),
            F.col("groups").alias("count"),
        ),
        F.struct(
            F.concat(F.lit("audit_"), "type", F.lit("_rows")).alias("metric"),
            F.col("duplicate_rows").alias("count"),
        ),
    )
    return D.duplicate_summary(core).unionByName(
        audit.select(F.explode(entries).alias("e")).select("e.*")
    )


@query(
    "dup8",
    """SELECT 'numeric_issue_ids_present_in_multiple_projects' AS metric, count(*) AS count FROM
  (SELECT issue_id FROM v_core GROUP BY 1 HAVING count(DISTINCT source_project) > 1)
UNION ALL SELECT 'duplicate_global_report_keys', count(*) - count(DISTINCT global_report_key) FROM v_core
UNION ALL SELECT 'exact_text_hashes_across_projects', count(*) FROM
  (SELECT exact_text_hash FROM v_core GROUP BY 1 HAVING count(DISTINCT source_project) > 1)
UNION ALL SELECT 'explicit_cross_project_dupe_links', count(*) FROM v_core WHERE contains(dupe_of, ':')
UNION ALL SELECT 'resolved_cross_project_dupe_links', count(*) FROM v_core WHERE contains(dupe_of, ':')
  AND dupe_of IN (SELECT global_report_key FROM v_core)""",
)
def dup8(spark, sf_dir):
    return D.cross_project_overlap(views.core(spark, sf_dir))


@query(
    "dup9",
    """SELECT id, partition, partition = 'test' AND coalesce(duplicate_group IN
  (SELECT duplicate_group FROM v_split WHERE partition = 'development' AND duplicate_group IS NOT NULL), false) AS purged FROM v_split""",
)
def dup9(spark, sf_dir):
    split = views.positioned_tickets(spark, sf_dir)
    return mark_purged_test(split, "duplicate_group").select("id", "partition", "purged")


@query(
    "dup10",
    """WITH g AS (SELECT fold, role, customer::VARCHAR AS customer, duplicate_group FROM v_folds),
k AS (SELECT fold, role, 'customer' AS kind, customer AS value FROM g UNION ALL
      SELECT fold, role, 'duplicate_group', duplicate_group FROM g),
c AS (SELECT fold, kind, value FROM k GROUP BY ALL HAVING count(DISTINCT role) = 2)
SELECT b.fold::BIGINT AS fold, b.kind, count(c.value) AS crossing_groups
FROM (SELECT DISTINCT fold, kind FROM k) b LEFT JOIN c ON b.fold = c.fold AND b.kind = c.kind GROUP BY 1, 2""",
)
def dup10(spark, sf_dir):
    """Purged groups never cross; customers, on which nothing was purged, do."""
    folds = views.ticket_folds(spark, sf_dir).withColumn(
        "customer", F.col("customer").cast("string")
    )
    return rounded(D.fold_crossings(folds, ["customer", "duplicate_group"]))


@query(
    "dup10_rows",
    f"""WITH h AS (SELECT issue_id, sha256({tagged_sql()}) AS normalized_text_hash FROM v_reports)
SELECT issue_id, normalized_text_hash, group_rows FROM (SELECT *, count(*) OVER (PARTITION BY normalized_text_hash)
  AS group_rows FROM h) WHERE group_rows > 1""",
)
def dup10_rows(spark, sf_dir):
    df = views.reports(spark, sf_dir).select(
        "issue_id",
        normalized_text_hash(F.col("summary"), F.col("description")).alias(
            "normalized_text_hash"
        ),
    )
    df = materialize(df, "normalized-hashes")
    return D.repeated_rows(df, "normalized_text_hash", "issue_id")


@query(
    "dup11",
    "SELECT source_project, count(*) FILTER (WHERE trim(dupe_of) <> '') AS dupe_of_relationships"
    " FROM v_core GROUP BY 1",
)
def dup11(spark, sf_dir):
    return D.link_counts(views.core(spark, sf_dir))
