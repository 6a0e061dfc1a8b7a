"""Label mapping, filters and row builders as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagemill.constants import (
    HIERARCHIES,
    LABEL_EXCLUSIONS,
    LABEL_GROUPS,
    LABELS,
    TASKS,
    TICKET_LABELS,
)
from triagemill.functions import labels as L
from triagemill.operators import eligibility as E
from triagemill.plans.oracle_views import in_list, norm
from triagemill.plans.registry import query, rounded
from triagemill.sources import views


def case_map(col: str, mapping: dict, otherwise: str = "NULL") -> str:
    arms = " ".join(
        f"WHEN '{k}' THEN " + (str(v) if isinstance(v, int) else f"'{v}'")
        for k, v in mapping.items()
    )
    return f"CASE {col} {arms} ELSE {otherwise} END"


EXCLUDED = in_list(LABEL_EXCLUSIONS)
FILTERED_SQL = f"""SELECT issue_id, {norm('severity')} AS severity FROM v_reports
WHERE {norm('severity')} <> '' AND {norm('severity')} NOT IN {EXCLUDED}"""


@query("lab1", f"SELECT issue_id, {norm('severity')} AS severity FROM v_reports")
def lab1(spark, sf_dir):
    return views.reports(spark, sf_dir).select(
        "issue_id", L.normalize_label(F.col("severity")).alias("severity")
    )


@query("lab2", FILTERED_SQL)
def lab2(spark, sf_dir):
    return E.filter_labels(views.reports(spark, sf_dir), "severity").select(
        "issue_id", "severity"
    )


@query(
    "lab3",
    f"SELECT issue_id, severity AS label, {case_map('severity', L.invert(LABEL_GROUPS))} AS grouped"
    f" FROM ({FILTERED_SQL})",
)
def lab3(spark, sf_dir):
    df = E.filter_labels(views.reports(spark, sf_dir), "severity")
    return df.select(
        "issue_id", F.col("severity").alias("label"), L.grouped_label(F.col("severity")).alias(
            "grouped"
        )
    )


@query(
    "lab4",
    "SELECT issue_id, "
    + ", ".join(f"{case_map('severity', TASKS[t])} AS {t}" for t in TASKS)
    + " FROM v_eligible",
)
def lab4(spark, sf_dir):
    df = E.eligible_reports(views.core(spark, sf_dir))
    return df.select("issue_id", *[L.task_label(F.col("severity"), t).alias(t) for t in TASKS])


@query(
    "lab5",
    "SELECT hierarchy, grp, severity, count(*) AS rows FROM ("
    + " UNION ALL ".join(
        f"SELECT '{h}' AS hierarchy, {case_map('severity', L.invert(HIERARCHIES[h]))} AS grp,"
        " severity FROM v_eligible"
        for h in HIERARCHIES
    )
    + ") GROUP BY ALL",
)
def lab5(spark, sf_dir):
    """Members of every hierarchy group, which is also the inverse map, with row counts."""
    df = E.eligible_reports(views.core(spark, sf_dir)).select("severity")
    entries = F.array(
        *[
            F.struct(F.lit(h).alias("hierarchy"), L.hierarchy_group(F.col("severity"), h).alias("grp"))
            for h in HIERARCHIES
        ]
    )
    return (
        df.select(F.explode(entries).alias("e"), "severity")
        .groupBy("e.hierarchy", "e.grp", "severity")
        .agg(F.count("*").alias("rows"))
    )


@query("lab6", "SELECT id, CAST(rank AS BIGINT) AS rank, severity AS label_again FROM v_tickets")
def lab6(spark, sf_dir):
    df = views.tickets(spark, sf_dir)
    rank = L.label_to_rank(F.col("severity"), TICKET_LABELS)
    return df.select(
        "id",
        rank.cast("bigint").alias("rank"),
        L.rank_to_label(rank, TICKET_LABELS).alias("label_again"),
    )


@query(
    "lab7",
    "SELECT id, " + ", ".join(f"CAST(rank > {t} AS BIGINT) AS gt_{t}" for t in range(4))
    + " FROM v_tickets",
)
def lab7(spark, sf_dir):
    df = views.tickets(spark, sf_dir).withColumn("c", L.cumulative_targets(F.col("rank"), 5))
    return df.select("id", *[F.col("c")[t].cast("bigint").alias(f"gt_{t}") for t in range(4)])


ELIGIBLE = (
    f"({norm('severity')} IN {in_list(LABELS)} AND creation_time IS NOT NULL AND has_valid_text)"
)
LAB8_SQL = f"""
WITH flagged AS (SELECT *, {norm('severity')} AS label, {ELIGIBLE} AS ok FROM v_core),
kept AS (SELECT exact_text_hash, count(*) AS n, count(DISTINCT label) AS labels FROM flagged WHERE ok GROUP BY 1)
SELECT count(*) AS raw_core_rows,
  count(*) FILTER (WHERE label = '') AS missing_or_blank_label_rows,
  count(*) FILTER (WHERE label IN {EXCLUDED}) AS configured_excluded_label_rows,
  count(*) FILTER (WHERE label <> '' AND label NOT IN {EXCLUDED} AND label NOT IN {in_list(LABELS)})
    AS unexpected_or_unmapped_label_rows,
  count(*) FILTER (WHERE creation_time IS NULL) AS invalid_creation_time_rows,
  count(*) FILTER (WHERE NOT has_valid_text) AS invalid_text_rows,
  count(*) FILTER (WHERE ok) AS eligible_before_exact_deduplication,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM kept) AS later_exact_duplicates_removed,
  (SELECT count(*) FROM kept WHERE labels > 1) AS conflicting_exact_text_groups,
  (SELECT count(*) FROM kept) AS modeling_rows_after_filtering_and_deduplication
FROM flagged"""


@query("lab8", LAB8_SQL)
def lab8(spark, sf_dir):
    return E.eligibility_summary(views.core(spark, sf_dir))


@query(
    "lab9",
    f"SELECT issue_id, {case_map('severity', L.invert(LABEL_GROUPS))} AS severity"
    f" FROM ({FILTERED_SQL})",
)
def lab9(spark, sf_dir):
    return E.filter_dataset(
        views.reports(spark, sf_dir), "severity", ["summary", "description"], groups=LABEL_GROUPS
    ).select("issue_id", "severity")


@query(
    "lab10",
    "SELECT issue_id, CASE WHEN creation_time IS NOT NULL AND doc_key % 11 <> 0 THEN"
    " CAST(creation_time AS VARCHAR) END AS creation_time, '' AS keywords,"
    " CAST(length(description) AS BIGINT) AS description_chars FROM v_reports",
)
def lab10(spark, sf_dir):
    """Times arrive as text, some unparseable; a missing text column is added."""
    raw = views.reports(spark, sf_dir).withColumn(
        "creation_time",
        F.when(F.col("doc_key") % 11 == 0, "not a date").otherwise(
            F.col("creation_time").cast("string")
        ),
    )
    df = E.coerce_time(E.ensure_text(raw, ["description", "keywords"]), "creation_time")
    return rounded(
        df.select(
            "issue_id",
            "creation_time",
            "keywords",
            F.length("description").alias("description_chars"),
        )
    )


@query(
    "lab11",
    "SELECT * EXCLUDE (summary, description, creation_time, doc_key), sha256(summary) AS summary,"
    " sha256(description) AS description, CAST(creation_time AS VARCHAR) AS creation_time FROM v_core",
)
def lab11(spark, sf_dir):
    df = views.core(spark, sf_dir)
    return rounded(
        df.withColumns({c: F.sha2(c, 256) for c in ("summary", "description")})
    )


CONFLICTS_SQL = "SELECT exact_text_hash FROM v_eligible GROUP BY 1 HAVING count(DISTINCT severity) > 1"


@query(
    "lab12",
    f"SELECT global_report_key, severity FROM v_eligible WHERE exact_text_hash NOT IN ({CONFLICTS_SQL})",
)
def lab12(spark, sf_dir):
    """Rows left for a sensitivity run once known label conflicts are listed and excluded."""
    from triagemill.operators.duplicates import conflict_members

    rows = E.eligible_reports(views.core(spark, sf_dir))
    listed = conflict_members(rows).select("global_report_key")
    return E.exclude_ids(rows, "global_report_key", listed).select(
        "global_report_key", "severity"
    )


LEVEL_SQL = (
    "CASE WHEN doc_key % 41 = 0 THEN NULL ELSE component || '-' || substr(severity, 1, 3) END"
)


@query(
    "lab13",
    f"""WITH r AS (SELECT issue_id, source_project, coalesce({LEVEL_SQL}, '[MISSING]') AS level FROM v_reports),
kept AS (SELECT level FROM r WHERE source_project < 'src15' GROUP BY 1 HAVING count(*) >= 5)
SELECT issue_id, CASE WHEN level IN (SELECT level FROM kept) THEN level ELSE '[RARE]' END AS level FROM r""",
)
def lab13(spark, sf_dir):
    """Levels frequent in the training projects; the rest and unseen levels are rare."""
    level = F.when(
        F.col("doc_key") % 41 != 0,
        F.concat("component", F.lit("-"), F.substring("severity", 1, 3)),
    )
    df = views.reports(spark, sf_dir).select("issue_id", "source_project", level.alias("level"))
    kept = E.retained_levels(df.filter(F.col("source_project") < "src15"), "level")
    return E.apply_rare_levels(df, "level", kept, "issue_id").select("issue_id", "level")
