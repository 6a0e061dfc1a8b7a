"""Splits, folds and sampling as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagemill.constants import TICKET_LABELS
from triagemill.operators import splits as S
from triagemill.operators.models import union_all
from triagemill.operators.positions import with_position
from triagemill.plans.oracle_views import digest
from triagemill.plans.registry import query, rounded
from triagemill.sources import views


@query("spl1", "SELECT id, pos, partition FROM v_split")
def spl1(spark, sf_dir):
    df = views.tickets(spark, sf_dir).select("id", "seq", "creation_time", "severity")
    return S.chronological_holdout(df, "creation_time", "seq", "severity").select(
        "id", "pos", "partition"
    )


@query(
    "spl2",
    """SELECT project, severity FROM (SELECT p.project, severity, partition FROM v_split p)
GROUP BY 1, 2 HAVING count(*) FILTER (WHERE partition = 'development') = 0 AND count(*) FILTER (WHERE partition = 'test') > 0
UNION ALL SELECT '*' AS project, severity FROM v_split GROUP BY severity
HAVING count(*) FILTER (WHERE partition = 'development') = 0""",
)
def spl2(spark, sf_dir):
    """Labels that only the test period holds: overall, and per project."""
    split = views.positioned_tickets(spark, sf_dir)
    overall = S.labels_only_in_test(split, "severity").select(
        F.lit("*").alias("project"), F.col("label").alias("severity")
    )
    per_project = split.withColumn("severity", F.concat_ws("\x1f", "project", "severity"))
    named = S.labels_only_in_test(per_project.withColumn("severity", F.hex("severity")), "severity")
    parts = F.split(F.decode(F.unhex("label"), "UTF-8"), "\x1f")
    return overall.unionByName(
        named.select(parts[0].alias("project"), parts[1].alias("severity"))
    )


@query("spl3", "SELECT id, CAST(fold AS BIGINT) AS fold, role FROM v_folds")
def spl3(spark, sf_dir):
    folds = S.expanding_folds(views.positioned_tickets(spark, sf_dir), 3)
    return rounded(S.check_folds(folds, 3).select("id", "fold", "role"))


LABEL_ORDER = "row_number() OVER (PARTITION BY severity ORDER BY md5(id || '#42'), id) - 1"


@query(
    "spl4",
    f"""SELECT id, severity, CASE WHEN {LABEL_ORDER} < round(count(*) OVER (PARTITION BY severity) * 0.8::DOUBLE)
  THEN 'development' ELSE 'test' END AS partition FROM v_tickets""",
)
def spl4(spark, sf_dir):
    df = views.tickets(spark, sf_dir).select("id", "severity")
    return S.stratified_holdout(df, "id", "severity").select("id", "severity", "partition")


@query("spl5", f"SELECT id, severity, ({LABEL_ORDER}) % 3 + 1 AS fold FROM v_tickets")
def spl5(spark, sf_dir):
    df = views.tickets(spark, sf_dir).select("id", "severity")
    return rounded(S.stratified_folds(df, "id", "severity", 3).select("id", "severity", "fold"))


@query(
    "spl6",
    """SELECT fraction, id FROM v_split CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.4, 0.6, 0.8, 1.0]) AS fraction)
WHERE pos < greatest(4, floor(n_rows * fraction))""",
)
def spl6(spark, sf_dir):
    return S.learning_subsets(views.positioned_tickets(spark, sf_dir)).select("fraction", "id")


@query(
    "spl7",
    """WITH t AS (SELECT *, min(pos) OVER (PARTITION BY outer_fold, coalesce(duplicate_group, 'own:' || id)) AS first_pos FROM (
  SELECT fold AS outer_fold, id, severity, duplicate_group, pos, count(*) OVER (PARTITION BY fold) AS n FROM v_folds WHERE role = 'train'))
SELECT CAST(outer_fold AS BIGINT) AS outer_fold, id, CAST(fold AS BIGINT) AS fold,
  CASE WHEN pos < n - (3 - fold) * (n // 3) THEN 'train' ELSE 'validation' END AS role
FROM t CROSS JOIN (SELECT unnest([1, 2]) AS fold)
WHERE pos < n - (2 - fold) * (n // 3) AND (pos < n - (3 - fold) * (n // 3) OR first_pos >= n - (3 - fold) * (n // 3))""",
)
def spl7(spark, sf_dir):
    """Inner folds inside the training side of every outer fold."""
    train = views.ticket_folds(spark, sf_dir).filter(F.col("role") == "train")
    sizes = {r["fold"]: r["count"] for r in train.groupBy("fold").count().collect()}
    parts = []
    for outer, size in sorted(sizes.items()):
        base = train.filter(F.col("fold") == outer).select(
            "id", "severity", "duplicate_group", "pos", F.lit(size).alias("n_rows")
        )
        inner = S.inner_folds(base, "severity", TICKET_LABELS, "duplicate_group")
        parts.append(inner.select(F.lit(outer).alias("outer_fold"), "id", "fold", "role"))
    return rounded(union_all(parts))


@query(
    "spl8",
    f"SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS rows, bit_xor({digest('pos || chr(58) || id')}) AS row_set_xor"
    " FROM v_folds GROUP BY 1, 2",
)
def spl8(spark, sf_dir):
    prints = S.row_set_fingerprints(views.ticket_folds(spark, sf_dir), "id")
    S.verify_fingerprints(prints, prints)
    return rounded(prints)


@query(
    "spl9",
    """SELECT 'within_project' AS design, id, CASE WHEN p < floor(n * 0.8::DOUBLE) THEN 'development' ELSE 'test' END AS side
FROM (SELECT id, row_number() OVER (PARTITION BY project ORDER BY creation_time, seq) - 1 AS p,
  count(*) OVER (PARTITION BY project) AS n FROM v_tickets)
UNION ALL SELECT 'pooled', id, partition FROM v_split
UNION ALL SELECT 'leave_one_project_out', id, CASE WHEN min(project) OVER g <> max(project) OVER g THEN 'purged' ELSE 'test' END
FROM v_tickets WINDOW g AS (PARTITION BY CASE WHEN seq % 11 <> 0 THEN component || '-' || (seq % 4000) ELSE 'own:' || id END)""",
)
def spl9(spark, sf_dir):
    """Three evaluation designs. For the last, groups are made to span projects."""
    tickets = views.tickets(spark, sf_dir)
    narrow = tickets.select("id", "seq", "project", "creation_time")
    within = with_position(narrow, ["creation_time", "seq"], scope="project")
    cut = S.cut_position(F.col("n_rows"), 0.8)
    out = within.select(
        F.lit("within_project").alias("design"),
        "id",
        F.when(F.col("pos") < cut, "development").otherwise("test").alias("side"),
    )
    pooled = views.positioned_tickets(spark, sf_dir).select(
        F.lit("pooled").alias("design"), "id", F.col("partition").alias("side")
    )
    shared = tickets.select(
        "id",
        "project",
        F.when(
            F.col("seq") % 11 != 0,
            F.concat("component", F.lit("-"), (F.col("seq") % 4000).cast("string")),
        ).alias("g"),
    )
    leave_out = S.leave_one_project_out(shared, "project", "g").select(
        F.lit("leave_one_project_out").alias("design"),
        "id",
        F.when(F.col("purged"), "purged").otherwise("test").alias("side"),
    )
    return out.unionByName(pooled).unionByName(leave_out)


@query(
    "spl10",
    """WITH a AS (SELECT id, row_number() OVER (ORDER BY md5(id || '#42'), id) AS p FROM v_tickets),
b AS (SELECT severity, row_number() OVER (ORDER BY md5(id || '#43'), id) AS p FROM v_tickets)
SELECT id, severity FROM a JOIN b ON a.p = b.p""",
)
def spl10(spark, sf_dir):
    df = views.tickets(spark, sf_dir).select("id", "severity")
    return S.shuffled_labels(df, "id", "severity").select("id", "severity")
