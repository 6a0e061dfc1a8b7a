"""Audits as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagemill.constants import LABEL_EXCLUSIONS, LABEL_GROUPS, LABELS, TASKS, TICKET_LABELS
from triagemill.functions.labels import invert
from triagemill.operators import audits as A
from triagemill.operators import splits as S
from triagemill.operators.duplicates import link_counts
from triagemill.operators.eligibility import eligible_reports
from triagemill.operators.positions import thirds, with_position
from triagemill.plans.label_queries import case_map
from triagemill.plans.oracle_views import WS, in_list, label_rows, norm, strip, tokens
from triagemill.plans.registry import query, rounded
from triagemill.plans.source_queries import MANIFEST_SQL
from triagemill.plans.text_queries import AUDIT_FLAGS, COMBINED
from triagemill.sources import views
from triagemill.sources.core import config_fingerprint, manifest

EXCLUDED = in_list(LABEL_EXCLUSIONS)
OBSERVED = ["", *sorted(["enhancement", *LABELS])]
SCOPES = "(SELECT *, source_project AS scope FROM v_core UNION ALL SELECT *, 'combined' AS scope FROM v_core)"


def positions(spark, sf_dir):
    return views.remember(
        spark, sf_dir, "preview_positions", lambda: A.preview_positions(views.core(spark, sf_dir))
    )


LABEL_TABLE = f"""
SELECT scope, label AS normalized_severity, n AS count, round(n / sum(n) OVER (PARTITION BY scope), 6) AS percentage,
  label = '' AS is_missing_or_blank, label IN {EXCLUDED} AS is_excluded,
  label IN {in_list(LABELS)} AS is_expected,
  CASE WHEN label <> '' AND label NOT IN {EXCLUDED} THEN n ELSE 0 END AS proposed_retained_count
FROM (SELECT scope, {norm('severity')} AS label, count(*) AS n FROM {SCOPES} GROUP BY 1, 2)"""


@query("agg2", LABEL_TABLE)
def agg2(spark, sf_dir):
    return rounded(A.label_table(views.core(spark, sf_dir)))


@query(
    "agg3",
    f"SELECT scope, {case_map(norm('severity'), invert(LABEL_GROUPS), chr(39) + '<unmapped>' + chr(39))}"
    f" AS grouped_severity, count(*) AS count FROM {SCOPES} GROUP BY 1, 2",
)
def agg3(spark, sf_dir):
    return A.grouped_preview(views.core(spark, sf_dir))


@query("agg4", f"SELECT * FROM ({LABEL_TABLE}) WHERE NOT is_expected")
def agg4(spark, sf_dir):
    return rounded(A.unexpected_labels(views.core(spark, sf_dir)))


INSPECTED = ["issue_id", "product", "component", "summary", "description", "severity", "creation_time"]
RETAINED = f"({norm('severity')} <> '' AND {norm('severity')} NOT IN {EXCLUDED})"


def _row(item: str, value: str) -> str:
    return (
        f"SELECT 'rows' AS section, '{item}' AS item, {value} AS count, 0.0::DOUBLE AS share,"
        " '' AS detail FROM v_core"
    )


@query(
    "agg1",
    " UNION ALL ".join(
        [_row("total_rows", "count(*)")]
        + [_row(f"missing:{c}", f"count(*) FILTER (WHERE {c} IS NULL)") for c in INSPECTED]
        + [
            _row(f"empty:{c}", f"count(*) FILTER (WHERE {strip(c)} = '')")
            for c in ("summary", "description", "severity")
        ]
        + [
            _row("proposed_retained_rows", f"count(*) FILTER (WHERE {RETAINED})"),
            _row("proposed_excluded_rows", f"count(*) FILTER (WHERE NOT {RETAINED})"),
            _row("duplicate_count", "count(*) - count(DISTINCT (summary, description))"),
            "SELECT 'creation_range', 'earliest', 0, 0.0, CAST(min(creation_time) AS VARCHAR) FROM v_core",
            "SELECT 'creation_range', 'latest', 0, 0.0, CAST(max(creation_time) AS VARCHAR) FROM v_core",
            f"SELECT 'severity', {norm('severity')}, count(*), round(count(*) / sum(count(*)) OVER (), 6), ''"
            " FROM v_core GROUP BY 2",
            "SELECT 'product', coalesce(product, '<missing>'), count(*), 0.0, '' FROM v_core GROUP BY 2",
            "SELECT 'component', coalesce(component, '<missing>'), count(*), 0.0, '' FROM v_core GROUP BY 2",
        ]
    ),
)
def agg1(spark, sf_dir):
    return rounded(A.inspect_dataset(views.core(spark, sf_dir), INSPECTED))


TEXT_AUDIT = f"""
SELECT scope, count(*) AS rows,
  count(*) FILTER (WHERE {strip('summary')} = '') AS missing_or_empty_summary,
  count(*) FILTER (WHERE {strip('description')} = '') AS missing_or_empty_description,
  count(*) FILTER (WHERE {strip('summary')} = '' AND {strip('description')} = '') AS both_missing,
  {', '.join(
      f"{fn}({e}) AS {f}_{n}_chars"
      for f, e in (('summary', 'length(summary)'), ('description', 'length(description)'),
                   ('combined', 'length(summary) + length(description)'))
      for fn, n in (('min', 'min'), ('avg', 'mean'), ('max', 'max')))},
  {', '.join(
      f"{fn}({tokens(f)}) AS {f}_{n}_tokens"
      for f in ('summary', 'description') for fn, n in (('avg', 'mean'), ('max', 'max')))},
  count(*) FILTER (WHERE length(summary) + length(description) < 20) AS extremely_short_under_20_chars,
  count(*) FILTER (WHERE length(summary) + length(description) > 100000) AS extremely_long_over_100000_chars,
  {', '.join(
      f"count(*) FILTER (WHERE regexp_matches({COMBINED}, '{p}')) AS {n}"
      for n, p in zip(
          ('url_occurrence_rows', 'email_occurrence_rows', 'html_occurrence_rows', 'code_or_stack_trace_rows'),
          AUDIT_FLAGS.values()))}
FROM {SCOPES} GROUP BY scope"""


@query(
    "agg5",
    f"SELECT * REPLACE (round(summary_mean_chars, 6) AS summary_mean_chars, round(description_mean_chars, 6)"
    f" AS description_mean_chars, round(combined_mean_chars, 6) AS combined_mean_chars,"
    f" round(summary_mean_tokens, 6) AS summary_mean_tokens, round(description_mean_tokens, 6)"
    f" AS description_mean_tokens) FROM ({TEXT_AUDIT})",
)
def agg5(spark, sf_dir):
    return rounded(A.text_audit(views.core(spark, sf_dir)))


POSITIONS = f"""(SELECT scope, severity, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY scope) AS n_rows
  FROM (SELECT scope, global_report_key, creation_time, {norm('severity')} AS severity FROM {SCOPES}
        WHERE creation_time IS NOT NULL AND {RETAINED})
  WINDOW w AS (PARTITION BY scope ORDER BY creation_time, global_report_key))"""
HOLDOUT = f"""
SELECT scope, CASE WHEN pos < floor(n_rows * 0.8::DOUBLE) THEN 'development' ELSE 'test' END AS partition,
  severity, count(*) AS count FROM {POSITIONS} GROUP BY 1, 2, 3"""
CV = f"""
SELECT scope, fold, CASE WHEN pos < fold * cut // 4 THEN 'train' ELSE 'validation' END AS partition,
  severity, count(*) AS count
FROM (SELECT *, CAST(floor(n_rows * 0.8::DOUBLE) AS BIGINT) AS cut FROM {POSITIONS})
CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS fold)
WHERE pos < (fold + 1) * cut // 4 GROUP BY 1, 2, 3, 4"""
COVERAGE = f"""
WITH hold AS ({HOLDOUT}), cv AS ({CV}),
sides AS (SELECT scope, list(DISTINCT severity) FILTER (WHERE partition = 'development') AS dev,
  list(DISTINCT severity) FILTER (WHERE partition = 'test') AS tst FROM hold GROUP BY 1),
folds AS (SELECT scope, count(DISTINCT fold) AS n FROM cv WHERE partition = 'validation' GROUP BY 1),
diff AS (SELECT scope, len(dev) > 0 AND len(tst) > 0 AS both_sides,
  array_to_string(list_sort(list_filter(dev, lambda x: NOT list_contains(tst, x))), ',') AS missing_test,
  array_to_string(list_sort(list_filter(tst, lambda x: NOT list_contains(dev, x))), ',') AS future FROM sides)
SELECT s.scope, min(creation_time) AS minimum_creation_time, max(creation_time) AS maximum_creation_time,
  count(*) FILTER (WHERE creation_time IS NULL) AS invalid_dates, count(creation_time) AS valid_dates,
  any_value(both_sides AND future = '') AS holdout_viable, any_value(coalesce(n, 0) = 3) AS cv_viable,
  any_value(missing_test) AS missing_test_classes, any_value(future) AS future_only_classes
FROM {SCOPES} s LEFT JOIN diff ON s.scope = diff.scope LEFT JOIN folds ON s.scope = folds.scope GROUP BY s.scope"""


@query(
    "agg6",
    f"SELECT * REPLACE (CAST(minimum_creation_time AS VARCHAR) AS minimum_creation_time,"
    f" CAST(maximum_creation_time AS VARCHAR) AS maximum_creation_time) FROM ({COVERAGE})",
)
def agg6(spark, sf_dir):
    pos = positions(spark, sf_dir)
    return rounded(
        A.temporal_coverage(
            views.core(spark, sf_dir), A.holdout_preview(pos), A.cv_preview(pos)
        )
    )


@query(
    "agg7",
    f"""WITH c AS (SELECT scope, CAST(year(creation_time) AS BIGINT) AS year, {norm('severity')} AS severity, count(*) AS n
  FROM {SCOPES} WHERE creation_time IS NOT NULL GROUP BY 1, 2, 3),
d AS (SELECT y.scope, y.year, l.severity, coalesce(c.n, 0) AS count FROM (SELECT DISTINCT scope, year FROM c) y
  CROSS JOIN (SELECT DISTINCT {norm('severity')} AS severity FROM v_core) l
  LEFT JOIN c ON c.scope = y.scope AND c.year = y.year AND c.severity = l.severity)
SELECT scope, year, severity, count, round(count / sum(count) OVER (PARTITION BY scope, year), 6) AS percentage_within_year,
  count = 0 AS class_missing_in_period,
  round(count / sum(count) OVER (PARTITION BY scope, year) - sum(count) OVER (PARTITION BY scope, severity)
    / sum(count) OVER (PARTITION BY scope), 6) + 0.0 AS label_drift_delta_from_scope_share FROM d""",
)
def agg7(spark, sf_dir):
    return rounded(A.label_by_year(views.core(spark, sf_dir)))


@query("agg8", HOLDOUT)
def agg8(spark, sf_dir):
    return A.holdout_preview(positions(spark, sf_dir))


@query("agg9", CV)
def agg9(spark, sf_dir):
    return rounded(A.cv_preview(positions(spark, sf_dir)))


def risk_sql(x: str) -> str:
    return f"CASE WHEN {x} > 1000000000 THEN 'high' WHEN {x} > 100000000 THEN 'moderate' ELSE 'low' END"


READY = f"""
WITH lab AS ({LABEL_TABLE}), cov AS ({COVERAGE}), cvp AS ({CV}),
tot AS (SELECT scope, coalesce(CAST(sum(count) FILTER (WHERE ok) AS BIGINT), 0) AS usable_rows,
  coalesce(string_agg(normalized_severity, ',' ORDER BY normalized_severity) FILTER (WHERE ok AND count < 100), '') AS rare,
  coalesce(string_agg(normalized_severity, ',' ORDER BY normalized_severity) FILTER (WHERE ok AND count < 20), '') AS small,
  least({', '.join(
      f"coalesce(sum(count) FILTER (WHERE ok AND normalized_severity IN {in_list(m)}), 0)"
      for m in LABEL_GROUPS.values())}) AS least_group
  FROM (SELECT *, NOT is_excluded AND NOT is_missing_or_blank AS ok FROM lab) GROUP BY 1),
fc AS (SELECT scope, count(DISTINCT fold) AS folds FROM cvp WHERE partition = 'validation' GROUP BY 1),
j AS (SELECT tot.*, future_only_classes, invalid_dates, coalesce(folds, 0) AS cv_fold_count,
  CASE WHEN usable_rows < 500 OR small <> '' OR future_only_classes <> '' OR coalesce(folds, 0) = 0 THEN 'FAIL'
       WHEN rare <> '' OR invalid_dates > 0 THEN 'WARNING' ELSE 'PASS' END AS status
  FROM tot JOIN cov ON tot.scope = cov.scope LEFT JOIN fc ON tot.scope = fc.scope),
vol AS (SELECT CAST(sum(length(summary) + length(description)) AS BIGINT) AS ch FROM v_core)
SELECT scope, status, usable_rows, rare AS rare_classes, future_only_classes, cv_fold_count, invalid_dates,
  least_group >= 20 AS grouped_classification_feasible, status <> 'FAIL' AS within_project_feasible,
  coalesce(nullif(concat_ws('; ', CASE WHEN usable_rows < 500 THEN 'usable rows ' || usable_rows || ' < 500' END,
    CASE WHEN small <> '' THEN 'classes below minimum: ' || small END,
    CASE WHEN rare <> '' THEN 'rare classes: ' || rare END,
    CASE WHEN future_only_classes <> '' THEN 'classes only in test period: ' || future_only_classes END,
    CASE WHEN invalid_dates > 0 THEN 'invalid dates: ' || invalid_dates END), ''), 'configured thresholds satisfied') AS reasons,
  (SELECT bool_or(scope = 'combined' AND status <> 'FAIL') FROM j) AS pooled_feasible,
  (SELECT count(*) FILTER (WHERE scope <> 'combined' AND status <> 'FAIL') >= 2 FROM j) AS cross_project_feasible,
  (SELECT ch FROM vol) AS estimated_text_characters, (SELECT {risk_sql('ch')} FROM vol) AS feature_building_risk
FROM j"""


def _audit_tables(spark, sf_dir):
    core, pos = views.core(spark, sf_dir), positions(spark, sf_dir)

    def build(name, make):
        return views.remember(spark, sf_dir, name, make)

    labels = build("label_table", lambda: A.label_table(core))
    text = build("text_audit", lambda: A.text_audit(core))
    holdout = build("holdout_preview", lambda: A.holdout_preview(pos))
    cv = build("cv_preview", lambda: A.cv_preview(pos))
    temporal = build("temporal_coverage", lambda: A.temporal_coverage(core, holdout, cv))
    return core, labels, text, holdout, cv, temporal


@query("agg10", READY)
def agg10(spark, sf_dir):
    _, labels, text, _, cv, temporal = _audit_tables(spark, sf_dir)
    return rounded(A.readiness(labels, temporal, cv, text))


@query(
    "agg11",
    f"""WITH man AS ({MANIFEST_SQL}), lab2 AS ({LABEL_TABLE}), hold2 AS ({HOLDOUT}), cv2 AS ({CV}), ready AS ({READY}),
want AS (SELECT scope, count(*) AS n FROM lab2 WHERE NOT is_excluded AND NOT is_missing_or_blank GROUP BY 1),
fv AS (SELECT scope, {', '.join(f"count(DISTINCT severity) FILTER (WHERE fold = {i}) AS f{i}" for i in (1, 2, 3))}
  FROM cv2 WHERE partition = 'validation' GROUP BY 1),
lc AS (SELECT scope, {', '.join(
    f"CAST(coalesce(sum(count) FILTER (WHERE normalized_severity = '{x}'), 0) AS BIGINT) AS \"severity_{x}\"" for x in OBSERVED)}
  FROM lab2 GROUP BY 1),
hc AS (SELECT scope, CAST(sum(count) FILTER (WHERE partition = 'development') AS BIGINT) AS development_size,
  CAST(sum(count) FILTER (WHERE partition = 'test') AS BIGINT) AS test_size, {', '.join(
    f"CAST(coalesce(sum(count) FILTER (WHERE partition = 'test' AND severity = '{x}'), 0) AS BIGINT) AS \"test_{x}\"" for x in OBSERVED)}
  FROM hold2 GROUP BY 1),
base AS (SELECT source_project AS scope, count(*) FILTER (WHERE dupe_of <> '') AS links, min(creation_time) AS lo,
  max(creation_time) AS hi, avg(length(summary) + length(description)) AS mean_chars FROM v_core GROUP BY 1)
SELECT source_project AS project, raw_row_count AS raw_rows, usable_rows AS modeling_eligible_rows,
  missing_text_count AS missing_text_rows, invalid_date_count AS invalid_date_rows,
  exact_duplicate_row_count AS exact_duplicate_rows, links AS dupe_of_relationships,
  CAST(lo AS VARCHAR) AS minimum_creation_time, CAST(hi AS VARCHAR) AS maximum_creation_time,
  development_size, test_size, status AS within_project_readiness,
  {risk_sql('usable_rows * mean_chars')} AS feature_building_risk,
  {', '.join(f'"severity_{x}"' for x in OBSERVED)}, {', '.join(f'"test_{x}"' for x in OBSERVED)},
  {', '.join(f"coalesce(f{i}, 0) >= n AS cv_fold_{i}_viable" for i in (1, 2, 3))}
FROM man JOIN base ON base.scope = source_project JOIN lc ON lc.scope = source_project
LEFT JOIN hc ON hc.scope = source_project LEFT JOIN want ON want.scope = source_project
LEFT JOIN fv ON fv.scope = source_project JOIN ready ON ready.scope = source_project""",
)
def agg11(spark, sf_dir):
    core, labels, text, holdout, cv, temporal = _audit_tables(spark, sf_dir)
    ready = A.readiness(labels, temporal, cv, text)
    return rounded(
        A.project_summary(
            manifest(core, config_fingerprint()),
            labels,
            text,
            temporal,
            holdout,
            cv,
            ready,
            link_counts(core),
            OBSERVED,
        )
    )


NAMED = [x for x in OBSERVED if x]


@query(
    "agg12",
    "SELECT source_project AS project, "
    + ", ".join(f"count(*) FILTER (WHERE {norm('severity')} = '{x}') AS {x}" for x in NAMED)
    + " FROM v_core GROUP BY 1",
)
def agg12(spark, sf_dir):
    return A.class_matrix(A.label_table(views.core(spark, sf_dir)), NAMED)


@query(
    "agg13",
    f"SELECT scope, CAST(sum(length(summary) + length(description)) AS BIGINT) AS characters,"
    f" {risk_sql('sum(length(summary) + length(description))')} AS risk FROM {SCOPES} GROUP BY 1",
)
def agg13(spark, sf_dir):
    return A.text_volume(A.text_audit(views.core(spark, sf_dir)))


def json_sql(column: str) -> str:
    return (
        f"(SELECT year, '{{' || string_agg('\"' || {column} || '\":' || n, ',' ORDER BY {column}) || '}}' AS j FROM"
        f" (SELECT year(creation_time) AS year, {column}, count(*) AS n FROM v_eligible GROUP BY 1, 2) GROUP BY 1)"
    )


@query(
    "agg14",
    f"""SELECT CAST(y.year AS BIGINT) AS year, y.* EXCLUDE (year), p.j AS product_distribution, c.j AS component_distribution FROM (
  SELECT year(creation_time) AS year, count(*) AS reports,
    round(avg(length(summary) + length(description) + 1), 6) AS mean_text_length,
    round(median(length(summary) + length(description) + 1), 6) AS median_text_length,
    count(DISTINCT product) AS products, count(DISTINCT component) AS components,
    {', '.join(f"count(*) FILTER (WHERE severity = '{x}') AS {x}" for x in LABELS)}
  FROM v_eligible GROUP BY 1) y JOIN {json_sql('product')} p ON p.year = y.year JOIN {json_sql('component')} c ON c.year = y.year""",
)
def agg14(spark, sf_dir):
    return rounded(A.temporal_drift(eligible_reports(views.core(spark, sf_dir))))


@query(
    "agg15",
    f"""WITH w AS (SELECT DISTINCT year(creation_time) AS year, unnest(regexp_extract_all(lower(summary), '[^{WS[1:-1]}]+')) AS word FROM v_eligible),
y AS (SELECT year, lag(year) OVER (ORDER BY year) AS prev FROM (SELECT DISTINCT year(creation_time) AS year FROM v_eligible)),
n AS (SELECT year, count(*) AS n FROM w GROUP BY 1),
s AS (SELECT y.year, count(*) AS shared FROM y JOIN w a ON a.year = y.year JOIN w b ON b.year = y.prev AND a.word = b.word GROUP BY 1)
SELECT CAST(y.year AS BIGINT) AS year, coalesce(a.n, 0) AS summary_vocabulary,
  CASE WHEN y.prev IS NOT NULL THEN round(coalesce(shared, 0) / greatest(coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(shared, 0), 1), 6) END AS jaccard_vs_previous
FROM y LEFT JOIN n a ON a.year = y.year LEFT JOIN n b ON b.year = y.prev LEFT JOIN s ON s.year = y.year""",
)
def agg15(spark, sf_dir):
    return rounded(A.vocabulary_drift(eligible_reports(views.core(spark, sf_dir))))


QUALITY = {
    "rows": "count(*)",
    "additional_exclusions": "count(*) * 0",
    "blank_summary": f"count(*) FILTER (WHERE {strip('summary')} = '')",
    "blank_description": f"count(*) FILTER (WHERE {strip('description')} = '')",
    "both_blank": f"count(*) FILTER (WHERE {strip('summary')} = '' AND {strip('description')} = '')",
    "very_short_under_20_chars": f"count(*) FILTER (WHERE length({COMBINED}) < 20)",
    "extremely_long_over_10000_chars": f"count(*) FILTER (WHERE length({COMBINED}) > 10000)",
    "replacement_character": f"count(*) FILTER (WHERE contains({COMBINED}, chr(65533)))",
}


@query(
    "agg16",
    " UNION ALL ".join(
        f"SELECT '{k}' AS metric, CAST({v} AS BIGINT) AS value FROM v_reports"
        for k, v in QUALITY.items()
    ),
)
def agg16(spark, sf_dir):
    return A.quality_metrics(views.reports(spark, sf_dir))


@query(
    "agg17",
    "SELECT severity, "
    + ", ".join(
        f"count(*) AS {n}_count, round(avg({e}), 6) AS {n}_mean, round(median({e}), 6) AS {n}_median,"
        f" min({e}) AS {n}_min, max({e}) AS {n}_max"
        for n, e in (("characters", f"length({COMBINED})"), ("tokens", tokens(COMBINED)))
    )
    + " FROM v_eligible GROUP BY 1",
)
def agg17(spark, sf_dir):
    return rounded(A.length_by_class(eligible_reports(views.core(spark, sf_dir))))


@query(
    "agg18",
    "SELECT task, year, target, n AS rows, round(n / sum(n) OVER (PARTITION BY task, year), 6) AS percentage_within_year FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS task, CAST(year(creation_time) AS BIGINT) AS year, {case_map('severity', m)} AS target,"
        " count(*) AS n FROM v_eligible GROUP BY 1, 2, 3"
        for t, m in TASKS.items()
    )
    + ")",
)
def agg18(spark, sf_dir):
    return rounded(A.task_labels_by_year(eligible_reports(views.core(spark, sf_dir)), TASKS))


METADATA = ["classification", "product", "component", "version", "platform", "os", "keywords"]


def profile_sql(c: str) -> str:
    return f"""SELECT '{c}' AS name, true AS availability,
  round(coalesce(sum(n) FILTER (WHERE level IS NULL), 0) / sum(n), 6) AS missingness,
  count(level) AS cardinality,
  round(coalesce(sum(n) FILTER (WHERE level IS NOT NULL AND n < 5), 0) / sum(n), 6) AS rare_category_rate,
  string_agg(level || '=' || n, ',' ORDER BY n DESC, level) FILTER (WHERE rk <= 10 AND level IS NOT NULL) AS top_levels
FROM (SELECT *, row_number() OVER (PARTITION BY level IS NULL ORDER BY n DESC, level) AS rk
      FROM (SELECT {c} AS level, count(*) AS n FROM v_core GROUP BY 1))"""


@query(
    "agg19",
    " UNION ALL ".join(
        profile_sql(c)
        if c in ("product", "component")
        else f"SELECT '{c}', false, 1.0::DOUBLE, 0, 0.0::DOUBLE, ''"
        for c in ["product", "component", *[m for m in METADATA if m not in ("product", "component")]]
    ),
)
def agg19(spark, sf_dir):
    return rounded(A.metadata_profile(views.core(spark, sf_dir), METADATA))


def dense_sql(source: str, side: str) -> str:
    keys = [k.strip() for k in side.split(",")]
    on = " AND ".join(f"c.{k} = s.{k}" for k in keys)
    return f"""SELECT {', '.join('s.' + k for k in keys)}, l.label AS severity, coalesce(c.n, 0) AS count, s.n AS side_rows
FROM (SELECT {side}, count(*) AS n FROM {source} GROUP BY ALL) s CROSS JOIN {label_rows(TICKET_LABELS)} l
LEFT JOIN (SELECT {side}, severity, count(*) AS n FROM {source} GROUP BY ALL) c ON {on} AND c.severity = l.label"""


@query(
    "agg20",
    f"SELECT partition, severity, count, side_rows, round(count / side_rows, 6) AS share FROM ({dense_sql('v_split', 'partition')})",
)
def agg20(spark, sf_dir):
    counts = S.class_counts(
        views.positioned_tickets(spark, sf_dir), ["partition"], "severity", TICKET_LABELS
    )
    return rounded(counts.withColumn("share", F.col("count") / F.col("side_rows")))


@query(
    "agg21",
    f"""SELECT 'holdout' AS plan, 0::BIGINT AS fold, partition AS side, severity, count, count = 0 AS is_gap FROM ({dense_sql('v_split', 'partition')})
UNION ALL SELECT 'folds', fold, role, severity, count, count = 0 FROM ({dense_sql('v_folds', 'fold, role')})""",
)
def agg21(spark, sf_dir):
    """Coverage of every label on every side; gaps would be refused by the gate."""
    holdout = S.class_counts(
        views.positioned_tickets(spark, sf_dir), ["partition"], "severity", TICKET_LABELS
    )
    folds = S.class_counts(
        views.ticket_folds(spark, sf_dir), ["fold", "role"], "severity", TICKET_LABELS
    )
    gap = (F.col("count") == 0).alias("is_gap")
    both = holdout.select(
        F.lit("holdout").alias("plan"),
        F.lit(0).alias("fold"),
        F.col("partition").alias("side"),
        "severity",
        "count",
        gap,
    ).unionByName(
        folds.select(
            F.lit("folds").alias("plan"), "fold", F.col("role").alias("side"), "severity",
            "count", gap,
        )
    )
    return rounded(both)


@query(
    "agg22",
    "SELECT CAST(fold AS BIGINT) AS fold, role, severity, count(*) AS count,"
    " CAST(sum(count(*)) OVER (PARTITION BY fold, role) AS BIGINT) AS rows_in_partition"
    " FROM v_folds GROUP BY fold, role, severity",
)
def agg22(spark, sf_dir):
    counts = S.class_counts(
        views.ticket_folds(spark, sf_dir), ["fold", "role"], "severity", TICKET_LABELS
    )
    return rounded(
        counts.filter(F.col("count") > 0).withColumnRenamed("side_rows", "rows_in_partition")
    )


def third_sql(pos: str, n: str) -> str:
    return (
        f"CASE WHEN 3 * ({pos} + 1) <= 3 + ({n} - 1) THEN 'early'"
        f" WHEN 3 * ({pos} + 1) <= 3 + 2 * ({n} - 1) THEN 'middle' ELSE 'late' END"
    )


MINORITY = ["blocker", "critical", "minor", "trivial"]


@query(
    "agg23",
    f"""WITH a AS (SELECT global_report_key, source_project, severity, {third_sql('pos', 'n')} AS third FROM (
    SELECT *, row_number() OVER (PARTITION BY source_project ORDER BY creation_time, global_report_key) - 1 AS pos,
      count(*) OVER (PARTITION BY source_project) AS n FROM v_eligible)),
b AS (SELECT global_report_key, severity, {third_sql('pos', 'n')} AS third FROM (
    SELECT *, row_number() OVER (ORDER BY creation_time, global_report_key) - 1 AS pos, count(*) OVER () AS n
    FROM v_eligible WHERE severity IN {in_list(MINORITY)}))
SELECT 'project_stratum' AS variant, source_project, severity, third, global_report_key, rank_in_group FROM (
  SELECT *, row_number() OVER (PARTITION BY source_project, severity, third ORDER BY md5(global_report_key || '#42'), global_report_key) AS rank_in_group FROM a)
  WHERE rank_in_group <= 2
UNION ALL SELECT 'minority', '', severity, third, global_report_key, rank_in_group FROM (
  SELECT *, row_number() OVER (PARTITION BY severity, third ORDER BY md5(global_report_key || '#42'), global_report_key) AS rank_in_group FROM b)
  WHERE rank_in_group <= 10
UNION ALL SELECT 'first_per_label', '', severity, '', global_report_key, rank_in_group FROM (
  SELECT *, row_number() OVER (PARTITION BY severity ORDER BY creation_time, global_report_key) AS rank_in_group FROM v_eligible
  WHERE severity IN {in_list(MINORITY)}) WHERE rank_in_group <= 20""",
)
def agg23(spark, sf_dir):
    from triagemill.operators.evaluation import first_rows_per_group

    rows = eligible_reports(views.core(spark, sf_dir)).select(
        "global_report_key", "source_project", "severity", "creation_time"
    )
    order = ["creation_time", "global_report_key"]
    third = thirds(F.col("pos"), F.col("n_rows"), "qcut")
    per_project = with_position(rows, order, scope="source_project").withColumn("third", third)
    minority = with_position(rows.filter(F.col("severity").isin(MINORITY)), order).withColumn(
        "third", third
    )
    columns = [
        "variant", "source_project", "severity", "third", "global_report_key", "rank_in_group"
    ]
    blank = F.lit("")
    parts = [
        A.review_sample(
            per_project, ["source_project", "severity", "third"], "global_report_key", 2
        ).withColumn("variant", F.lit("project_stratum")),
        A.review_sample(minority, ["severity", "third"], "global_report_key", 10).withColumns(
            {"variant": F.lit("minority"), "source_project": blank}
        ),
        first_rows_per_group(minority, ["severity"], order, 20, ["global_report_key"]).withColumns(
            {"variant": F.lit("first_per_label"), "source_project": blank, "third": blank}
        ),
    ]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return rounded(out)


