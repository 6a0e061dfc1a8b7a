"""The adapter views as SQL, for the side-by-side check of registered queries."""

from __future__ import annotations

import re

from triagemill.constants import LABEL_EXCLUSIONS, LABELS
from triagemill.functions.text import NON_SPACE, SPACE, WORD

WS, NWS, W = SPACE, NON_SPACE, WORD


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def norm(x: str) -> str:
    return f"lower({strip(f'coalesce({x}, chr(32))')})"


def tokens(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{NWS}+')) AS BIGINT)"


def digest(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def label_rows(labels, name="label") -> str:
    return (
        "(SELECT * FROM (VALUES "
        + ", ".join(f"('{x}', {i})" for i, x in enumerate(labels))
        + f") AS t({name}, ord))"
    )


VIEWS: dict[str, str] = {}

VIEWS["v_reports"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS issue_id, d.doc_id AS doc_key,
  d.source AS source_project, d.lang AS product,
  d.lang || '-' || CAST(d.doc_id % 3 AS VARCHAR) AS component,
  CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, 1, strpos(d.text, chr(10)) - 1)
       ELSE d.text END AS summary,
  CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1)
       ELSE '' END AS description,
  CASE WHEN l.doc_id IS NOT NULL THEN
         CASE WHEN quality = 1 AND toxic = 0 THEN 'normal' WHEN quality = 1 AND toxic = 1 THEN 'major'
              WHEN quality = 0 AND toxic = 0 THEN 'minor' ELSE 'blocker' END
       ELSE CASE d.doc_id % 8 WHEN 0 THEN 'critical' WHEN 1 THEN 'trivial' WHEN 2 THEN 'enhancement'
              WHEN 3 THEN '' WHEN 4 THEN 'normal' WHEN 5 THEN 'MAJOR' WHEN 6 THEN 'blocker'
              ELSE ' Minor ' END END AS severity,
  CASE WHEN d.doc_id % 97 <> 5
       THEN TIMESTAMP '2015-01-01 00:00:00' + to_hours(CAST((d.doc_id * 7919) % 100003 AS INTEGER))
       END AS creation_time,
  CASE WHEN d.doc_id % 50 = 3 THEN 'missing-' || CAST(d.doc_id // 100 AS VARCHAR)
       WHEN d.doc_id % 50 = 4 THEN d.source || ':' || CAST(d.doc_id - 4 AS VARCHAR)
       WHEN d.doc_id % 5 IN (1, 2) THEN CAST(d.doc_id - 1 AS VARCHAR) ELSE '' END AS dupe_of
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

VIEWS["v_core"] = f"""
SELECT '' AS issue_url, issue_id, source_project, source_project || '_dataset_issues.csv' AS source_file,
  source_project || ':' || issue_id AS global_report_key, product, component, summary, description,
  severity, creation_time, dupe_of,
  {strip('summary')} <> '' AS has_valid_summary, {strip('description')} <> '' AS has_valid_description,
  ({strip('summary')} <> '' OR {strip('description')} <> '') AS has_valid_text,
  {norm('severity')} <> '' AS has_valid_severity,
  {norm('severity')} IN {in_list(LABEL_EXCLUSIONS)} AS is_excluded_label,
  creation_time IS NOT NULL AS has_valid_creation_time,
  sha256({strip(collapse("lower(summary || chr(10) || description)"))}) AS exact_text_hash,
  CASE WHEN dupe_of <> '' THEN source_project || ':' || dupe_of
       ELSE source_project || ':' || issue_id END AS duplicate_group_id,
  doc_key
FROM v_reports"""

VIEWS["v_eligible"] = f"""
SELECT * REPLACE ({norm('severity')} AS severity) FROM v_core
WHERE {norm('severity')} IN {in_list(LABELS)} AND creation_time IS NOT NULL AND has_valid_text"""

VIEWS["v_tickets"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS seq, o_custkey AS customer,
  n_name AS project, c_mktsegment AS component, o_orderpriority AS severity,
  CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
       WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS rank,
  o_orderdate AS creation_time,
  CASE WHEN o_orderkey % 11 <> 0
       THEN CAST(o_custkey AS VARCHAR) || '-' || CAST(o_orderkey % 40 AS VARCHAR) END AS duplicate_group
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

VIEWS["v_split"] = """
SELECT *, CASE WHEN pos < floor(n_rows * 0.8::DOUBLE) THEN 'development' ELSE 'test' END AS partition
FROM (SELECT *, row_number() OVER (ORDER BY creation_time, seq) - 1 AS pos, count(*) OVER () AS n_rows
      FROM v_tickets)"""

VIEWS["v_folds"] = """
SELECT s.* EXCLUDE (first_pos), CAST(f.fold AS INTEGER) AS fold,
  CASE WHEN pos < n_rows - (4 - fold) * (n_rows // 4) THEN 'train' ELSE 'validation' END AS role
FROM (SELECT *, min(pos) OVER (PARTITION BY coalesce(duplicate_group, 'own:' || id)) AS first_pos FROM v_split) s
CROSS JOIN (SELECT unnest([1, 2, 3]) AS fold) f
WHERE pos < n_rows - (3 - fold) * (n_rows // 4)
  AND (pos < n_rows - (4 - fold) * (n_rows // 4) OR first_pos >= n_rows - (4 - fold) * (n_rows // 4))"""

VIEWS["v_predictions"] = """
SELECT q.id, q.fold, q.model, q.project, q.component, q.true_label, q.predicted_label, q.true_rank,
  r.ord AS predicted_rank, q.creation_time, q.pos, q.n_rows
FROM (
  SELECT f.id, f.fold, m.model, f.project, f.component, f.severity AS true_label,
    CASE m.model WHEN 'component_majority' THEN j.majority WHEN 'project_majority' THEN h.majority
      ELSE coalesce(p.previous, j.majority) END AS predicted_label,
    f.rank AS true_rank, f.creation_time, f.pos, f.n_rows
  FROM v_folds f
  CROSS JOIN (SELECT unnest(['component_majority', 'previous_ticket', 'project_majority']) AS model) m
  JOIN (SELECT fold, component, arg_min(severity, (-n, severity)) AS majority
        FROM (SELECT fold, component, severity, count(*) AS n FROM v_folds WHERE role = 'train'
              GROUP BY ALL) GROUP BY ALL) j ON f.fold = j.fold AND f.component = j.component
  LEFT JOIN (SELECT fold, project, arg_min(severity, (-n, severity)) AS majority
        FROM (SELECT fold, project, severity, count(*) AS n FROM v_folds WHERE role = 'train'
              GROUP BY ALL) GROUP BY ALL) h ON f.fold = h.fold AND f.project = h.project
  JOIN (SELECT id, lag(severity) OVER (PARTITION BY customer ORDER BY creation_time, seq) AS previous
        FROM v_tickets) p ON f.id = p.id
  WHERE f.role = 'validation') q
JOIN (SELECT * FROM (VALUES ('5-LOW', 0), ('4-NOT SPECIFIED', 1), ('3-MEDIUM', 2), ('2-HIGH', 3),
      ('1-URGENT', 4)) t(label, ord)) r ON r.label = q.predicted_label"""

VIEWS["v_report_docs"] = """
SELECT global_report_key, source_project, severity, creation_time, component,
  duplicate_group_id AS duplicate_group, summary, description,
  row_number() OVER (ORDER BY creation_time, global_report_key) - 1 AS pos, count(*) OVER () AS n_rows
FROM (SELECT *, row_number() OVER (PARTITION BY exact_text_hash ORDER BY creation_time, global_report_key) AS rn
      FROM v_eligible) WHERE rn = 1"""

VIEWS["v_report_folds"] = """
SELECT s.* EXCLUDE (first_pos), CAST(f.fold AS INTEGER) AS fold,
  CASE WHEN pos < n_rows - (4 - fold) * (n_rows // 4) THEN 'train' ELSE 'validation' END AS role
FROM (SELECT * EXCLUDE (summary, description), min(pos) OVER (PARTITION BY duplicate_group) AS first_pos
      FROM v_report_docs) s
CROSS JOIN (SELECT unnest([1, 2, 3]) AS fold) f
WHERE pos < n_rows - (3 - fold) * (n_rows // 4)
  AND (pos < n_rows - (4 - fold) * (n_rows // 4) OR first_pos >= n_rows - (4 - fold) * (n_rows // 4))"""

VIEWS["v_report_fold_predictions"] = """
SELECT f.global_report_key, f.fold, m.model, f.severity AS true_label,
  CASE m.model WHEN 'component_majority' THEN coalesce(j.majority, o.majority) ELSE o.majority END AS predicted_label
FROM v_report_folds f
CROSS JOIN (SELECT unnest(['component_majority', 'overall_majority']) AS model) m
LEFT JOIN (SELECT fold, component, arg_min(severity, (-n, severity)) AS majority
      FROM (SELECT fold, component, severity, count(*) AS n FROM v_report_folds WHERE role = 'train'
            GROUP BY ALL) GROUP BY ALL) j ON f.fold = j.fold AND f.component = j.component
JOIN (SELECT fold, arg_min(severity, (-n, severity)) AS majority
      FROM (SELECT fold, severity, count(*) AS n FROM v_report_folds WHERE role = 'train'
            GROUP BY ALL) GROUP BY ALL) o ON f.fold = o.fold
WHERE f.role = 'validation'"""

VIEWS["v_report_predictions"] = """
SELECT global_report_key AS report_id, e.severity AS true_label, m.predicted_label,
  e.severity = m.predicted_label AS correct, summary, description, creation_time, product, e.component
FROM v_eligible e JOIN (
  SELECT component, arg_min(severity, (-n, severity)) AS predicted_label
  FROM (SELECT component, severity, count(*) AS n FROM v_eligible GROUP BY ALL) GROUP BY component
) m ON e.component = m.component"""

VIEWS["v_probabilities"] = """
SELECT id, seq, s.component, partition, severity AS true_label, rank AS true_rank,
  [r0, CASE WHEN seq % 6 = 0 THEN r2 ELSE r1 END, CASE WHEN seq % 6 = 0 THEN r1 ELSE r2 END, r3] AS q
FROM v_split s JOIN (
  SELECT component, avg((rank > 0)::INTEGER) AS r0, avg((rank > 1)::INTEGER) AS r1,
    avg((rank > 2)::INTEGER) AS r2, avg((rank > 3)::INTEGER) AS r3
  FROM v_split WHERE partition = 'development' GROUP BY component) r ON s.component = r.component"""


def with_views(body: str) -> str:
    """Prepend the definitions of the views that ``body`` uses, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    text = body.strip()
    recursive = text.upper().startswith("WITH RECURSIVE")
    if text.upper().startswith("WITH"):
        inner = text[len("WITH RECURSIVE" if recursive else "WITH"):]
        head = "WITH RECURSIVE " if recursive else "WITH "
        return head + (ctes + ",\n" if ctes else "") + inner
    return (f"WITH {ctes}\n" if ctes else "") + text
