"""Text, date and array functions as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagemill.constants import LABEL_WORDS
from triagemill.functions import text as X
from triagemill.operators import audits
from triagemill.operators.eligibility import eligible_reports
from triagemill.operators.positions import thirds, with_position
from triagemill.plans.oracle_views import NWS, WS, W, collapse, strip, tokens
from triagemill.plans.registry import query, rounded
from triagemill.sources import views

URL_SQL = f"(?i)(https?://{NWS}+|www\\.{NWS}+)"
EMAIL_W_SQL = r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
EMAIL_A_SQL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
COMBINED = "summary || chr(10) || description"
AUDIT_WORDS = [*LABEL_WORDS, "the", "of", "and"]


def decoded_sql(x: str) -> str:
    """HTML entities that occur in the pages, decoded once, the ampersand last.

    As in HTML, the final semicolon of the names may be missing.
    """
    x = f"replace({x}, '&#39;', '''')"
    for entity, char in (
        ("&lt", "<"),
        ("&gt", ">"),
        ("&quot", '"'),
        ("&nbsp", " "),
        ("&eacute", "é"),
        ("&copy", "©"),
        ("&middot", "·"),
        ("&amp", "&"),
    ):
        x = f"regexp_replace({x}, '{entity};?', '{char}', 'g')"
    return x


def clean_sql(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = f"regexp_replace(lower({x}), '{URL_SQL}', ' [URL] ', 'g')"
    x = f"regexp_replace({x}, '{EMAIL_W_SQL}', ' [EMAIL] ', 'g')"
    return strip(collapse(x))


def tagged_sql(summary: str = "summary", description: str = "description", mask=False) -> str:
    x = f"replace('[SUMMARY] ' || {summary} || ' [DESCRIPTION] ' || {description}, chr(13) || chr(10), chr(10))"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = f"regexp_replace({x}, '{URL_SQL}', ' [URL] ', 'g')"
    x = f"regexp_replace({x}, '{EMAIL_A_SQL}', ' [EMAIL] ', 'g')"
    issue = rf"(?i)\b(?:bug{WS}*#?|issue{WS}*#?|bz{WS}*#?)\d{{3,}}\b"
    x = f"regexp_replace({x}, '{issue}', ' [ISSUE_ID] ', 'g')"
    x = rf"regexp_replace({x}, '(?i)\b(?:0x)?[0-9a-f]{{10,}}\b', ' [HEX] ', 'g')"
    if mask:
        words = "|".join(LABEL_WORDS)
        x = rf"regexp_replace({x}, '(?i)\b({words})\b', ' [SEVERITY_TERM] ', 'g')"
    return f"lower({strip(collapse(x))})"


@query("txt1", f"SELECT page_id, sha256({clean_sql(decoded_sql('html'))}) AS text_hash FROM pages")
def txt1(spark, sf_dir):
    pages = views.spread(views.table(spark, sf_dir, "pages"), "page_id")
    return pages.select("page_id", F.sha2(X.clean_text(F.col("html")), 256).alias("text_hash"))


REPRESENTATIONS = {
    "summary": "summary",
    "description": "description",
    "summary_description": "summary || ' ' || chr(10) || ' ' || description",
}


@query(
    "txt2",
    " UNION ALL ".join(
        f"SELECT issue_id, '{k}' AS representation, sha256({clean_sql(v)}) AS text_hash FROM v_reports"
        for k, v in REPRESENTATIONS.items()
    ),
)
def txt2(spark, sf_dir):
    df = views.reports(spark, sf_dir)
    cleaned = X.clean_representations(F.col("summary"), F.col("description"), list(REPRESENTATIONS))
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("representation"), F.sha2(text, 256).alias("text_hash"))
            for k, text in cleaned.items()
        ]
    )
    return df.select("issue_id", F.explode(entries).alias("e")).select("issue_id", "e.*")


@query(
    "txt3",
    f"SELECT issue_id, sha256({tagged_sql()}) AS tagged, sha256({tagged_sql(mask=True)}) AS masked"
    " FROM v_reports",
)
def txt3(spark, sf_dir):
    s, d = F.col("summary"), F.col("description")
    return views.reports(spark, sf_dir).select(
        "issue_id",
        F.sha2(X.tagged_clean(s, d), 256).alias("tagged"),
        F.sha2(X.tagged_clean(s, d, True), 256).alias("masked"),
    )


@query("txt4", "SELECT issue_id, exact_text_hash FROM v_core")
def txt4(spark, sf_dir):
    return views.reports(spark, sf_dir).select(
        "issue_id",
        X.exact_text_hash(F.col("summary"), F.col("description")).alias("exact_text_hash"),
    )


@query(
    "txt5",
    f"SELECT issue_id, sha256({COMBINED}) AS raw_hash, sha256({tagged_sql()}) AS normalized_hash"
    " FROM v_reports",
)
def txt5(spark, sf_dir):
    s, d = F.col("summary"), F.col("description")
    return views.reports(spark, sf_dir).select(
        "issue_id",
        X.raw_text_hash(s, d).alias("raw_hash"),
        X.normalized_text_hash(s, d).alias("normalized_hash"),
    )


def redact_sql(x: str, email: str = f"{NWS}*@{NWS}*") -> str:
    return f"regexp_replace(regexp_replace({x}, '{email}', '[EMAIL]', 'g'), '{URL_SQL}', '[URL]', 'g')"


@query(
    "txt6",
    f"SELECT issue_id, sha256({redact_sql('description')}) AS redacted,"
    f" sha256(substr({redact_sql('description')}, 1, 1000)) AS redacted_then_cut,"
    f" sha256({redact_sql('substr(description, 1, 1000)')}) AS cut_then_redacted,"
    f" CAST(length({redact_sql('description')}) AS BIGINT) AS chars FROM v_reports",
)
def txt6(spark, sf_dir):
    d = F.col("description")
    return views.reports(spark, sf_dir).select(
        "issue_id",
        F.sha2(X.redact(d), 256).alias("redacted"),
        F.sha2(X.redact(d, 1000), 256).alias("redacted_then_cut"),
        F.sha2(X.cut_then_redact(d, 1000), 256).alias("cut_then_redacted"),
        F.length(X.redact(d)).cast("bigint").alias("chars"),
    )


STACK_SQL = rf"(?i)(?:^|\n){WS}*at{WS}+[\p{{L}}\p{{N}}_.$]+\([^\n]+\)"
CODE_LINE_SQL = rf"(?i)([{{}};]|(?:^|\n){WS}*(?:public|private|class|def|if|for)\b)"
CODE_MARK_SQL = rf"(?m)(```|Traceback \(|Exception in thread|^{WS}*at{WS}+{NWS}+)"
BUG_SQL = rf"(?i)\b(?:bug|issue|bz){WS}*#?{WS}*\d+\b"
HEX_SQL = r"(?i)\b(?:0x)?[0-9a-f]{10,}\b"
AUDIT_FLAGS = {
    "has_url": r"(?i)(https?://|www\.)",
    "has_email": EMAIL_W_SQL,
    "has_html": "<[^>]+>",
    "has_code": CODE_MARK_SQL,
}
STUDY_FLAGS = {
    "html": "<[^>]+>",
    "html_entity": r"&\w+;",
    "code": CODE_LINE_SQL,
    "stack_trace": STACK_SQL,
    "url": URL_SQL,
    "email": EMAIL_A_SQL,
    "bug_reference": BUG_SQL,
    "long_hex": HEX_SQL,
}


def flags_sql(text: str) -> str:
    return ", ".join(
        f"regexp_matches({text}, '{p}') AS {n}" for n, p in {**AUDIT_FLAGS, **STUDY_FLAGS}.items()
    )


@query(
    "txt7",
    f"SELECT 'page-' || page_id AS id, {flags_sql('html')} FROM pages UNION ALL"
    f" SELECT 'report-' || issue_id AS id, {flags_sql(COMBINED)} FROM v_reports",
)
def txt7(spark, sf_dir):
    pages = views.spread(views.table(spark, sf_dir, "pages"), "page_id").select(
        F.concat(F.lit("page-"), "page_id").alias("id"), F.col("html").alias("text")
    )
    reports = views.reports(spark, sf_dir).select(
        F.concat(F.lit("report-"), "issue_id").alias("id"),
        X.joined(F.col("summary"), F.col("description")).alias("text"),
    )
    both = pages.unionByName(reports)
    t = F.col("text")
    return both.select(
        "id",
        *[c.alias(n) for n, c in X.audit_indicators(t).items()],
        *[c.alias(n) for n, c in X.study_indicators(t).items()],
    )


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


LINES_SQL = (
    f"string_split_regex(CASE WHEN ends_with({COMBINED}, chr(10)) AND length({COMBINED}) > 1"
    f" THEN substr({COMBINED}, 1, length({COMBINED}) - 1) ELSE {COMBINED} END, chr(10))"
)
STRUCTURE_SQL = {
    "summary_chars": "length(summary)",
    "summary_tokens": tokens("summary"),
    "description_chars": "length(description)",
    "description_tokens": tokens("description"),
    "combined_chars": f"length({COMBINED})",
    "combined_tokens": tokens(COMBINED),
    "line_count": f"len({LINES_SQL})",
    "description_empty": f"({strip('description')} = '')::INTEGER",
    "digit_count": _count(COMBINED, r"\p{Nd}"),
    "digit_ratio": f"{_count(COMBINED, chr(92) + 'p{Nd}')} / greatest(length({COMBINED}), 1)",
    "upper_count": _count(COMBINED, r"\p{Lu}"),
    "upper_ratio": f"{_count(COMBINED, chr(92) + 'p{Lu}')} / greatest(length({COMBINED}), 1)",
    "punctuation_count": _count(COMBINED, rf"[^\p{{L}}\p{{N}}_{WS[1:-1]}]"),
    "exclamation_count": _count(COMBINED, "!"),
    "question_count": _count(COMBINED, r"\?"),
    "code_lines": f"len(list_filter({LINES_SQL}, lambda x: regexp_matches(x, '{CODE_LINE_SQL}')))",
    "has_stack_trace": f"regexp_matches({COMBINED}, '{STACK_SQL}')::INTEGER",
    "has_url": f"regexp_matches({COMBINED}, '{URL_SQL}')::INTEGER",
    "has_email": f"regexp_matches({COMBINED}, '{EMAIL_A_SQL}')::INTEGER",
    "has_html": f"regexp_matches({COMBINED}, '<[^>]+>')::INTEGER",
    "has_bug_reference": f"regexp_matches({COMBINED}, '{BUG_SQL}')::INTEGER",
    "has_long_hex": f"regexp_matches({COMBINED}, '{HEX_SQL}')::INTEGER",
}


@query(
    "txt8",
    "SELECT issue_id, "
    + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in STRUCTURE_SQL.items())
    + " FROM v_reports",
)
def txt8(spark, sf_dir):
    """22 of the 23 measurements; the repeated-character flag needs a back-reference."""
    df = views.reports(spark, sf_dir)
    columns = X.structural_features(F.col("summary"), F.col("description"))
    columns.pop("has_repeated_character")
    return rounded(df.select("issue_id", *[c.alias(n) for n, c in columns.items()]))


TOKENS_SQL = f"regexp_extract_all(lower({COMBINED}), '{W}{{2,}}')"


@query(
    "txt9",
    f"""WITH t AS (SELECT issue_id, {TOKENS_SQL} AS toks FROM v_reports),
g AS (SELECT issue_id, unnest(toks) AS term FROM t UNION ALL
  SELECT issue_id, toks[i] || ' ' || toks[i + 1] AS term FROM (SELECT issue_id, toks, unnest(range(1, len(toks))) AS i FROM t))
SELECT term, count(*) AS occurrences, count(DISTINCT issue_id) AS reports FROM g GROUP BY 1""",
)
def txt9(spark, sf_dir):
    df = views.reports(spark, sf_dir).select(
        "issue_id", X.word_tokens(X.joined(F.col("summary"), F.col("description"))).alias("t")
    )
    return audits.term_counts(df.select("issue_id", X.ngrams(F.col("t"), 1, 2).alias("terms")))


@query(
    "txt10",
    f"""WITH w AS (SELECT issue_id, unnest(regexp_extract_all(lower(summary), '{NWS}+')) AS word FROM v_reports),
p AS (SELECT issue_id, ' ' || word || ' ' AS word FROM w),
g AS (SELECT issue_id, substr(word, i, n) AS term FROM (
  SELECT issue_id, word, n, unnest(range(1, greatest(length(word) - n + 1, 1) + 1)) AS i
  FROM p CROSS JOIN (SELECT unnest([3, 4, 5]) AS n) WHERE n = 3 OR length(word) >= n))
SELECT term, count(*) AS occurrences, count(DISTINCT issue_id) AS reports FROM g GROUP BY 1""",
)
def txt10(spark, sf_dir):
    df = views.reports(spark, sf_dir).select(
        "issue_id", X.char_wb_ngrams(F.col("summary"), 3, 5).alias("terms")
    )
    return audits.term_counts(df)


def bucket_sql(length: str) -> str:
    return f"CASE WHEN {length} <= 200 THEN 'short' WHEN {length} <= 1000 THEN 'medium' ELSE 'long' END"


@query(
    "txt11",
    f"SELECT issue_id, {bucket_sql('length(summary) + length(description) + 1')} AS with_separator,"
    f" {bucket_sql('length(summary) + length(description)')} AS without_separator FROM v_reports",
)
def txt11(spark, sf_dir):
    s, d = F.col("summary"), F.col("description")
    return views.reports(spark, sf_dir).select(
        "issue_id",
        X.length_bucket(F.length(X.joined(s, d, " "))).alias("with_separator"),
        X.length_bucket(F.length(X.joined(s, d, ""))).alias("without_separator"),
    )


@query(
    "txt12",
    f"""WITH p AS (SELECT u.conv_id, u.turn, {tokens('u.text')} AS a, {tokens('coalesce(s.text, chr(32))')} AS b
  FROM conversations u LEFT JOIN conversations s ON u.conv_id = s.conv_id AND s.turn = u.turn + 1 AND s.role = 'assistant'
  WHERE u.role = 'user'),
k AS (SELECT *, least(a, 253) AS ka, least(b, greatest(0, 253 - least(a, 253))) AS kb FROM p)
SELECT count(*) AS rows, count(*) FILTER (WHERE a + b = 0) AS empty_text_count,
  round(avg((ka + kb < a + b)::INTEGER), 6) AS truncation_rate,
  count(*) FILTER (WHERE a = ka) AS first_preserved_rows,
  CAST(sum(ka + kb) AS BIGINT) AS kept_tokens,
  round(quantile_cont(a + b, 0.5), 6) AS p50, round(quantile_cont(a + b, 0.9), 6) AS p90,
  round(quantile_cont(a + b, 0.95), 6) AS p95, round(quantile_cont(a + b, 0.99), 6) AS p99 FROM k""",
)
def txt12(spark, sf_dir):
    """User turn and assistant reply as the text pair under a 256-token budget."""
    turns = views.table(spark, sf_dir, "conversations")
    user = turns.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    reply = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    pairs = user.join(reply, ["conv_id", "turn"], "left")
    budget = audits.token_budget(pairs, F.col("text"), F.col("reply"), 256, 3)
    return rounded(audits.token_budget_summary(budget))


@query(
    "txt13",
    " UNION ALL ".join(
        f"SELECT '{w}' AS term, '{f}' AS field, severity AS true_severity, count(*) AS reports FROM v_eligible"
        rf" WHERE regexp_matches({f}, '(?i)\b{w}\b') GROUP BY severity"
        for w in AUDIT_WORDS
        for f in ["summary", "description"]
    ),
)
def txt13(spark, sf_dir):
    """Label words, and three common words, as the texts hold few of the former."""
    rows = eligible_reports(views.core(spark, sf_dir))
    return audits.label_word_audit(rows, AUDIT_WORDS)


@query(
    "txt14",
    f"SELECT lower(substr({COMBINED}, 1, 40)) AS prefix, count(*) AS rows FROM v_reports GROUP BY 1"
    " ORDER BY rows DESC, prefix LIMIT 30",
)
def txt14(spark, sf_dir):
    return audits.boilerplate(views.reports(spark, sf_dir), 40, 30)


@query("txt15")
def txt15(spark, sf_dir):
    return audits.unicode_audit(views.reports(spark, sf_dir))


@query(
    "txt16",
    """SELECT id, CAST(year(creation_time) AS BIGINT) AS year,
  CASE WHEN pos + 1 <= 1 + (n_rows - 1) / 3 THEN 'early' WHEN pos + 1 <= 1 + 2 * (n_rows - 1) / 3 THEN 'middle'
       ELSE 'late' END AS quantile_third,
  CASE WHEN pos + 1 <= n_rows / 3 THEN 'early' WHEN pos + 1 <= 2 * n_rows / 3 THEN 'middle' ELSE 'late' END AS cut_third
FROM v_split""",
)
def txt16(spark, sf_dir):
    df = with_position(
        views.tickets(spark, sf_dir).select("id", "seq", "creation_time"), ["creation_time", "seq"]
    )
    return rounded(
        df.select(
            "id",
            F.year("creation_time").alias("year"),
            thirds(F.col("pos"), F.col("n_rows"), "qcut").alias("quantile_third"),
            thirds(F.col("pos"), F.col("n_rows"), "cut").alias("cut_third"),
        )
    )


