"""Text expressions take time in proportion to the text, and give what the plain rules give."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from triagemill.functions import text as X

SPACES = "[" + re.escape(X.SPACE_CHARS) + "]"
ODD = [
    "", " ", "@", "a@b", "@@ @", "a @ b", "x@y@z, w", " a@b　c", "\U0001f600@x \U0001f600", "a​@b",
    "no mail", "\x1cа@я\x85", "https://x@y.z/q www.a.b", " a  b\tc ", "\xa0\xa0a\n\nb\x0b", "a\r\nb", "\n",
    "a@b\nc@d e", "A@B.COM!", "퟿@", "tail@ ",
]


def test_redacted_runs(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "x string")
    found = [r[0] for r in rows.select(X.redact(F.col("x"))).collect()]
    space = SPACES.replace("[", "[^", 1)
    url = re.compile(f"(https?://{space}+|www\\.{space}+)", re.I)
    assert found == [url.sub("[URL]", re.sub(f"{space}*@{space}*", "[EMAIL]", x)) for x in ODD]


def test_redaction_of_one_long_run(spark):
    rows = spark.range(1).select(F.concat(F.lit("a@b "), F.repeat(F.lit("x"), 200_000)).alias("x"))
    began = time.perf_counter()
    assert rows.select(F.length(X.redact(F.col("x")))).first()[0] == 200_008
    assert time.perf_counter() - began < 20


def test_blanks_and_tokens(spark):
    texts = ODD + [f"a{x}b{x}{x}c {x}" for x in X.SPACE_CHARS]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    c, none = F.col("x"), F.lit("")
    both = X.structural_features(c, c)
    found = rows.select(X.collapse(c), X.token_count(c), X.token_count(none), both["combined_tokens"]).collect()
    for x, row in zip(texts, found):
        n = len([w for w in re.split(SPACES + "+", x) if w])
        assert tuple(row) == (re.sub(SPACES + "+", " ", x), n, 0, 2 * n)


def test_measuring_blanks_makes_no_rows_of_words(spark):
    rows = spark.range(1).select(F.lit("a b").alias("x"))
    plan = rows.select(X.token_count(F.col("x")))._jdf.queryExecution().analyzed().toString()
    assert "split(" not in plan


def test_lines(spark):
    texts = ["", "a", "\n", "\r\n", "a\n", "a\r\nb", "a\r", "\n\n", "a\x85b ", "a\x1fb\n;", "a\r\n\n if x"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    f = X.structural_features(F.lit(""), F.col("x"))
    for x, row in zip(texts, rows.select(f["line_count"], f["combined_chars"]).collect()):
        assert tuple(row) == (max(1, len(("\n" + x).splitlines())), len(x) + 1)


def test_fields_are_decoded_once(spark):
    fields = ["", "a &amp", "é", "́x", "&#64;", "ｶﾞ &copy", "amp; b", "\r\n", "ﬁ<b>", None]
    rows = spark.createDataFrame([(a, b) for a in fields for b in fields], "s string, d string")
    s, d = F.col("s"), F.col("d")
    names = ["summary", "description", "summary_description"]
    once = X.clean_representations(s, d, names)
    for name in names:
        plain = X.clean_text(X.combine(s, d, name))
        assert rows.filter(~plain.eqNullSafe(once[name])).count() == 0
    plan = rows.select(*once.values())._jdf.queryExecution().executedPlan().toString()
    assert max(map(int, re.findall(r"pythonUDF(\d+)", plan))) <= 1


def test_few_texts_are_python_strings_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(X, "TEXTS_AT_ONCE", 3)
    values = pa.array(["a", None, "b", "c", "d", "e", None])
    assert X._mapped(values, str.upper).to_pylist() == ["A", None, "B", "C", "D", "E", None]
    assert X._mapped(values.slice(0, 0), str.upper).to_pylist() == []


def test_indicators_as_by_one_pattern(spark):
    texts = ODD + [
        "HTTP://x", "hTTps:/", "xWWW.", "http:/ /", "```", "Traceback (most", "Traceback(", "a\n\t at x", "at\ny",
        "cat x", "exception in thread", "Exception in thread", "\nat ", "İ http://", "ſ httpſ://",
    ]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    mark = rf"(?m)(```|Traceback \(|Exception in thread|^{X.SPACE}*at{X.SPACE}+{X.NON_SPACE}+)"
    x, own = F.col("x"), X.audit_indicators(F.col("x"))
    plain = {
        "has_url": x.rlike(r"(?i)(https?://|www\.)"), "has_email": x.rlike(X.EMAIL_UNICODE), "has_code": x.rlike(mark),
    }
    for name, c in plain.items():
        assert rows.filter(c != own[name]).count() == 0
        assert 0 < rows.filter(c).count() < len(texts)
    plan = rows.select(own["has_url"])._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" not in plan
