from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triagemill.constants import LABEL_GROUPS
from triagemill.functions import labels as L
from triagemill.functions import text as X


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("v")).first()["v"]


def test_clean_text(spark):
    raw = "ＡＢＣ &lt;b&gt;Hi&lt;/b&gt; see HTTPS://x.org/a?b me@site.co.uk\n\t end"
    got = one(spark, X.clean_text(F.col("t")), t=raw)
    assert got == "abc hi see [URL] [EMAIL] end"
    kept = X.CleaningOptions(lowercase=False, remove_html=False, normalize_whitespace=False)
    assert one(spark, X.clean_text(F.col("t"), kept), t=" A  <b> ") == "A  <b>"
    stripped = X.CleaningOptions(remove_code_blocks=True, remove_stack_traces=True)
    got = one(spark, X.clean_text(F.col("t"), stripped), t="a ```x\ny``` b Exception in thread c")
    assert got == "a b c"
    assert one(spark, X.clean_text(F.col("t")), t=None) == ""


def test_tagged_clean(spark):
    got = one(
        spark,
        X.tagged_clean(F.col("s"), F.col("d"), True),
        s="Blocker in bug #1234",
        d="<p>0xdeadbeef01</p>\r\nmail a@b.org www.x.y",
    )
    assert got == (
        "[summary] [severity_term] in [issue_id] [description] [hex] mail [email] [url]"
    )


def test_structural_width_and_values(spark):
    columns = X.structural_features(F.col("s"), F.col("d"))
    assert len(columns) == 23
    row = (
        spark.createDataFrame([("Hi!", "class A {\nxxxx? 12\n")], "s string, d string")
        .select(*[c.alias(n) for n, c in columns.items()])
        .first()
    )
    assert row["line_count"] == 3
    assert row["code_lines"] == 1
    assert row["digit_count"] == 2
    assert row["has_repeated_character"] == 1
    assert row["exclamation_count"] == 1 and row["question_count"] == 1


def python_char_wb(text, low, high):
    grams = Counter()
    for word in text.lower().split():
        w = f" {word} "
        for n in range(low, high + 1):
            for i in range(max(len(w) - n + 1, 1)):
                grams[w[i : i + n]] += 1
            if len(w) <= n:
                break
    return grams


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="abé _1 \n.", max_size=40))
def test_grams_match_a_plain_loop(spark, text):
    tokens = re.findall(r"\w\w+", text.lower())
    want = Counter(tokens) + Counter(" ".join(p) for p in zip(tokens, tokens[1:]))
    row = spark.createDataFrame([(text,)], "t string").select(
        X.word_tokens(F.col("t")).alias("tok"), X.char_wb_ngrams(F.col("t")).alias("ch")
    )
    got = row.select(X.ngrams(F.col("tok"), 1, 2).alias("w"), "ch").first()
    assert Counter(got["w"]) == want
    assert Counter(got["ch"]) == python_char_wb(text, 3, 5)


def test_labels(spark):
    assert one(spark, L.normalize_label(F.col("t")), t="  MAJOR\t") == "major"
    assert one(spark, L.normalize_label(F.col("t")), t=None) == ""
    assert one(spark, L.grouped_label(F.col("t")), t="Trivial") == "low"
    with pytest.raises(Exception, match="does not map"):
        one(spark, L.grouped_label(F.col("t"), {"medium": LABEL_GROUPS["medium"]}), t="custom")
    with pytest.raises(Exception, match="Invalid severity"):
        one(spark, L.label_to_rank(F.col("t")), t="urgent")
    with pytest.raises(ValueError):
        L.task_label(F.col("t"), "s9")


def test_redaction_orders(spark):
    long = "x" * 5 + " me@x.org"
    assert one(spark, X.redact(F.col("t"), 10), t=long) == "xxxxx [EMA"
    assert one(spark, X.cut_then_redact(F.col("t"), 8), t=long) == "xxxxx me"


def test_digits_and_boundaries_are_unicode(spark):
    from pyspark.sql import functions as F

    from triagemill.functions import text as X

    rows = ["bug ٣٣٣", "x²", "ébug 123", "bug 123é", "a 1", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = df.select(
        F.coalesce(F.col("t").rlike(X.ISSUE_ID), F.lit(False)).alias("issue"),
        F.coalesce(F.regexp_count("t", F.lit(X.DIGIT)), F.lit(0)).alias("digits"),
    ).collect()
    assert [r["issue"] for r in got] == [True, False, False, False, False, False]
    assert [r["digits"] for r in got] == [3, 1, 3, 3, 1, 0]
