"""Features made row by row: terms, weights and structure against the column expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.operators import features as FT

TEXTS = [
    "", " ", "a", "ab ab ab cd", "The  same\tword the SAME", "x1_y café Über café", "longerword ab longerword",
    "²٣ 12 \U0001f600\U0001f600 tail", "line\r\none\n", "\n", "a\x85b c\n\n", "{x};\n public y\n", None,
]


def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, t string")


def test_counts_equal_the_expressions(spark):
    df = docs(spark)
    for config in (
        FT.TfidfConfig("word", 1, 2), FT.TfidfConfig("word", 2, 3), FT.TfidfConfig("char_wb", 3, 5),
        FT.TfidfConfig("char", 2, 3),
    ):
        rows = FT.counted_rows(df, "k", [FT.Branch("b", F.col("t"), config)]).collect()
        got = {r["k"]: dict(zip(r["terms_0"], r["tfs_0"])) for r in rows}
        want = {r["k"]: r["terms"] for r in df.select("k", FT.analyze(F.col("t"), config).alias("terms")).collect()}
        assert set(got) == set(want)
        for k, terms in want.items():
            assert got[k] == {t: terms.count(t) for t in terms}


def test_weights_of_folds_and_branches(spark):
    df = docs(spark).filter("t is not null")
    branches = [
        FT.Branch("char", F.col("t"), FT.TfidfConfig("char_wb", 3, 4, 1)),
        FT.Branch("word", F.col("t"), FT.TfidfConfig("word", 1, 1, 1, 1.0, 3, False)),
    ]
    roles = [(i, f, "train" if i % 3 != f else "validation") for i in range(len(TEXTS) - 1) for f in (1, 2)]
    members = spark.createDataFrame(roles, "k int, fold int, role string")
    counted = FT.counted_members(df, members, "k", branches).cache()
    words = FT.vocabulary_of(counted, branches, [1, 2])
    rows = FT.weighted_rows(counted, words, "k", branches, with_terms=True)
    assert rows.count() == len(roles)
    found = {}
    for r in FT.exploded_weights(rows, "k").collect():
        found.setdefault((r["k"], r["fold"], r["branch"]), {})[r["term"]] = r["w"]
    known = {(r["fold"], r["branch"], r["term"]): r["idf"] for r in words.collect()}
    for k, fold, _ in roles:
        for b in branches:
            terms = df.filter(F.col("k") == k).select(FT.analyze(F.col("t"), b.config)).first()[0]
            raw = {t: terms.count(t) for t in terms if (fold, b.name, t) in known}
            raw = {t: (1 + math.log(n) if b.config.sublinear_tf else n) * known[fold, b.name, t] for t, n in raw.items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            got = found.get((k, fold, b.name), {})
            assert set(got) == set(raw) and all(abs(got[t] - w / norm) < 1e-12 for t, w in raw.items())


def test_no_term_is_moved_or_sorted(spark):
    """Weights come from the rows themselves: their plan has neither an exchange nor a sort."""
    df = docs(spark)
    branches = [FT.Branch("word", F.col("t"), FT.TfidfConfig("word", 1, 1, 1))]
    members = df.select("k", F.lit(1).alias("fold"), F.lit("train").alias("role"))
    counted = FT.materialize(FT.counted_members(df, members, "k", branches), "counted")
    rows = FT.weighted_rows(counted, FT.vocabulary_of(counted, branches, [1]), "k", branches)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_tokens_lines_and_digits(spark):
    columns = X.structural_features(F.col("t"), F.lit(None))
    tokens = F.regexp_extract_all("t", F.lit(f"({X.NON_SPACE}+)"), F.lit(1))
    got = docs(spark).filter("t is not null").select(
        X.whitespace_tokens(F.col("t")).alias("a"), tokens.alias("b"), columns["digit_count"].alias("digits"),
        F.regexp_count("t", F.lit(X.DIGIT)).alias("want"), columns["line_count"].alias("lines"), "t",
    ).collect()
    for r in got:
        assert r["a"] == r["b"] and r["digits"] == r["want"]
        # the description is empty, so the text ends with the line break that joins both
        assert r["lines"] == len((r["t"] + "\n").splitlines())
