"""Naive Bayes and dimensions from rows of vectors, against the same from single terms."""

from __future__ import annotations

from triagemill.constants import LABELS
from triagemill.operators import features as X
from triagemill.operators import models as M
from triagemill.plans import model_queries as Q

SF = "/root/testdata/sf0.001"


def test_equals_single_terms_and_explodes_none(spark):
    weighted, members = Q.weighted(spark, SF), Q.members(spark, SF)
    likelihood, priors = M.naive_bayes_tables(weighted, members, LABELS, 0.5, ["fold"])
    want = M.naive_bayes_predict(weighted, members, likelihood, priors, LABELS, Q.KEY, ["fold"])
    got = Q.naive_bayes(spark, SF)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    columns = [Q.KEY, "fold", "true_label", "predicted_label"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    train = weighted.filter("role = 'train'")
    vectors = Q.word_vectors(spark, SF).plain.filter("role = 'train'")
    assert sorted(X.vector_dimensions(vectors).collect()) == sorted(
        X.dimension_estimate(train).select(X.vector_dimensions(vectors).columns).collect()
    )


def test_absent_labels_and_rows_without_terms(spark):
    rows = [
        ("a", 1, "train", "blocker", ([0, 2], [1.0, 2.0])), ("b", 1, "train", "other", ([1], [3.0])),
        ("c", 1, "validation", "blocker", ([], [])), ("d", 1, "validation", "major", ([0, 3], [1.0, 1.0])),
        ("e", 2, "train", "major", ([0], [1.0])),
    ]
    schema = "key string, fold int, role string, label string, features struct<indices: array<int>, values: array<double>>"
    vectors = spark.createDataFrame(rows, schema)
    likelihood, priors = M.vector_bayes_tables(vectors, 4, LABELS, 0.5)
    assert {(r["fold"], r["idx"]) for r in likelihood.collect()} == {(1, 0), (1, 1), (1, 2), (2, 0)}
    got = M.vector_bayes_predict(vectors, 4, likelihood, priors, LABELS, "key").collect()
    assert {(r["key"], r["true_label"], r["predicted_label"]) for r in got} == {
        ("c", "blocker", "blocker"), ("d", "major", "blocker")
    }
