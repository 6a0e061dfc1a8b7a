from __future__ import annotations

import math
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from triagemill.functions import ordinal as O
from triagemill.functions import probability as P
from triagemill.operators import decisions as DEC
from triagemill.operators import evaluation as E
from triagemill.operators import features as X
from triagemill.operators import models as M
from triagemill.session import new_table_path


def pairs(spark, true, predicted):
    return spark.createDataFrame(
        [(t, p) for t, p in zip(true, predicted)], "true_label string, predicted_label string"
    )


def test_fixed_label_macro(spark):
    row = E.metrics(pairs(spark, "aa", "aa"), [], ["a", "b"]).first()
    assert row["macro_f1"] == pytest.approx(0.5)
    row = E.metrics(pairs(spark, "ab", "aa"), [], ["a", "b", "c"]).first()
    assert row["macro_f1"] == pytest.approx(2 / 9)
    row = E.metrics(pairs(spark, "aba", "aaa"), [], ["a", "b"]).first()
    assert row["accuracy"] == pytest.approx(2 / 3)


def test_bootstrap_brackets_the_score(spark):
    df = pairs(spark, "aaaabbbbcc" * 5, "aaabbbbacc" * 5)
    ci = E.bootstrap_macro_f1(df, [], ["a", "b", "c"], resamples=200).first()
    point = E.metrics(df, [], ["a", "b", "c"]).first()["macro_f1"]
    assert ci["lower"] <= point <= ci["upper"]
    again = E.bootstrap_macro_f1(df.repartition(3), [], ["a", "b", "c"], resamples=200).first()
    assert again == ci


def arrays(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "q array<double>")


def test_decoders(spark):
    df = arrays(spark, [[0.9, 0.7, 0.5, 0.49, 0.1], [0.1, 0.2, 0.3, 0.4, 0.6]])
    assert [r[0] for r in df.select(O.decode_hard(F.col("q"))).collect()] == [3, 1]
    p = arrays(spark, [[0.9, 0.7, 0.5, 0.3, 0.1]]).withColumn("p", O.class_probabilities(F.col("q")))
    row = p.select(
        O.decode_argmax(F.transform("p", lambda x: F.round(x, 9))).alias("a"),
        O.clip_rank(O.expected_rank(F.col("p")), 6).alias("e"),
        F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("s"),
    ).first()
    assert (row["a"], row["e"]) == (1, 3)
    assert row["s"] == pytest.approx(1.0)
    with pytest.raises(Exception, match="not monotonic"):
        arrays(spark, [[0.1, 0.9]]).select(O.class_probabilities(F.col("q"))).collect()


def test_round_and_clip(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.49, 0.5, 4.5, 6.0)], "x double")
    rows = df.select(O.clip_rank(F.col("x"), 6).alias("r"), O.was_clipped(F.col("x"), 6).alias("c"))
    got = rows.collect()
    assert [r["r"] for r in got] == [0, 0, 1, 5, 5]
    assert sum(r["c"] for r in got) == 2


def pava(y):
    blocks = []
    for v in np.clip(y, 0, 1):
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n])
    return [m for m, n in blocks for _ in range(n)]


def test_projection_matches_pooling(spark):
    rng = np.random.default_rng(3)
    rows = rng.uniform(-0.2, 1.2, (50, 5)).tolist()
    got = arrays(spark, rows).select("q", O.project_monotonic(F.col("q"), 5).alias("m")).collect()
    for r in got:
        assert r["m"] == pytest.approx(pava(r["q"]))


def test_ordinal_literals(spark):
    df = spark.createDataFrame(
        list(zip(range(6), [5, 1, 2, 3, 4, 0])), "true_rank int, predicted_rank int"
    ).withColumn("k", F.lit(1))
    row = E.ordinal_metrics(df, ["k"], 6).first()
    assert row["extreme_error_count"] == 2
    assert row["overestimation_rate"] == pytest.approx(1 / 6)
    assert row["underestimation_rate"] == pytest.approx(1 / 6)


def _chi_square_tail(x: float, dof: int) -> float:
    """Upper tail of chi-square by its closed recurrences."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (dof - 1) // 2 + 1):
        total += term
        term *= half / (i + 0.5)
    return total


def _signed_rank_p(
    statistic: float, n: int, tie_term: float, ties: int, exact_up_to: int = 50
) -> float:
    """Two-sided p: exact for untied blocks up to a number, else normal with tie correction."""
    if n == 0:
        return 1.0
    if n <= exact_up_to and tie_term == 0 and ties == 0:
        counts = np.zeros(n * (n + 1) // 2 + 1)
        counts[0] = 1
        for r in range(1, n + 1):
            counts[r:] = counts[r:] + counts[:-r].copy()
        return float(min(1.0, 2 * counts[: int(statistic) + 1].sum() / 2.0**n))
    mean = n * (n + 1) / 4
    variance = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    z = (statistic - mean) / math.sqrt(variance)
    return float(min(1.0, math.erfc(abs(z) / math.sqrt(2))))


def test_p_values():
    assert _chi_square_tail(5.991464547, 2) == pytest.approx(0.05, abs=1e-6)
    assert _chi_square_tail(7.814727903, 3) == pytest.approx(0.05, abs=1e-6)
    assert _signed_rank_p(0, 5, 0, 0) == pytest.approx(2 / 32)


def test_p_value_expressions(spark):
    """Expressions against closed forms in plain Python."""
    chi = [(x, k) for x in (0.0, 1e-9, 0.3, 1.4, 1.6, 3.0, 9.5, 40.0, 300.0) for k in (1, 2, 3, 4, 7, 30)]
    got = spark.createDataFrame(chi, "x double, k int").withColumn("p", P.chi_square_tail(F.col("x"), F.col("k")))
    for r in got.collect():
        want = _chi_square_tail(r["x"], r["k"])
        assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-13), r
    signed = [(s, n, t, z) for n in (1, 5, 12, 50, 51, 200) for s in (0.0, n / 2, n * (n + 1) / 8)
              for t, z in ((0.0, 0), (6.0, 0), (0.0, 2))]
    signed += [(0.0, 0, 0.0, 3)]
    got = spark.createDataFrame(signed, "s double, n int, t double, z int").withColumn(
        "p", P.signed_rank_p(F.col("s"), F.col("n"), F.col("t"), F.col("z"))
    )
    for r in got.collect():
        assert r["p"] == pytest.approx(_signed_rank_p(r["s"], r["n"], r["t"], r["z"]), rel=1e-9), r


def student_two_sided(r, n):
    """Closed trigonometric sums of Student's distribution."""
    dof, cos2 = n - 2, 1 - r * r
    if dof % 2 == 0:
        term, total = 1.0, 0.0
        for j in range(dof // 2):
            total += term
            term *= cos2 * (2 * j + 1) / (2 * j + 2)
        return 1 - abs(r) * total
    term, total = 1.0, 0.0
    for j in range((dof - 1) // 2):
        total += term
        term *= cos2 * (2 * j + 2) / (2 * j + 3)
    return 1 - 2 / math.pi * (math.asin(abs(r)) + abs(r) * math.sqrt(cos2) * total)


def test_correlation_p(spark):
    rows = [(r, n) for r in (0.0, 0.001, -0.2, 0.45, -0.8, 0.99, 1.0) for n in (2, 3, 4, 5, 25, 26, 400)]
    rows += [(None, 9), (float("nan"), 9), (0.5, 1)]
    got = spark.createDataFrame(rows, "r double, n int").withColumn("p", P.correlation_p(F.col("r"), F.col("n")))
    for r in got.collect():
        if r["r"] is None or math.isnan(r["r"]) or r["n"] < 2:
            assert r["p"] is None
        elif r["n"] == 2:
            assert r["p"] == 1
        else:
            assert r["p"] == pytest.approx(student_two_sided(r["r"], r["n"]), abs=1e-12)


def test_correlations_of_edge_groups(spark):
    rows = [("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("flat", 1.0, 4.0), ("line", 1.0, 1.0),
            ("line", 2.0, 2.0), ("line", 3.0, 3.0), ("line", None, 9.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: (r["pairs"], r["r"], r["p"]) for r in DEC.correlations(df, "k", "x", "y").collect()}
    assert got["one"] == (1, None, None) and got["flat"] == (3, None, None) and got[None] == (1, None, None)
    assert got["line"] == (3, pytest.approx(1.0), pytest.approx(0.0, abs=1e-7))
    assert DEC.correlations(df.limit(0), "k", "x", "y").count() == 0


def test_runs_are_admitted_once(spark):
    log = spark.createDataFrame([("r1",)], "run_id string")
    DEC.require_admitted(spark.createDataFrame([("r2",)], "run_id string"), log)
    with pytest.raises(ValueError, match="already scored"):
        DEC.require_admitted(log, log)


def toy(spark):
    rows = [
        (f"d{i}", f"crash {w} engine" if i % 2 else f"typo {w} label", "major" if i % 2 else "minor",
         "train" if i < 12 else "validation")
        for i, w in enumerate(["alpha", "beta"] * 8)
    ]
    docs = spark.createDataFrame(rows, "k string, summary string, label string, role string")
    docs = docs.withColumn("description", F.lit("")).withColumn(
        "summary", F.when(F.col("role") == "validation", F.concat("summary", F.lit(" unseenword"))).otherwise(F.col("summary"))
    )
    return docs, docs.select("k", "role", "label").withColumn("fold", F.lit(1))


def test_vocabulary_sees_training_rows_only(spark):
    docs, members = toy(spark)
    table = X.build_features(docs, members, "k", X.variant_branches("summary", "word_1_2"), [1])
    terms = {r["term"] for r in table.vocabulary.collect()}
    assert "crash" in terms and not any("unseenword" in t for t in terms)
    norms = [r["features"].norm(2) for r in table.rows.collect()]
    assert all(n == pytest.approx(1.0) for n in norms)


def gradient(rows, weights, model, c):
    """Gradient of C * sum of weighted log loss + half squared norm, by class."""
    x = np.array([r["features"].toArray() for r in rows])
    labels = model.labels
    y = np.array([labels.index(r["label"]) for r in rows])
    w = np.array([weights[r["label"]] for r in rows])
    coef = np.array([v for _, v, _ in model.coefficients()])
    bias = np.array([b for _, _, b in model.coefficients()])
    z = x @ coef.T + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    residual = (p - np.eye(len(labels))[y]) * w[:, None]
    return c * residual.T @ x + coef


def test_logistic_fit_is_a_stationary_point(spark):
    rng = np.random.default_rng(0)
    data = [
        (Vectors.dense((rng.normal(size=4) + np.eye(4)[i % 3] * 2).tolist()), "abc"[i % 3])
        for i in range(60)
    ] + [(Vectors.dense([0.0, 0.1, 0.2, 0.3]), "a")] * 10
    df = spark.createDataFrame(data, ["features", "label"])
    model = M.fit_classifier(df, M.Spec("LogisticRegression", 0.5, "balanced", 1e-12))
    weights = {r["label"]: r["balanced"] for r in M.class_weights(df, "label").collect()}
    assert np.abs(gradient(df.collect(), weights, model, 0.5)).max() < 1e-3


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=40) * 0.1
    df = spark.createDataFrame(
        [(Vectors.dense(r.tolist()), float(v)) for r, v in zip(x, y)], ["features", "rank"]
    )
    model = M.fit_ridge(df, "rank", 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert model.coefficients.toArray() == pytest.approx(want, abs=1e-4)


def test_weights_are_validated(spark):
    with pytest.raises(ValueError):
        M.validate_weights({"a": 1.0}, ["a", "b"])
    with pytest.raises(ValueError):
        M.validate_weights({"a": 11.0}, ["a"])
    single = spark.createDataFrame([(Vectors.dense([1.0]), "a")], ["features", "label"])
    with pytest.raises(ValueError, match="two training classes"):
        M.fit_classifier(single, M.Spec("LogisticRegression"))


def test_stored_model_scores_like_the_fit_and_on_a_stream(spark, tmp_path):
    from triagemill.streaming.scoring import score_stream

    docs, members = toy(spark)
    branches = X.variant_branches("summary", "word_1_1")
    table = X.build_features(docs, members, "k", branches, [1])
    model = M.fit_classifier(table.rows.filter("role = 'train'"), M.Spec("LogisticRegression"))
    path = new_table_path(spark, "model")
    M.save_linear(model, table.vocabulary, path)
    terms, labels = M.load_linear(spark, path)
    stored = {r[0]: r[1] for r in M.score_linear(docs, "k", branches, terms, labels).collect()}
    fitted = {
        r["k"]: r["predicted_label"]
        for r in model.predict(table.rows.select("k", "features")).collect()
    }
    assert stored == fitted
    source = str(tmp_path / "in")
    docs.select("k", "summary", "description").write.parquet(source)
    stream = spark.readStream.schema("k string, summary string, description string").parquet(source)
    query = score_stream(
        stream, "k", branches, path, str(tmp_path / "out"), str(tmp_path / "chk")
    )
    query.awaitTermination(120)
    got = {r["k"]: r["predicted_label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == fitted


def test_candidate_grid():
    grid = {"alpha": [0.1, 0.5, 1.0], "n": [1, 2]}
    assert len(M.candidate_grid(grid)) == 6
    picked = M.candidate_grid(grid, "random", 3)
    assert len(picked) == 3 and picked == M.candidate_grid(grid, "random", 3)


def test_soft_routing_prefers_the_fixed_order_on_ties(spark):
    groups = spark.createDataFrame([("1", "G", 0.5), ("1", "H", 0.5)], "id string, grp string, group_score double")
    children = spark.createDataFrame(
        [("1", "G", "major", 1.0), ("1", "H", "blocker", 1.0)],
        "id string, grp string, label string, child_score double",
    )
    row = M.soft_route(groups, children, ["id"], ["blocker", "critical", "major"]).first()
    assert row["predicted_label"] == "blocker"


def test_missing_predictions_are_misses(spark):
    from triagemill.operators.evaluation import class_metrics, metrics

    rows = spark.createDataFrame(
        [(1, "a", "a"), (1, "a", None), (1, "b", "b"), (1, None, "b"), (2, "a", None)],
        "k int, true_label string, predicted_label string",
    )
    by_label = {(r["k"], r["label"]): r for r in class_metrics(rows, ["k"], ["a", "b"]).collect()}
    assert len(by_label) == 4
    assert (by_label[1, "a"]["support"], by_label[1, "a"]["predicted"]) == (2, 1)
    assert (by_label[1, "b"]["support"], by_label[1, "b"]["predicted"]) == (1, 2)
    facts = {r["k"]: r for r in metrics(rows, ["k"], ["a", "b"]).collect()}
    assert (facts[1]["rows"], facts[1]["accuracy"]) == (4, 0.5)
    assert (facts[2]["rows"], facts[2]["accuracy"]) == (1, 0.0)


def test_vocabulary_ties_go_to_the_smaller_term(spark):
    import random

    from triagemill.operators.features import fit_vocabulary, variant_branches

    rng = random.Random(3)
    rows = {(str(d), f"t{rng.randrange(60):02d}") for d in range(40) for _ in range(12)}
    branches = variant_branches("summary_description", "word_1_1")
    import dataclasses

    branches = [dataclasses.replace(b, config=dataclasses.replace(b.config, max_features=17, min_df=2)) for b in branches]
    counts = spark.createDataFrame(
        [(d, b.name, t, 1) for d, t in rows for b in branches], "key string, branch string, term string, tf long"
    )
    members = spark.createDataFrame(
        [(str(d), f, "train") for d in range(40) for f in (1, 2) if f == 2 or d < 20], "key string, fold int, role string"
    )
    got = fit_vocabulary(counts, members, "key", branches, [1, 2]).collect()
    for f, limit in ((1, 20), (2, 40)):
        for b in branches:
            df = {}
            for d, t in rows:
                if int(d) < limit:
                    df[t] = df.get(t, 0) + 1
            usable = [t for t in df if df[t] >= 2 and df[t] <= b.config.max_df * limit]
            want = sorted(usable, key=lambda t: (-df[t], t))[:17]
            assert {r["term"] for r in got if r["fold"] == f and r["branch"] == b.name} == set(want)


def test_one_of_two_concurrent_runs_is_refused(spark):
    """The held-out rows are claimed by creating an entry, so only one request can win."""
    from concurrent.futures import ThreadPoolExecutor

    log = new_table_path(spark, "run-log")

    def ask(run_id):
        try:
            DEC.claim_run(spark, log, run_id)
        except ValueError:
            return "refused"
        return "admitted"

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(ask, ["run 1"] * 8))
    assert sorted(got) == ["admitted"] + ["refused"] * 7
    assert ask("run 2") == "admitted" and ask("run 1") == "refused"
    assert sorted(r["run_id"] for r in DEC.logged_runs(spark, log).collect()) == ["run 1", "run 2"]
