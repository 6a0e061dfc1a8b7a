"""Registered model queries cover all folds, tasks, feature sets and specs."""

from __future__ import annotations

from triagemill.constants import HIERARCHIES
from triagemill.operators import features as X
from triagemill.operators import linear as N
from triagemill.operators import models as M
from triagemill.plans import model_queries as Q

SF = "/root/testdata/sf0.001"


def test_candidates_are_the_whole_grid(spark):
    targets = Q.task_targets(spark, Q.STUDY_TASKS)
    assert {t: len({y for _, y in own}) for t, own in targets.items()} == {"s6": 6, "s3": 3, "s2": 2}
    names = {c.name for f in X.FEATURE_SETS for c in Q.study_candidates(f, targets, M.study_specs())}
    assert len(names) == 3 * 5 * 14


def test_nested_study(spark):
    """Winners follow the ranking of the inner results and are refitted to a zero gradient."""
    docs, plan = Q.views.report_docs(spark, SF), Q.nested_members(spark, SF)
    specs = [M.Spec("LogisticRegression", 1.0, "balanced"), M.Spec("LinearSVC", 0.5, None)]
    results, refitted = Q.nested_study(spark, docs, plan, ["s3", "s2"], ["F0"], specs)
    inner, outer = results.toPandas(), refitted.toPandas()
    folds = {r["fold"] for r in plan.select("fold").distinct().collect()}
    assert len(inner) == 2 * 2 * len([f for f in folds if f % Q.OUTER])
    assert (inner["runtime_seconds"] > 0).all() and (inner["gradient_norm"] <= N.TOLERANCE).all()
    assert len(outer) == 2 * 3 and (outer["gradient_norm"] <= N.TOLERANCE).all()
    means = inner.groupby(["task", "outer_fold", "candidate"])["macro_f1"].mean().round(9)
    for r in outer.itertuples():
        own = means[r.task, r.outer_fold]
        assert own[r.candidate] == own.max() and abs(own.max() - r.mean_macro_f1) < 1e-8
    sizes = {(r["fold"], r["role"]): r["count"] for r in plan.groupBy("fold", "role").count().collect()}
    assert {r.outer_fold: r.rows for r in outer.itertuples()} == {
        f: sizes[Q.OUTER * f, "validation"] for f in (1, 2, 3)
    }


def test_run_time_breaks_a_tie(spark):
    rows = [(c, "F0", f, 0.5, 0.1, 0.2, 10, t) for c, t in (("a", 2.0), ("b", 1.0)) for f in (1, 2)]
    df = spark.createDataFrame(
        rows,
        "candidate string, feature string, fold int, macro_f1 double, minimum_recall double, "
        "priority double, feature_count int, runtime_seconds double",
    )
    ranked = M.rank_candidates(df, "priority", X.FEATURE_SETS).orderBy("candidate_rank").collect()
    assert [(r["candidate"], r["runtime"]) for r in ranked] == [("b", 2.0), ("a", 4.0)]


def test_ablation_carries_winners_on(spark, monkeypatch):
    monkeypatch.setattr(X, "INPUT_VARIANTS", ["summary_description"])
    monkeypatch.setattr(X, "FEATURE_VARIANTS", ["word_1_1"])
    got = Q.mod9(spark, SF).toPandas()
    assert got.groupby("stage").size().to_dict() == {"features": 3, "weights": 24, "models": 12, "curve": 15}
    fitted = got[got["gradient_norm"].notna()]
    assert len(fitted) == 3 + 24 + 6 + 15 and (fitted["gradient_norm"] <= N.TOLERANCE).all()
    weights = got[got["stage"] == "weights"].groupby("candidate")["macro_f1"].mean()
    chosen = {c.split("|")[1] for c in weights.index[weights >= weights.max() - 1e-9]}
    models = set(got[got["stage"] == "models"]["candidate"])
    linear = {c.split("|")[1] for c in models if c.startswith("L")}
    assert len(models) == 4 and len(linear) == 1 and linear <= chosen


def test_linear_coefficients_have_terms(spark):
    got = Q.mod19_linear(spark, SF).toPandas()
    groups = got.groupby(["model", "fold", "label"])
    assert len(groups) == 2 * 3 * 6 and (groups.size() == 30).all()
    for _, own in groups:
        ordered = own.sort_values("rank")["coefficient"].tolist()
        assert ordered == sorted(ordered, reverse=True) and ordered[0] > 0
    assert got["term"].notna().all()


def test_masking_covers_all_folds(spark, monkeypatch):
    seen = []

    def record(spark, sf_dir, branches, specs, members, folds):
        seen.extend((tag, tuple(folds)) for tag, _ in specs)
        return spark.range(1)

    monkeypatch.setattr(Q, "_flat", record)
    Q.mod23(spark, SF)
    assert [f for _, f in seen] == [(1, 2, 3)] * 2


def test_both_hierarchies(spark, monkeypatch):
    monkeypatch.setattr(Q, "vectors", lambda *a: None)
    monkeypatch.setattr(Q.M, "evaluate_hierarchy", lambda *a: spark.range(1))
    assert {r["hierarchy"] for r in Q.mod12(spark, SF).collect()} == set(HIERARCHIES)


def test_stored_model_uses_all_development_rows(spark):
    holdout = Q.report_holdout(spark, SF)
    held = holdout.filter("role = 'validation'").count()
    assert 0 < held < holdout.count() == Q.views.report_docs(spark, SF).count()
    assert Q.mod22(spark, SF).count() == held and Q.mod21(spark, SF).count() == 1


def test_models_on_unigrams_move_no_terms(spark, monkeypatch):
    """Hierarchies, ridge and thresholds are fitted by shared passes and scored where their rows lie."""
    monkeypatch.setattr(Q.M, "fit_classifier", lambda *a, **k: 1 / 0)
    held = Q.members(spark, SF).filter("role = 'validation'").count()
    routes = Q.mod12(spark, SF)
    rows = routes.collect()
    assert len(rows) == held * 3 * len(HIERARCHIES)
    for r in rows:
        groups = HIERARCHIES[r["hierarchy"]]
        assert r["true_label"] in groups[r["true_group"]]
        if r["routing"] == "hard":
            assert r["predicted_label"] in groups[r["predicted_group"]]
        if r["routing"] == "oracle":
            assert r["predicted_label"] in groups[r["true_group"]]
    assert Q.mod14(spark, SF).filter("argmax between 0 and 5").count() == held
    assert Q.mod5(spark, SF).filter("predicted_rank between 0 and 5").count() == held
    scored = Q.mod22(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in scored.split("MapInArrow")[0]
