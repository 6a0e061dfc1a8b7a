"""The rule models' ranks meet in one row: little is written, nothing is joined, results stay."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, difference
from triagemill.operators import evaluation as E
from triagemill.operators import positions as P
from triagemill.operators import splits as S
from triagemill.plans.catalog import ORACLE, QUERIES
from triagemill.session import shared_dir

SF = "/root/testdata/sf0.001"


def test_eva11_writes_and_joins_little(spark, tmp_path):
    sf = tmp_path / "sf"  # a path of its own, so that no shared table exists yet
    sf.symlink_to(SF)
    folder = Path(shared_dir(spark)) / "triagemill" / spark.sparkContext.applicationId
    before = set(folder.iterdir()) if folder.exists() else set()
    got = QUERIES["eva11"](spark, str(sf))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    written = [spark.read.parquet(str(t)).count() for t in set(folder.iterdir()) - before]
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert n < sum(written) <= 2 * n
    assert difference(got.toPandas(), connect(SF).execute(ORACLE["eva11"]).fetchdf()) is None


@pytest.mark.parametrize("pieces", [P.PIECES, 4])
def test_previous_value_of_hot_and_null_keys(spark, monkeypatch, pieces):
    monkeypatch.setattr(P, "PIECES", pieces)
    monkeypatch.setattr(P, "_SAMPLED", 2)
    rng = random.Random(5)
    keys = [rng.choice(["hot", "hot", "hot", None, "a", "b", f"k{i}"]) for i in range(600)]
    rows = [(i, k, rng.choice(["x", "y", None]), 600) for i, k in enumerate(keys)]
    last, want = {}, {}
    for pos, key, value, _ in rows:
        want[pos] = last.get(key)
        last[key] = value
    df = spark.createDataFrame(rows, "pos long, key string, value string, n_rows long")
    got = P.with_previous(df.repartition(5, "pos"), "key", "value").collect()
    assert len(got) == 600 and {r["pos"]: r["previous"] for r in got} == want


def test_validation_rows_are_those_of_the_folds(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "hot", None, f"g{rng.randrange(150)}"]), 403) for i in range(403)]
    df = spark.createDataFrame(rows, "pos long, g string, n_rows long")
    first = {}
    for pos, group, _ in rows:
        first.setdefault(group if group is not None else pos, pos)
    own = {r[0]: first[r[1] if r[1] is not None else r[0]] for r in rows}
    want = {
        (pos, fold)
        for fold, start, stop in ((1, 103, 203), (2, 203, 303), (3, 303, 403))
        for pos in range(start, stop)
        if own[pos] >= start
    }
    got = S.validation_rows(df, S.groups_across_folds(df, 3, "g"), 3, "g")
    assert sorted((r["pos"], r["fold"]) for r in got.collect()) == sorted(want)
    held = S.expanding_folds(df, 3, "g").filter("role = 'validation'")
    assert sorted((r["pos"], r["fold"]) for r in held.collect()) == sorted(want)
    tiny = df.limit(2).withColumn("n_rows", F.lit(2).cast("long"))
    assert S.validation_rows(tiny, S.groups_across_folds(tiny, 3, "g"), 3, "g").count() == 0


def test_cases_compare_as_pairs_do(spark):
    rng = random.Random(3)
    ranks = [0, 1, 2, 3, 4, None]
    rows = [(str(i), 1, *[rng.choice(ranks) for _ in range(4)]) for i in range(300)]
    cases = spark.createDataFrame(rows, "id string, fold int, true_rank int, base int, m int, n int")
    models = ["base", "m", "n"]
    long = cases.select(
        "id", "fold", "true_rank",
        F.explode(F.array(*[F.struct(F.lit(x).alias("model"), F.col(x).alias("r")) for x in models])).alias("s"),
    ).select("id", "fold", "true_rank", "s.model", F.col("s.r").alias("predicted_rank"))
    want = E.paired_comparison(long, "base").collect()
    got = E.compared_cases(cases, models, "base").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2
