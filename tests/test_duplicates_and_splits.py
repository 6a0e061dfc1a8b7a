from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from triagemill.operators import duplicates as D
from triagemill.operators import splits as S
from triagemill.operators.eligibility import eligible_reports, eligibility_summary
from triagemill.operators.positions import thirds, with_position
from triagemill.operators.skew import attach_facts


def pilot(spark):
    rows = [
        ("2", "P:2", "same", "text", "major", "2020-01-02", "h"),
        ("1", "P:1", "same", "text", "critical", "2020-01-01", "h"),
        ("3", "P:3", "other", "text", "minor", "2020-01-03", "g"),
        ("4", "P:4", "wish", "text", "enhancement", "2020-01-04", "w"),
    ]
    return spark.createDataFrame(
        rows,
        "issue_id string, global_report_key string, summary string, description string,"
        " severity string, creation_time string, exact_text_hash string",
    ).withColumn("creation_time", F.to_timestamp("creation_time"))


def test_earliest_copy_is_kept_and_conflict_reported(spark):
    rows = eligible_reports(pilot(spark))
    assert {r[1] for r in D.keep_earliest(rows).collect()} == {"P:1", "P:3"}
    log = D.removal_log(rows).collect()
    assert [(r["removed_report_key"], r["retained_report_key"]) for r in log] == [("P:2", "P:1")]
    conflict = D.label_conflicts(rows).first()
    assert conflict["labels"] == "critical,major" and conflict["row_count"] == 2
    facts = eligibility_summary(pilot(spark)).first()
    assert facts["raw_core_rows"] == 4
    assert facts["configured_excluded_label_rows"] == 1
    assert facts["modeling_rows_after_filtering_and_deduplication"] == 2


def union_find(edges, nodes):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_components_with_a_hub_a_chain_and_a_cycle(spark):
    rng = random.Random(7)
    pairs = [(f"n{i:03d}", "hub") for i in range(60)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    pairs += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("solo", "")]
    pairs += [(f"r{rng.randrange(40):02d}", f"r{rng.randrange(40):02d}") for _ in range(30)]
    df = spark.createDataFrame(pairs, "key string, link string")
    got = {r["key"]: r["duplicate_group"] for r in D.connected_groups(df, "key", "link").collect()}
    assert got == union_find([p for p in pairs if p[1]], {p[0] for p in pairs})


def test_merged_batches_equal_one_run(spark):
    rng = random.Random(11)
    hub = [("hub", f"h{i:03d}") for i in range(60)]
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(20)]
    others = [(f"r{rng.randrange(40):02d}", f"r{rng.randrange(40):02d}") for _ in range(30)]
    links = [*hub, *chain, *others, ("c05", "hub")]
    rng.shuffle(links)
    odd = [(None, "x"), ("x", None), ("", "y"), ("z", "z")]
    batches = [links[:50] + odd, links[50:55], [], links[55:] + links[:7]]
    forest, so_far = D.empty_forest(spark), []
    for batch in batches:
        forest = D.merge_links(forest, spark.createDataFrame(batch, "a string, b string"))
        so_far += [p for p in batch if p not in odd]
        got = {r["key"]: r["root"] for r in forest.collect()}
        keys = {k for p in so_far for k in p if p[0] != p[1]}
        assert forest.count() == len(got)
        assert got == {k: v for k, v in union_find(so_far, keys).items() if k in keys}


def test_hot_key_join_is_exact(spark):
    # one key holds a third of the rows, which takes the broadcast route; the rest is cold
    rows = spark.range(6000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 2000)).alias("k"),
    )
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = attach_facts(rows, facts, "k", "n", F.col("id"), "inner")
    assert got.count() == 6000
    assert got.join(facts.withColumnRenamed("low", "l2").drop("n"), "k").filter("low <> l2").count() == 0
    partial = attach_facts(rows, facts.filter("k <> 'hot'"), "k", "n", F.col("id"), "left")
    assert partial.filter("low is null").count() == 2000


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_positions_with_one_heavy_timestamp(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(3000).select(
            F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 11).alias("t"),
            F.col("id"),
            (F.col("id") % 4).cast("string").alias("g"),
        )
        rows = with_position(df, ["t", "id"]).collect()
        ordered = sorted(rows, key=lambda r: (r["t"], r["id"]))
        assert [r["pos"] for r in ordered] == list(range(3000))
        scoped = with_position(df, ["t", "id"], scope="g").collect()
        for g in "0123":
            part = sorted((r for r in scoped if r["g"] == g), key=lambda r: (r["t"], r["id"]))
            assert [r["pos"] for r in part] == list(range(len(part)))
            assert {r["n_rows"] for r in part} == {len(part)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def daily(spark, n, group=None, labels=("a", "b")):
    return spark.createDataFrame(
        [(i, f"2024-01-{1 + i % 28:02d} {i // 28:02d}:00:00", labels[i % len(labels)],
          group[i] if group else str(i)) for i in range(n)],
        "id long, t string, label string, duplicate_group string",
    ).withColumn("t", F.to_timestamp("t"))


def test_holdout_sizes_and_refusals(spark):
    split = S.chronological_holdout(daily(spark, 20), "t", "id", "label")
    counts = {r["partition"]: r["count"] for r in split.groupBy("partition").count().collect()}
    assert counts == {"development": 16, "test": 4}
    with pytest.raises(ValueError, match="without a timestamp"):
        S.chronological_holdout(
            daily(spark, 20).withColumn("t", F.when(F.col("id") > 2, F.col("t"))), "t", "id", "label"
        )
    with pytest.raises(ValueError, match="only in the test"):
        S.chronological_holdout(
            daily(spark, 20).withColumn("label", F.when(F.col("id") == 19, "z").otherwise("a")),
            "t", "id", "label",
        )
    with pytest.raises(ValueError, match="empty side"):
        S.chronological_holdout(daily(spark, 1), "t", "id", "label")


def test_purge(spark):
    split = spark.createDataFrame(
        [(1, "development", "1"), (2, "development", "2"), (3, "test", "2"), (4, "test", "3")],
        "pos long, partition string, duplicate_group string",
    )
    kept = S.purge_test(split, "duplicate_group")
    assert sorted(r["pos"] for r in kept.collect()) == [1, 2, 4]
    with pytest.raises(ValueError, match="entire test set"):
        S.purge_test(split.filter("pos <> 4"), "duplicate_group")


def test_folds_purge_groups_seen_before(spark):
    groups = list("abcadebfghij")
    df = daily(spark, 12, groups)
    placed = with_position(df, ["id"])
    folds = S.expanding_folds(placed, 3).collect()
    for fold in (1, 2, 3):
        train = {r["duplicate_group"] for r in folds if r["fold"] == fold and r["role"] == "train"}
        held = {r["duplicate_group"] for r in folds if r["fold"] == fold and r["role"] == "validation"}
        assert held and not train & held
    starts = {r["fold"]: 0 for r in folds}
    for r in folds:
        if r["role"] == "train":
            starts[r["fold"]] += 1
    assert starts == {1: 3, 2: 6, 3: 9}


def test_published_fold_starts(spark):
    bounds = spark.range(1).select(S.fold_bounds(3, F.lit(7664)).alias("b")).first()["b"]
    assert [b["start"] for b in bounds] == [1916, 3832, 5748]


def test_fingerprints_are_stable_and_checked(spark):
    folds = S.expanding_folds(with_position(daily(spark, 12), ["id"]), 3)
    first = S.row_set_fingerprints(folds, "id")
    again = S.row_set_fingerprints(folds.repartition(5), "id")
    S.verify_fingerprints(first, again)
    with pytest.raises(ValueError, match="differs"):
        S.verify_fingerprints(first, S.row_set_fingerprints(folds.filter("id <> 3"), "id"))


def test_thirds_rules(spark):
    for rule, sizes in (("qcut", [4, 3, 4]), ("cut", [3, 4, 4])):
        rows = spark.range(11).select(thirds(F.col("id"), F.lit(11), rule).alias("x")).collect()
        assert [sum(r["x"] == k for r in rows) for k in ("early", "middle", "late")] == sizes


def test_coverage_gate_and_inner_fallback(spark):
    counts = S.class_counts(daily(spark, 8), [], "label", ["a", "b", "c"])
    with pytest.raises(ValueError, match="lacks"):
        S.require_coverage(counts)
    placed = with_position(daily(spark, 8, labels=("a", "a", "a", "a", "a", "b", "a", "a")), ["id"])
    inner = S.inner_folds(placed, "label", ["a", "b"], "duplicate_group")
    roles = {r["role"]: r["count"] for r in inner.groupBy("role").count().collect()}
    assert roles == {"train": 6, "validation": 2}


def nullable_rows(spark):
    return spark.range(40).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 != 0, (F.col("id") % 7).cast("string")).alias("g"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 2).cast("string")).alias("label"),
        (F.col("id") % 4).cast("string").alias("project"),
    )


def test_rows_without_a_group_stay(spark):
    rows = nullable_rows(spark)
    placed = with_position(rows, ["seq"])
    groups = {r["seq"]: r["g"] for r in rows.collect()}
    first = {}
    for i in sorted(groups):
        first.setdefault(groups[i] if groups[i] is not None else ("own", i), i)
    for fold in (1, 2, 3):
        start, stop = 40 - (4 - fold) * 10, 40 - (3 - fold) * 10
        want = {(i, "train") for i in range(start)} | {
            (i, "validation")
            for i in range(start, stop)
            if first[groups[i] if groups[i] is not None else ("own", i)] >= start
        }
        got = S.expanding_folds(placed, 3, "g").filter(F.col("fold") == fold)
        assert {(r["seq"], r["role"]) for r in got.collect()} == want
    assert S.leave_one_project_out(rows, "project", "g").filter("g is null and not purged").count() == 14
    assert S.leave_one_project_out(rows, "project", "g").count() == 40
    split = placed.withColumn("partition", F.when(F.col("pos") < 30, "development").otherwise("test"))
    marked = S.mark_purged_test(split, "g")
    assert marked.count() == 40 and marked.filter("g is null and purged").count() == 0


def test_a_null_scope_is_a_scope(spark):
    rows = nullable_rows(spark)
    assert with_position(rows, ["seq"], scope="label").count() == 40
    held = S.stratified_holdout(rows, "seq", "label").filter("label is null")
    assert held.filter("partition = 'development'").count() == 6 and held.count() == 8
    assert S.stratified_folds(rows, "seq", "label").count() == 40
