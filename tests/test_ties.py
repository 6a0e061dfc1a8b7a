"""Results that meet an edge: means that are equal, numbers half-way between two roundings."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import difference
from triagemill.operators import decisions as DEC
from triagemill.plans import catalog


@pytest.mark.parametrize("order", [(1, 2, 3), (3, 2, 1), (2, 3, 1)])
def test_equal_folds_are_no_loss(spark, order):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1; the candidate is no worse for that."""

    def folds(numbers):
        one = F.create_map(F.lit("HIGH"), F.lit(0.1))
        rows = spark.createDataFrame([("s3", f, f / 10) for f in numbers], "task string, fold int, macro_f1 double")
        return rows.coalesce(1).select(
            "*", F.lit(0.2).alias("balanced_accuracy"), *[one.alias(m) for m in ("precision", "recall", "f1")]
        )

    for other in [(1, 2, 3), (3, 2, 1)]:
        found = DEC.task_rules(folds(order), folds(other)).first()
        assert found["classification"] == "RESEARCH_ONLY"
        assert found["improved_folds"] == 0
        assert found["macro_f1"] == found["baseline_macro_f1"]


def test_missing_label_has_no_mean(spark):
    rows = spark.createDataFrame([("s6", 1, 0.5), ("s6", 2, 0.5)], "task string, fold int, macro_f1 double")
    none = F.create_map(F.lit("normal"), F.lit(0.5))
    rows = rows.select("*", F.lit(0.9).alias("balanced_accuracy"), *[none.alias(m) for m in ("precision", "recall", "f1")])
    found = DEC.task_rules(rows, rows).first()
    assert not found["material_improvement"] and not found["practically_strong"]
    assert found["minimum_mean_recall"] == 0.5


def test_half_way_ratio_as_in_sql(spark, tmp_path):
    """41 digits in 640 characters, a line break included: 0.0640625, whose product with a million is below a half."""
    texts = [(i, ("7" * k).ljust(n - 1, "x"), "en", "web") for i, (k, n) in enumerate([(41, 640), (201, 3200), (1, 640), (1, 128)])]
    spark.createDataFrame(
        [(i, t, lang, src, len(t)) for i, t, lang, src in texts],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    ).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint").coalesce(1).write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(catalog.ORACLE["txt8"]).fetchdf()
    assert difference(catalog.QUERIES["txt8"](spark, str(tmp_path)).toPandas(), want) is None
