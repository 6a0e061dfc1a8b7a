"""Adapter views: issue-report shaped tables derived from the given Parquet tables.

Derived columns are synthetic but deterministic, and ``plans/oracle_views.py`` states the
same derivations in SQL. Tables that several operators share are written once per session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.constants import TICKET_LABELS
from triagemill.functions.labels import label_to_rank
from triagemill.functions.text import strip
from triagemill.operators.positions import with_position, with_previous
from triagemill.operators.skew import attach_facts
from triagemill.operators.splits import (
    chronological_holdout,
    expanding_folds,
    groups_across_folds,
    held_fold,
    validation_rows,
)
from triagemill.session import configure, materialize
from triagemill.sources.core import core_rows

_memo: dict[tuple, DataFrame] = {}


def remember(spark: SparkSession, sf_dir: str, name: str, build, written: bool = True) -> DataFrame:
    """Build a shared table once per (application, data folder).

    ``written=False`` is for plans that only number or extend rows of a written table.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _memo:
        _memo[key] = materialize(build(), name) if written else build()
    return _memo[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by key when a scan yields fewer tasks than there are cores.

    Text work is CPU-bound, and a file with one row group is one task however large the
    cluster. Scans that already have enough splits are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = docs.select("doc_id", "text", "lang", "source").join(labels, "doc_id", "left")
    doc = F.col("doc_id")
    line_break = F.instr("text", "\n")
    labelled = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "normal")
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), "major")
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), "minor")
        .otherwise("blocker")
    )
    bucket = doc % 8
    unlabelled = (
        F.when(bucket == 0, "critical")
        .when(bucket == 1, "trivial")
        .when(bucket == 2, "enhancement")
        .when(bucket == 3, "")
        .when(bucket == 4, "normal")
        .when(bucket == 5, "MAJOR")
        .when(bucket == 6, "blocker")
        .otherwise(" Minor ")
    )
    dupe = (
        F.when(doc % 50 == 3, F.concat(F.lit("missing-"), F.floor(doc / 100).cast("string")))
        .when(doc % 50 == 4, F.concat("source", F.lit(":"), (doc - 4).cast("string")))
        .when((doc % 5).isin(1, 2), (doc - 1).cast("string"))
        .otherwise("")
    )
    hours = (doc * 7919) % 100003
    return rows.select(
        doc.cast("string").alias("issue_id"),
        doc.alias("doc_key"),
        F.col("source").alias("source_project"),
        F.col("lang").alias("product"),
        F.concat("lang", F.lit("-"), (doc % 3).cast("string")).alias("component"),
        F.when(line_break > 0, F.substring("text", F.lit(1), line_break - 1))
        .otherwise(F.col("text"))
        .alias("summary"),
        F.when(line_break > 0, F.substring(F.col("text"), line_break + 1, F.length("text")))
        .otherwise("")
        .alias("description"),
        F.when(F.col("quality").isNotNull(), labelled).otherwise(unlabelled).alias("severity"),
        F.when(doc % 97 != 5, F.timestamp_seconds(F.lit(1420070400) + hours * 3600)).alias(
            "creation_time"
        ),
        dupe.alias("dupe_of"),
    )


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports in core-layer shape."""
    raw = reports(spark, sf_dir)
    return core_rows(
        raw,
        project=F.col("source_project"),
        source_file=F.concat(F.col("source_project"), F.lit("_dataset_issues.csv")),
    )


def ticket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of tickets that no other column yields; shuffles carry these only."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("seq"),
            F.col("o_custkey").alias("customer"),
            F.col("n_name").alias("project"),
            F.col("c_mktsegment").alias("component"),
            F.col("o_orderpriority").alias("severity"),
            F.col("o_orderdate").cast("timestamp").alias("creation_time"),
        )
    )


def ticket_id() -> Column:
    return F.col("seq").cast("string")


def ticket_group() -> Column:
    """Duplicate group; every eleventh ticket is in none."""
    return F.when(
        F.col("seq") % 11 != 0,
        F.concat(
            F.col("customer").cast("string"), F.lit("-"), (F.col("seq") % 40).cast("string")
        ),
    )


def with_derived(rows: DataFrame) -> DataFrame:
    own = ["seq", "customer", "project", "component", "severity", "creation_time"]
    return rows.select(
        ticket_id().alias("id"),
        *own[:-1],
        label_to_rank(F.col("severity"), TICKET_LABELS).alias("rank"),
        "creation_time",
        ticket_group().alias("duplicate_group"),
        *[c for c in rows.columns if c not in own],
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_derived(ticket_rows(spark, sf_dir))


def placed_ticket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket rows in their chronological positions, which are written once."""
    return remember(
        spark,
        sf_dir,
        "tickets_split",
        lambda: chronological_holdout(
            ticket_rows(spark, sf_dir), "creation_time", "seq", "severity"
        ),
        written=False,
    )


def positioned_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with the 80/20 chronological side of every row."""
    return with_derived(placed_ticket_rows(spark, sf_dir))


def ticket_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three purged expanding folds over all tickets."""
    return remember(
        spark,
        sf_dir,
        "ticket_folds",
        lambda: expanding_folds(positioned_tickets(spark, sf_dir), 3),
    )


def majority_label(counts: DataFrame, by: list[str], label: str, weight: str) -> DataFrame:
    """Most frequent label per key, ties to the smaller label."""
    return counts.groupBy(*by).agg(
        F.min_by(F.col(label), F.struct(-F.col(weight), F.col(label))).alias("majority")
    )


RULE_MODELS = ("component_majority", "previous_ticket", "project_majority")


def predicted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation tickets of the three folds, with one label column for each rule model."""
    return remember(spark, sf_dir, "predicted_cases", lambda: _predicted_cases(spark, sf_dir))


def _predicted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_ticket_rows(spark, sf_dir).drop("partition")
    groups = groups_across_folds(
        placed.withColumn("duplicate_group", ticket_group()), 3, "duplicate_group"
    )
    # the rows of a fold's train side are those of all windows before its own
    train = (
        placed.withColumn("_held", held_fold(3))
        .filter(F.col("_held") < 3)
        .groupBy("_held", "project", "component", "severity")
        .agg(F.count("*").alias("_n"))
        .withColumn("fold", F.explode(F.sequence(F.col("_held") + 1, F.lit(3))))
    )

    def majority(column: str) -> DataFrame:
        counts = train.groupBy("fold", column, "severity").agg(F.sum("_n").alias("n"))
        return majority_label(counts, ["fold", column], "severity", "n")

    component = majority("component").withColumnRenamed("majority", "component_majority")
    project = majority("project").withColumnRenamed("majority", "project_majority")
    rows = with_previous(placed, "customer", "severity", "previous_ticket")
    held = validation_rows(
        rows.withColumn("duplicate_group", ticket_group()).drop("customer"),
        groups,
        3,
        "duplicate_group",
    )
    return (
        held.drop("duplicate_group")
        .join(component, ["fold", "component"], "left")
        .join(project, ["fold", "project"], "left")
        .withColumn("previous_ticket", F.coalesce("previous_ticket", "component_majority"))
    )


def case_ranks(cases: DataFrame) -> DataFrame:
    """True rank and the rank of every rule model's label."""
    return cases.select(
        label_to_rank(F.col("severity"), TICKET_LABELS).alias("true_rank"),
        *[label_to_rank(F.col(m), TICKET_LABELS).alias(m) for m in RULE_MODELS],
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of three rule models over the three ticket folds."""
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(m).alias("label")) for m in RULE_MODELS]
    )
    return predicted_cases(spark, sf_dir).withColumn("_m", F.explode(models)).select(
        ticket_id().alias("id"),
        "fold",
        F.col("_m.model").alias("model"),
        "project",
        "component",
        F.col("severity").alias("true_label"),
        F.col("_m.label").alias("predicted_label"),
        label_to_rank(F.col("severity"), TICKET_LABELS).alias("true_rank"),
        label_to_rank(F.col("_m.label"), TICKET_LABELS).alias("predicted_rank"),
        "creation_time",
        "pos",
        "n_rows",
    )


def report_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remember(
        spark, sf_dir, "report_predictions", lambda: _report_predictions(spark, sf_dir)
    )


def _report_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each eligible report with the majority class of its component as prediction."""
    from triagemill.operators.eligibility import eligible_reports

    rows = eligible_reports(core(spark, sf_dir))
    counts = rows.groupBy("component", "severity").agg(F.count("*").alias("n"))
    majority = majority_label(counts, ["component"], "severity", "n").withColumnRenamed(
        "majority", "predicted_label"
    )
    weights = counts.groupBy("component").agg(F.sum("n").alias("_n"))
    facts = majority.join(weights, "component")
    return attach_facts(
        rows, facts, "component", "_n", F.col("global_report_key"), "inner"
    ).select(
        F.col("global_report_key").alias("report_id"),
        F.col("severity").alias("true_label"),
        "predicted_label",
        (F.col("severity") == F.col("predicted_label")).alias("correct"),
        "summary",
        "description",
        "creation_time",
        "product",
        "component",
    )


def report_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated eligible reports with their texts: the modelling view."""
    from triagemill.operators.duplicates import keep_earliest
    from triagemill.operators.eligibility import eligible_reports

    def build() -> DataFrame:
        return keep_earliest(eligible_reports(core(spark, sf_dir))).select(
            "global_report_key",
            "source_project",
            "severity",
            "creation_time",
            "component",
            F.col("duplicate_group_id").alias("duplicate_group"),
            "summary",
            "description",
        )

    return remember(spark, sf_dir, "report_docs", build)


def report_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three purged expanding folds over the modelling view, without its texts."""

    def build() -> DataFrame:
        rows = report_docs(spark, sf_dir).drop("summary", "description")
        positioned = with_position(rows, ["creation_time", "global_report_key"])
        return expanding_folds(positioned, 3)

    return remember(spark, sf_dir, "report_folds", build)


def report_fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority class of the component, and of all training rows, per report fold."""
    folds = report_folds(spark, sf_dir)
    train = (
        folds.filter(F.col("role") == "train")
        .groupBy("fold", "component", "severity")
        .agg(F.count("*").alias("n"))
    )
    totals = train.groupBy("fold", "severity").agg(F.sum("n").alias("n"))
    overall = majority_label(totals, ["fold"], "severity", "n").withColumnRenamed(
        "majority", "overall"
    )
    local = majority_label(train, ["fold", "component"], "severity", "n")
    models = F.array(
        F.struct(F.lit("component_majority").alias("model"),
                 F.coalesce("majority", "overall").alias("label")),
        F.struct(F.lit("overall_majority").alias("model"), F.col("overall").alias("label")),
    )
    return (
        folds.filter(F.col("role") == "validation")
        .join(local, ["fold", "component"], "left")
        .join(F.broadcast(overall), "fold")
        .withColumn("_m", F.explode(models))
        .select(
            "global_report_key",
            "fold",
            F.col("_m.model").alias("model"),
            F.col("severity").alias("true_label"),
            F.col("_m.label").alias("predicted_label"),
        )
    )


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remember(spark, sf_dir, "probabilities", lambda: _probabilities(spark, sf_dir))


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative probabilities P(rank > t) per ticket from its component's development rows.

    q1 and q2 are swapped on every sixth ticket so that some rows violate monotonicity.
    """
    split = positioned_tickets(spark, sf_dir)
    rates = (
        split.filter(F.col("partition") == "development")
        .groupBy("component")
        .agg(*[F.avg((F.col("rank") > t).cast("double")).alias(f"r{t}") for t in range(4)])
    )
    swap = F.col("seq") % 6 == 0
    return split.join(rates, "component").select(
        "id",
        "seq",
        "component",
        "partition",
        F.col("severity").alias("true_label"),
        F.col("rank").alias("true_rank"),
        F.array(
            F.col("r0"),
            F.when(swap, F.col("r2")).otherwise(F.col("r1")),
            F.when(swap, F.col("r1")).otherwise(F.col("r2")),
            F.col("r3"),
        ).alias("q"),
    )
