"""Exact duplicates, label conflicts, link groups and their audits.

A single text may hold a large share of all rows, so groups are always reduced by
partially-aggregable functions and facts flow back to rows through ``attach_facts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.constants import LABELS
from triagemill.functions.text import (
    is_blank,
    normalized_text_hash,
    raw_text_hash,
    strip,
    text_or_empty,
)
from triagemill.operators.skew import attach_facts
from triagemill.session import materialize


def drop_exact_duplicates(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """First row per distinct ``columns`` in ``order_by`` order, with the rows removed for it.

    ``order_by`` must be unique. The key is a hash of the texts; the minimum is combined on
    the map side, so a text shared by many rows costs one row per task in the shuffle.
    """
    length_prefixed = F.concat_ws(
        "\x1f",
        *[
            x
            for c in columns
            for x in (F.length(text_or_empty(F.col(c))).cast("string"), text_or_empty(F.col(c)))
        ],
    )
    payload = order_by + [c for c in df.columns if c not in order_by]
    return (
        df.groupBy(F.sha2(length_prefixed, 256).alias("_text_key"))
        .agg(
            F.min(F.struct(*payload)).alias("_first"),
            (F.count("*") - 1).alias("copies_removed"),
        )
        .select(*[F.col("_first")[c].alias(c) for c in df.columns], "copies_removed")
    )


def _retained(df: DataFrame, text_hash: str) -> DataFrame:
    first = F.min(F.struct("creation_time", "global_report_key", "severity"))
    return df.groupBy(F.col(text_hash).alias("_hash")).agg(
        first.alias("_first"), F.count("*").alias("_copies")
    )


def _with_retained(df: DataFrame, text_hash: str) -> DataFrame:
    # written once: the join reads the groups several times, and they come from whole texts
    repeated = materialize(
        _retained(df, text_hash).filter(F.col("_copies") > 1), "repeated-texts"
    )
    return attach_facts(
        df.withColumn("_hash", F.col(text_hash)),
        repeated,
        "_hash",
        "_copies",
        F.col("global_report_key"),
        "left",
    ).drop("_hash")


def keep_earliest(df: DataFrame, text_hash: str = "exact_text_hash") -> DataFrame:
    """Rows that are the earliest (time, then key) of their text."""
    return (
        _with_retained(df, text_hash)
        .filter(
            F.col("_first").isNull()
            | (F.col("global_report_key") == F.col("_first.global_report_key"))
        )
        .drop("_first", "_copies")
    )


def removal_log(df: DataFrame, text_hash: str = "exact_text_hash") -> DataFrame:
    """One row per removed later copy with the row retained in its place.

    Only keys, times, labels and hashes take part. They are written once so that texts are
    hashed once.
    """
    narrow = df.select("global_report_key", "creation_time", "severity", text_hash)
    return (
        _with_retained(materialize(narrow, "text-hashes"), text_hash)
        .filter(F.col("global_report_key") != F.col("_first.global_report_key"))
        .select(
            F.col("global_report_key").alias("removed_report_key"),
            F.col("_first.global_report_key").alias("retained_report_key"),
            F.col("creation_time").alias("removed_creation_time"),
            F.col("_first.creation_time").alias("retained_creation_time"),
            F.col("severity").alias("removed_label"),
            F.col("_first.severity").alias("retained_label"),
            F.col(text_hash).alias("exact_text_hash"),
            F.lit("removed_later_exact_duplicate").alias("decision"),
        )
    )


def label_conflicts(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Text hashes that carry several labels of the fixed list.

    The label set is gathered as one flag per fixed label, never as a list of rows.
    """
    seen = [F.max((F.col("severity") == x).cast("int")).alias(f"_l{i}") for i, x in
            enumerate(sorted(labels))]
    present = F.filter(
        F.array(
            *[F.when(F.col(f"_l{i}") == 1, x) for i, x in enumerate(sorted(labels))]
        ),
        lambda x: x.isNotNull(),
    )
    return (
        df.groupBy("exact_text_hash")
        .agg(
            *seen,
            F.count("*").alias("row_count"),
            F.min("creation_time").alias("earliest_creation_time"),
            F.max("creation_time").alias("latest_creation_time"),
        )
        .withColumn("_present", present)
        .filter(F.size("_present") > 1)
        .select(
            "exact_text_hash",
            F.array_join("_present", ",").alias("labels"),
            "row_count",
            "earliest_creation_time",
            "latest_creation_time",
        )
    )


def conflict_members(df: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Every row of a conflicting text, one line each, with the facts of its group."""
    conflicts = label_conflicts(df, labels).withColumnRenamed("exact_text_hash", "_hash")
    facts = materialize(conflicts, "conflicts")
    return attach_facts(
        df.withColumn("_hash", F.col("exact_text_hash")),
        facts,
        "_hash",
        "row_count",
        F.col("global_report_key"),
        "inner",
    ).drop("_hash")


def one_hop_group(df: DataFrame, key: str, link: str) -> DataFrame:
    """``duplicate_group``: the link target when there is one, else the row's own key."""
    return df.withColumn(
        "duplicate_group",
        F.when(~is_blank(F.col(link)), strip(text_or_empty(F.col(link)))).otherwise(
            F.col(key).cast("string")
        ),
    )


def connected_groups(df: DataFrame, key: str, link: str) -> DataFrame:
    """(key, duplicate_group) with the smallest member of the connected component as label.

    Targets missing from the table still join their sources. Each round points every node at
    the smallest neighbour seen from either side and then shortcuts through it, so chains
    shrink geometrically; it ends when the links repeat. A hub with very many links is only ever reduced by ``min``.
    """
    target = strip(text_or_empty(F.col(link)))
    own = F.col(key).cast("string")
    edges = (
        df.filter((target != "") & (target != own))
        .select(F.greatest(own, target).alias("v"), F.least(own, target).alias("u"))
        .distinct()
    )
    star = _stars(edges)
    nodes = df.select(own.alias("key")).distinct()
    return nodes.join(star.withColumnRenamed("v", "key"), "key", "left").select(
        "key", F.coalesce("u", "key").alias("duplicate_group")
    )


def _stars(edges: DataFrame) -> DataFrame:
    """(v, u) for every node but the smallest of its component, which is u."""
    star = materialize(edges, "links")
    digest = _edge_digest(star)
    while True:
        star = materialize(_small_star(_large_star(star)), "links")
        latest = _edge_digest(star)
        if latest == digest:
            return star
        digest = latest


def empty_forest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, root string")


def merge_links(forest: DataFrame, links: DataFrame) -> DataFrame:
    """``forest`` (key, root: smallest key of its component) after ``links`` (a, b) are added.

    Links are contracted to links between the roots of their ends, so rounds run over touched
    roots only and the rest of the forest is read once. Ends that the forest does not know join
    it. Links with a null or empty end, of a node with itself and repeated links change nothing.
    A hub with very many new links, or a root with very many keys, is dealt out by
    ``attach_facts``. Written to the shared folder, so batch after batch keeps a short plan.
    """
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    new = (
        links.filter((a != "") & (b != "") & (a != b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )
    new = materialize(new, "new-links")
    ends = new.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key")
    known = ends.agg(F.count("*").alias("_links")).join(forest, "key", "left")
    known = materialize(known, "link-ends")
    end_roots = known.select("key", "_links", F.coalesce("root", "key").alias("_root"))
    contracted = new
    for end, other in (("a", "b"), ("b", "a")):
        facts = end_roots.select(
            F.col("key").alias(end), F.col("_links"), F.col("_root").alias(f"{end}_root")
        )
        contracted = attach_facts(contracted, facts, end, "_links", F.col(other)).drop("_links")
    moved = _stars(
        contracted.filter(F.col("a_root") != F.col("b_root"))
        .select(
            F.greatest("a_root", "b_root").alias("v"), F.least("a_root", "b_root").alias("u")
        )
        .distinct()
    )
    grown = forest.select("key", "root").unionByName(
        known.filter(F.col("root").isNull()).select("key", F.col("key").alias("root"))
    )
    sizes = grown.groupBy("root").agg(F.count("*").alias("_keys"))
    facts = sizes.join(moved.withColumnRenamed("v", "root"), "root")
    facts = materialize(facts, "moved-roots")
    merged = attach_facts(grown, facts, "root", "_keys", F.col("key"))
    return materialize(merged.select("key", F.coalesce("u", "root").alias("root")), "forest")


def _edge_digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")
    ).first()
    return row["n"], row["x"]


def _point_at(directed: DataFrame, low: DataFrame) -> DataFrame:
    return attach_facts(directed, low, "a", "_degree", F.col("b"), "inner")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to the node's smallest neighbour or itself."""
    both = edges.select(F.col("v").alias("a"), F.col("u").alias("b")).unionByName(
        edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    )
    low = both.groupBy("a").agg(
        F.least(F.min("b"), F.first("a")).alias("_low"), F.count("*").alias("_degree")
    )
    return (
        _point_at(both, low)
        .filter(F.col("b") > F.col("a"))
        .select(F.col("b").alias("v"), F.col("_low").alias("u"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, move to the smallest of them."""
    down = edges.filter(F.col("v") > F.col("u")).select(
        F.col("v").alias("a"), F.col("u").alias("b")
    )
    low = down.groupBy("a").agg(F.min("b").alias("_low"), F.count("*").alias("_degree"))
    moved = (
        _point_at(down, low)
        .filter(F.col("b") != F.col("_low"))
        .select(F.col("b").alias("v"), F.col("_low").alias("u"))
    )
    return moved.unionByName(
        low.select(F.col("a").alias("v"), F.col("_low").alias("u"))
    ).distinct()


def duplicate_groups(core: DataFrame) -> DataFrame:
    """Repeated texts and link groups in one table, one row per group.

    ``projects`` is the number of projects; the names come from :func:`group_projects`.
    """
    per_project = core.groupBy("exact_text_hash", "source_project").agg(
        F.count("*").alias("_n"),
        F.min(
            F.struct(F.col("creation_time").isNull().alias("_no_time"), "creation_time",
                     "global_report_key")
        ).alias("_first"),
    )
    exact = (
        per_project.groupBy("exact_text_hash")
        .agg(
            F.sum("_n").alias("row_count"),
            F.count("*").alias("project_count"),
            F.array_join(F.array_sort(F.collect_list("source_project")), ",").alias("projects"),
            F.min("_first").alias("_first"),
        )
        .filter(F.col("row_count") > 1)
        .select(
            F.lit("exact_text_hash").alias("group_type"),
            F.col("exact_text_hash").alias("group_id"),
            "exact_text_hash",
            "row_count",
            "project_count",
            "projects",
            F.col("_first.global_report_key").alias("preferred_report_key"),
            F.lit("earliest_valid_creation_time").alias("retention_rule"),
        )
    )
    target = strip(text_or_empty(F.col("dupe_of")))
    group_id = F.concat(F.col("source_project"), F.lit(":"), F.col("_target"))
    links = (
        core.withColumn("_target", target)
        .filter(F.col("_target") != "")
        .groupBy("source_project", "_target")
        .agg((F.count("*") + 1).alias("row_count"))
        .select(
            F.lit("dupe_of").alias("group_type"),
            group_id.alias("group_id"),
            F.lit("").alias("exact_text_hash"),
            "row_count",
            F.lit(1).cast("bigint").alias("project_count"),
            F.col("source_project").alias("projects"),
            group_id.alias("preferred_report_key"),
            F.lit("canonical_dupe_of_target").alias("retention_rule"),
        )
    )
    return exact.unionByName(links)


def _metric(df: DataFrame, name: str, value) -> DataFrame:
    return df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("count")).select(
        F.lit(name).alias("metric"), "count"
    )


def duplicate_summary(core: DataFrame) -> DataFrame:
    ids = core.groupBy("source_project", "issue_id").agg(F.count("*").alias("n"))
    keys = core.groupBy("global_report_key").agg(F.count("*").alias("n"))
    texts = (
        core.groupBy("exact_text_hash", "source_project")
        .agg(F.count("*").alias("n"))
        .groupBy("exact_text_hash")
        .agg(F.sum("n").alias("n"), F.count("*").alias("projects"))
    )
    return (
        _metric(ids, "duplicate_project_issue_ids", F.sum(F.col("n") - 1))
        .unionByName(_metric(keys, "duplicate_global_report_keys", F.sum(F.col("n") - 1)))
        .unionByName(_metric(texts, "exact_duplicate_text_rows", F.sum(F.col("n") - 1)))
        .unionByName(
            _metric(core, "linked_duplicate_rows", F.count_if(~is_blank(F.col("dupe_of"))))
        )
        .unionByName(
            _metric(
                texts, "cross_project_exact_duplicate_groups", F.count_if(F.col("projects") > 1)
            )
        )
    )


def duplicate_audit(df: DataFrame, group: str) -> DataFrame:
    """Exact, normalized and explicit groups: groups and rows beyond the first of each."""
    hashed = df.select(
        raw_text_hash(F.col("summary"), F.col("description")).alias("exact"),
        normalized_text_hash(F.col("summary"), F.col("description")).alias("normalized"),
        F.col(group).alias("explicit_group"),
    )
    kinds = hashed.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("type"), F.col(k).alias("value"))
                    for k in ("exact", "normalized", "explicit_group")
                ]
            )
        ).alias("k")
    ).select("k.*")
    counts = kinds.groupBy("type", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("type").agg(
        F.count_if((F.col("n") > 1) | (F.col("type") == "explicit_group")).alias("groups"),
        F.sum(F.col("n") - 1).alias("duplicate_rows"),
    )


def cross_project_overlap(core: DataFrame) -> DataFrame:
    def spanning(column: str) -> DataFrame:
        return (
            core.groupBy(column, "source_project")
            .agg(F.count("*").alias("n"))
            .groupBy(column)
            .agg(F.count("*").alias("projects"), F.sum("n").alias("n"))
        )

    keys = spanning("global_report_key")
    links = core.select(strip(text_or_empty(F.col("dupe_of"))).alias("target")).filter(
        F.col("target").contains(":")
    )
    # one row per distinct target before the join, so a popular target is no hot key
    targets = links.groupBy("target").agg(F.count("*").alias("n"))
    resolved = targets.join(
        keys.select(F.col("global_report_key").alias("target")), "target", "left_semi"
    )
    return (
        _metric(
            spanning("issue_id"),
            "numeric_issue_ids_present_in_multiple_projects",
            F.count_if(F.col("projects") > 1),
        )
        .unionByName(_metric(keys, "duplicate_global_report_keys", F.sum(F.col("n") - 1)))
        .unionByName(
            _metric(
                spanning("exact_text_hash"),
                "exact_text_hashes_across_projects",
                F.count_if(F.col("projects") > 1),
            )
        )
        .unionByName(_metric(targets, "explicit_cross_project_dupe_links", F.sum("n")))
        .unionByName(_metric(resolved, "resolved_cross_project_dupe_links", F.sum("n")))
    )


def fold_crossings(folds: DataFrame, groups: list[str]) -> DataFrame:
    """Per fold and group column: groups on both the train and the validation side.

    Rows without a group belong to none.
    """
    kinds = F.explode(
        F.array(
            *[F.struct(F.lit(g).alias("kind"), F.col(g).alias("value")) for g in groups]
        )
    )
    return (
        folds.select("fold", "role", kinds.alias("k"))
        .filter(F.col("k.value").isNotNull())
        .groupBy("fold", F.col("k.kind").alias("kind"), F.col("k.value").alias("value"))
        .agg(
            F.max((F.col("role") == "train").cast("int")).alias("_t"),
            F.max((F.col("role") == "validation").cast("int")).alias("_v"),
        )
        .groupBy("fold", "kind")
        .agg(F.sum(F.col("_t") * F.col("_v")).alias("crossing_groups"))
    )


def repeated_rows(df: DataFrame, group: str, key: str) -> DataFrame:
    """Rows whose ``group`` occurs more than once; rows without a group are none of them."""
    facts = (
        df.filter(F.col(group).isNotNull())
        .groupBy(F.col(group).alias(group))
        .agg(F.count("*").alias("_copies"))
        .filter(F.col("_copies") > 1)
    )
    facts = materialize(facts, "repeated-groups")
    return attach_facts(df, facts, group, "_copies", F.col(key), "inner").withColumnRenamed(
        "_copies", "group_rows"
    )


def link_counts(core: DataFrame) -> DataFrame:
    return core.groupBy("source_project").agg(
        F.count_if(~is_blank(F.col("dupe_of"))).alias("dupe_of_relationships")
    )
