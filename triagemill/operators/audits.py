"""Dataset audits: aggregations by project and combined, drift, readiness, samples.

The two scopes (each project, and all projects together) come from grouping sets over rows
that were first reduced to small counts, so one pass over the data serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagemill.constants import LABEL_EXCLUSIONS, LABEL_GROUPS, LABEL_WORDS, LABELS
from triagemill.functions import text as X
from triagemill.functions.labels import grouped_label, invert, normalize_label

COMBINED = "combined"


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and number of rows per term of ``docs(issue_id, terms)``.

    Terms are made distinct inside the row, so no (row, term) shuffle is needed.
    """
    every = F.transform(
        "terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("o"), F.lit(0).alias("r"))
    )
    once = F.transform(
        F.array_distinct("terms"),
        lambda t: F.struct(t.alias("term"), F.lit(0).alias("o"), F.lit(1).alias("r")),
    )
    return (
        docs.select(F.explode(F.concat(every, once)).alias("e"))
        .groupBy("e.term")
        .agg(F.sum("e.o").alias("occurrences"), F.sum("e.r").alias("reports"))
    )


def token_budget(
    pairs: DataFrame, first: Column, second: Column, limit: int, special: int
) -> DataFrame:
    """Keep the first text's tokens up to the budget, then fill with the second's."""
    room = limit - special
    a, b = X.whitespace_tokens(X.text_or_empty(first)), X.whitespace_tokens(
        X.text_or_empty(second)
    )
    kept_a = F.slice(a, 1, room)
    kept_b = F.slice(b, F.lit(1), F.greatest(F.lit(0), F.lit(room) - F.size(kept_a)))
    return pairs.select(
        "*",
        kept_a.alias("first_kept"),
        kept_b.alias("second_kept"),
        F.size(a).alias("first_tokens"),
        F.size(b).alias("second_tokens"),
    )


def token_budget_summary(budget: DataFrame) -> DataFrame:
    total = F.col("first_tokens") + F.col("second_tokens")
    kept = F.size("first_kept") + F.size("second_kept")
    return budget.select(
        total.alias("_t"),
        kept.alias("_k"),
        (F.col("first_tokens") == F.size("first_kept")).alias("_whole"),
    ).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("_t") == 0).alias("empty_text_count"),
        F.avg((F.col("_k") < F.col("_t")).cast("double")).alias("truncation_rate"),
        F.count_if("_whole").alias("first_preserved_rows"),
        F.sum("_k").alias("kept_tokens"),
        *[
            F.percentile("_t", q).alias(name)
            for q, name in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))
        ],
    )


def label_word_audit(rows: DataFrame, words: list[str] = LABEL_WORDS) -> DataFrame:
    """Reports per (word, field, true label) that contain the word. One pass, no cross join."""
    pairs = [(w, f) for w in words for f in ("summary", "description")]
    counted = rows.groupBy(F.col("severity").alias("true_severity")).agg(
        *[
            F.count_if(X.text_or_empty(F.col(f)).rlike(rf"(?i)\b{w}\b")).alias(f"_c{i}")
            for i, (w, f) in enumerate(pairs)
        ]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(w).alias("term"), F.lit(f).alias("field"), F.col(f"_c{i}").alias("reports")
            )
            for i, (w, f) in enumerate(pairs)
        ]
    )
    return (
        counted.select("true_severity", F.explode(entries).alias("e"))
        .select("e.term", "e.field", "true_severity", "e.reports")
        .filter(F.col("reports") > 0)
    )


def boilerplate(rows: DataFrame, width: int = 40, top: int = 30) -> DataFrame:
    text = X.joined(F.col("summary"), F.col("description"))
    return (
        rows.groupBy(F.substring(F.lower(text), 1, width).alias("prefix"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "prefix")
        .limit(top)
    )


def unicode_audit(rows: DataFrame) -> DataFrame:
    text = X.joined(F.col("summary"), F.col("description"))
    return rows.select(text.alias("t"), X.nfkc(text).alias("n")).agg(
        F.count_if(F.col("t") != F.col("n")).alias("rows_changed_nfkc"),
        F.count_if(F.col("t").contains("�")).alias("replacement_character_rows"),
    )


def _scoped(counts: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregate small counts by (source_project, keys) and by keys over all projects."""
    sets = [[F.col("source_project"), *[F.col(k) for k in keys]], [F.col(k) for k in keys]]
    return (
        counts.groupingSets(sets, "source_project", *keys)
        .agg(F.grouping("source_project").alias("_all"), *aggregates)
        .withColumn(
            "scope", F.when(F.col("_all") == 1, COMBINED).otherwise(F.col("source_project"))
        )
        .drop("_all", "source_project")
    )


def label_counts(core: DataFrame) -> DataFrame:
    """(source_project, label, n): the small table behind every label audit."""
    return core.groupBy("source_project", normalize_label(F.col("severity")).alias("label")).agg(
        F.count("*").alias("n")
    )


def label_table(
    core: DataFrame,
    exclusions: list[str] = LABEL_EXCLUSIONS,
    groups: dict[str, list[str]] = LABEL_GROUPS,
) -> DataFrame:
    """Labels by project and combined with share, flags and the count to retain."""
    scoped = _scoped(label_counts(core), ["label"], [F.sum("n").alias("count")])
    banned = [x.strip().lower() for x in exclusions]
    blank, excluded = F.col("label") == "", F.col("label").isin(banned)
    return scoped.select(
        "scope",
        F.col("label").alias("normalized_severity"),
        "count",
        (F.col("count") / F.sum("count").over(Window.partitionBy("scope"))).alias("percentage"),
        blank.alias("is_missing_or_blank"),
        excluded.alias("is_excluded"),
        F.col("label").isin(list(invert(groups))).alias("is_expected"),
        F.when(~blank & ~excluded, F.col("count")).otherwise(0).alias("proposed_retained_count"),
    )


def grouped_preview(core: DataFrame, groups: dict[str, list[str]] = LABEL_GROUPS) -> DataFrame:
    counts = label_counts(core).withColumn(
        "grouped_severity",
        F.coalesce(grouped_label(F.col("label"), groups, strict=False), F.lit("<unmapped>")),
    )
    return _scoped(counts, ["grouped_severity"], [F.sum("n").alias("count")])


def unexpected_labels(core: DataFrame) -> DataFrame:
    return label_table(core).filter(~F.col("is_expected"))


def inspect_dataset(core: DataFrame, columns: list[str]) -> DataFrame:
    """Long-form inspection: (section, item, count, share, detail)."""
    label = normalize_label(F.col("severity"))
    banned = [x.strip().lower() for x in LABEL_EXCLUSIONS]
    retained = (label != "") & ~label.isin(banned)
    wide = core.agg(
        F.count("*").alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing:{c}") for c in columns],
        *[
            F.count_if(X.is_blank(F.col(c))).alias(f"empty:{c}")
            for c in ("summary", "description", "severity")
        ],
        F.count_if(retained).alias("proposed_retained_rows"),
        F.count_if(~retained).alias("proposed_excluded_rows"),
        F.min("creation_time").cast("string").alias("earliest"),
        F.max("creation_time").cast("string").alias("latest"),
    )
    counts = [c for c in wide.columns if c not in ("earliest", "latest")]

    def entry(section, item, count=None, share=None, detail=None) -> Column:
        return F.struct(
            section.alias("section"),
            item.alias("item"),
            (count if count is not None else F.lit(0)).cast("bigint").alias("count"),
            (share if share is not None else F.lit(0.0)).alias("share"),
            F.coalesce(detail if detail is not None else F.lit(""), F.lit("")).alias("detail"),
        )

    rows = wide.select(
        F.explode(
            F.array(
                *[entry(F.lit("rows"), F.lit(c), F.col(f"`{c}`")) for c in counts],
                *[
                    entry(F.lit("creation_range"), F.lit(c), detail=F.col(c))
                    for c in ("earliest", "latest")
                ],
            )
        ).alias("e")
    ).select("e.*")
    values = (
        core.select(
            F.explode(
                F.array(
                    F.struct(F.lit("severity").alias("section"), label.alias("item")),
                    *[
                        F.struct(
                            F.lit(c).alias("section"),
                            F.coalesce(F.col(c), F.lit("<missing>")).alias("item"),
                        )
                        for c in ("product", "component")
                    ],
                )
            ).alias("e")
        )
        .groupBy("e.section", "e.item")
        .agg(F.count("*").alias("count"))
        .withColumn(
            "share",
            F.when(
                F.col("section") == "severity",
                F.col("count") / F.sum("count").over(Window.partitionBy("section")),
            ).otherwise(0.0),
        )
        .withColumn("detail", F.lit(""))
    )
    copies = (
        core.groupBy(
            F.sha2(X.text_or_empty(F.col("summary")), 256).alias("s"),
            F.sha2(X.text_or_empty(F.col("description")), 256).alias("d"),
        )
        .agg((F.count("*") - 1).alias("extra"))
        .agg(F.sum("extra").alias("count"))
        .select(
            F.lit("rows").alias("section"),
            F.lit("duplicate_count").alias("item"),
            "count",
            F.lit(0.0).alias("share"),
            F.lit("").alias("detail"),
        )
    )
    return rows.unionByName(values).unionByName(copies)


def text_audit(core: DataFrame) -> DataFrame:
    """Lengths, tokens, extremes and indicator rows by project and combined."""
    s, d = X.text_or_empty(F.col("summary")), X.text_or_empty(F.col("description"))
    text = X.joined(F.col("summary"), F.col("description"))
    flags = X.audit_indicators(text)
    per_row = core.select(
        "source_project",
        X.is_blank(s).alias("no_s"),
        X.is_blank(d).alias("no_d"),
        F.length(s).cast("bigint").alias("summary_chars"),
        F.length(d).cast("bigint").alias("description_chars"),
        (F.length(s) + F.length(d)).cast("bigint").alias("combined_chars"),
        X.token_count(s).alias("summary_tokens"),
        X.token_count(d).alias("description_tokens"),
        *[c.alias(n) for n, c in flags.items()],
    )
    measures = [
        F.count("*").alias("rows"),
        F.count_if("no_s").alias("missing_or_empty_summary"),
        F.count_if("no_d").alias("missing_or_empty_description"),
        F.count_if(F.col("no_s") & F.col("no_d")).alias("both_missing"),
    ]
    for field in ("summary", "description", "combined"):
        c = f"{field}_chars"
        measures += [
            F.min(c).alias(f"{field}_min_chars"),
            F.avg(c).alias(f"{field}_mean_chars"),
            F.max(c).alias(f"{field}_max_chars"),
        ]
    for field in ("summary", "description"):
        c = f"{field}_tokens"
        measures += [F.avg(c).alias(f"{field}_mean_tokens"), F.max(c).alias(f"{field}_max_tokens")]
    measures += [
        F.count_if(F.col("combined_chars") < 20).alias("extremely_short_under_20_chars"),
        F.count_if(F.col("combined_chars") > 100000).alias("extremely_long_over_100000_chars"),
        F.count_if("has_url").alias("url_occurrence_rows"),
        F.count_if("has_email").alias("email_occurrence_rows"),
        F.count_if("has_html").alias("html_occurrence_rows"),
        F.count_if("has_code").alias("code_or_stack_trace_rows"),
    ]
    return (
        per_row.rollup("source_project")
        .agg(F.grouping("source_project").alias("_all"), *measures)
        .withColumn(
            "scope", F.when(F.col("_all") == 1, COMBINED).otherwise(F.col("source_project"))
        )
        .drop("_all", "source_project")
    )


def usable_rows(core: DataFrame, exclusions: list[str] = LABEL_EXCLUSIONS) -> DataFrame:
    """Dated rows with a label that is neither blank nor excluded."""
    banned = [x.strip().lower() for x in exclusions]
    label = normalize_label(F.col("severity"))
    return core.filter(
        F.col("creation_time").isNotNull() & (label != "") & ~label.isin(banned)
    ).withColumn("severity", label)


def preview_positions(core: DataFrame) -> DataFrame:
    """Usable rows with their time position inside their project and over all projects."""
    from triagemill.operators.positions import with_position

    rows = usable_rows(core).select(
        F.col("source_project").alias("scope"), "global_report_key", "creation_time", "severity"
    )
    order = ["creation_time", "global_report_key"]
    return with_position(rows, order, scope="scope").unionByName(
        with_position(rows.withColumn("scope", F.lit(COMBINED)), order)
    )


def holdout_preview(positions: DataFrame, fraction: float = 0.8) -> DataFrame:
    side = F.when(
        F.col("pos") < F.floor(F.col("n_rows") * F.lit(float(fraction))), "development"
    ).otherwise("test")
    return positions.groupBy("scope", side.alias("partition"), "severity").agg(
        F.count("*").alias("count")
    )


def cv_preview(positions: DataFrame, k: int = 3, fraction: float = 0.8) -> DataFrame:
    """Counts per preview fold; boundaries are k + 2 even steps over the development rows."""
    cut = F.floor(F.col("n_rows") * F.lit(float(fraction)))

    def bound(i: int) -> Column:
        return F.floor(F.lit(i) * cut / F.lit(k + 1))

    bounds = F.array(
        *[
            F.struct(F.lit(i).alias("fold"), bound(i).alias("start"), bound(i + 1).alias("stop"))
            for i in range(1, k + 1)
        ]
    )
    return (
        positions.withColumn("b", F.explode(bounds))
        .filter(F.col("pos") < F.col("b.stop"))
        .groupBy(
            "scope",
            F.col("b.fold").alias("fold"),
            F.when(F.col("pos") < F.col("b.start"), "train").otherwise("validation").alias(
                "partition"
            ),
            "severity",
        )
        .agg(F.count("*").alias("count"))
    )


def _labels_where(condition: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(condition, F.col("severity"))))


def temporal_coverage(core: DataFrame, holdout: DataFrame, cv: DataFrame, k: int = 3) -> DataFrame:
    span = (
        core.rollup("source_project")
        .agg(
            F.grouping("source_project").alias("_all"),
            F.min("creation_time").alias("minimum_creation_time"),
            F.max("creation_time").alias("maximum_creation_time"),
            F.count_if(F.col("creation_time").isNull()).alias("invalid_dates"),
            F.count("creation_time").alias("valid_dates"),
        )
        .withColumn(
            "scope", F.when(F.col("_all") == 1, COMBINED).otherwise(F.col("source_project"))
        )
        .drop("_all", "source_project")
    )
    sides = holdout.groupBy("scope").agg(
        _labels_where(F.col("partition") == "development").alias("_dev"),
        _labels_where(F.col("partition") == "test").alias("_test"),
    )
    folds = (
        cv.filter(F.col("partition") == "validation")
        .groupBy("scope")
        .agg(F.count_distinct("fold").alias("_folds"))
    )
    none = F.array().cast("array<string>")
    dev, test = F.coalesce("_dev", none), F.coalesce("_test", none)
    return (
        span.join(sides, "scope", "left")
        .join(folds, "scope", "left")
        .select(
            *span.columns,
            (
                (F.size(dev) > 0) & (F.size(test) > 0) & (F.size(F.array_except(test, dev)) == 0)
            ).alias("holdout_viable"),
            (F.coalesce("_folds", F.lit(0)) == k).alias("cv_viable"),
            F.array_join(F.array_except(dev, test), ",").alias("missing_test_classes"),
            F.array_join(F.array_except(test, dev), ",").alias("future_only_classes"),
        )
    )


def label_by_year(core: DataFrame) -> DataFrame:
    """Counts per (scope, year, label), zeros included, with drift against the scope share."""
    counts = (
        core.filter(F.col("creation_time").isNotNull())
        .groupBy(
            "source_project",
            F.year("creation_time").alias("year"),
            normalize_label(F.col("severity")).alias("severity"),
        )
        .agg(F.count("*").alias("n"))
    )
    scoped = _scoped(counts, ["year", "severity"], [F.sum("n").alias("count")])
    # labels of undated rows take part too
    labels = core.select(normalize_label(F.col("severity")).alias("severity")).distinct()
    cells = scoped.select("scope", "year").distinct().crossJoin(labels)
    dense = cells.join(scoped, ["scope", "year", "severity"], "left").fillna(0, ["count"])

    def total(*keys: str) -> Column:
        return F.sum("count").over(Window.partitionBy("scope", *keys))

    share = F.col("count") / F.greatest(total("year"), F.lit(1))
    return dense.select(
        "scope",
        "year",
        "severity",
        "count",
        share.alias("percentage_within_year"),
        (F.col("count") == 0).alias("class_missing_in_period"),
        (share - total("severity") / F.greatest(total(), F.lit(1))).alias(
            "label_drift_delta_from_scope_share"
        ),
    )


def volume_risk(characters: Column) -> Column:
    return (
        F.when(characters > 1_000_000_000, "high")
        .when(characters > 100_000_000, "moderate")
        .otherwise("low")
    )


def readiness(
    labels: DataFrame,
    temporal: DataFrame,
    cv: DataFrame,
    text: DataFrame,
    minimum_total: int = 500,
    minimum_class: int = 20,
    rare_warning: int = 100,
    groups: dict[str, list[str]] = LABEL_GROUPS,
) -> DataFrame:
    """PASS / WARNING / FAIL per scope with reasons, plus the verdicts over all scopes."""
    usable = labels.filter(~F.col("is_excluded") & ~F.col("is_missing_or_blank"))
    n, name = F.col("count"), F.col("normalized_severity")

    def labels_under(limit: int) -> Column:
        return F.array_sort(F.collect_list(F.when(n < limit, name)))

    # a scope whose labels are all excluded still gets a row
    totals = labels.select("scope").distinct().join(
        usable.groupBy("scope").agg(
            F.sum(n).alias("usable_rows"),
            labels_under(rare_warning).alias("_rare"),
            labels_under(minimum_class).alias("_small"),
            F.least(
                *[F.sum(F.when(name.isin(m), n).otherwise(0)) for m in groups.values()]
            ).alias("_least_group"),
        ),
        "scope",
        "left",
    )
    folds = (
        cv.filter(F.col("partition") == "validation")
        .groupBy("scope")
        .agg(F.count_distinct("fold").alias("cv_fold_count"))
    )
    none = F.array().cast("array<string>")
    rows = (
        totals.join(
            temporal.select("scope", "future_only_classes", "invalid_dates"), "scope", "left"
        )
        .join(folds, "scope", "left")
        .fillna(0, ["usable_rows", "cv_fold_count", "invalid_dates", "_least_group"])
        .withColumns({"_rare": F.coalesce("_rare", none), "_small": F.coalesce("_small", none)})
    )
    total, future = F.col("usable_rows"), F.col("future_only_classes")
    rare, small = F.col("_rare"), F.col("_small")
    status = (
        F.when(
            (total < minimum_total)
            | (F.size(small) > 0)
            | (future != "")
            | (F.col("cv_fold_count") == 0),
            "FAIL",
        )
        .when((F.size(rare) > 0) | (F.col("invalid_dates") > 0), "WARNING")
        .otherwise("PASS")
    )
    reasons = F.array_compact(
        F.array(
            F.when(
                total < minimum_total,
                F.concat(F.lit("usable rows "), total, F.lit(f" < {minimum_total}")),
            ),
            F.when(
                F.size(small) > 0,
                F.concat(F.lit("classes below minimum: "), F.array_join(small, ",")),
            ),
            F.when(F.size(rare) > 0, F.concat(F.lit("rare classes: "), F.array_join(rare, ","))),
            F.when(
                future != "", F.concat(F.lit("classes only in test period: "), future)
            ),
            F.when(
                F.col("invalid_dates") > 0,
                F.concat(F.lit("invalid dates: "), F.col("invalid_dates")),
            ),
        )
    )
    judged = rows.select(
        "scope",
        status.alias("status"),
        "usable_rows",
        F.array_join(rare, ",").alias("rare_classes"),
        "future_only_classes",
        "cv_fold_count",
        "invalid_dates",
        (F.col("_least_group") >= minimum_class).alias("grouped_classification_feasible"),
        (status != "FAIL").alias("within_project_feasible"),
        F.when(F.size(reasons) == 0, "configured thresholds satisfied")
        .otherwise(F.array_join(reasons, "; "))
        .alias("reasons"),
    )
    is_combined = F.col("scope") == COMBINED
    overall = judged.agg(
        F.coalesce(F.bool_or(is_combined & F.col("within_project_feasible")), F.lit(False)).alias(
            "pooled_feasible"
        ),
        (F.count_if(~is_combined & F.col("within_project_feasible")) >= 2).alias(
            "cross_project_feasible"
        ),
    )
    volume = text.filter(F.col("scope") == COMBINED).select(
        F.floor(F.col("rows") * F.col("combined_mean_chars") + 1e-6).alias(
            "estimated_text_characters"
        )
    )
    volume = volume.withColumn(
        "feature_building_risk", volume_risk(F.col("estimated_text_characters"))
    )
    return judged.crossJoin(F.broadcast(overall)).crossJoin(F.broadcast(volume))


def project_summary(
    manifest: DataFrame,
    labels: DataFrame,
    text: DataFrame,
    temporal: DataFrame,
    holdout: DataFrame,
    cv: DataFrame,
    ready: DataFrame,
    links: DataFrame,
    label_names: list[str],
    k: int = 3,
) -> DataFrame:
    """One wide row per project out of the audit tables."""
    # "" is a label too; its column is named without a suffix
    severity = (
        labels.filter(F.col("scope") != COMBINED)
        .groupBy("scope")
        .agg(
            *[
                F.sum(F.when(F.col("normalized_severity") == x, F.col("count")).otherwise(0)).alias(
                    f"severity_{x}"
                )
                for x in label_names
            ]
        )
    )
    tests = holdout.groupBy("scope").agg(
        F.sum(F.when(F.col("partition") == "development", F.col("count")).otherwise(0)).alias(
            "development_size"
        ),
        F.sum(F.when(F.col("partition") == "test", F.col("count")).otherwise(0)).alias(
            "test_size"
        ),
        *[
            F.sum(
                F.when(
                    (F.col("partition") == "test") & (F.col("severity") == x), F.col("count")
                ).otherwise(0)
            ).alias(f"test_{x}")
            for x in label_names
        ],
    )
    wanted = (
        labels.filter(~F.col("is_excluded") & ~F.col("is_missing_or_blank"))
        .groupBy("scope")
        .agg(F.count("*").alias("_wanted"))
    )
    viable = (
        cv.filter(F.col("partition") == "validation")
        .groupBy("scope")
        .agg(
            *[
                F.count_distinct(F.when(F.col("fold") == i, F.col("severity"))).alias(f"_f{i}")
                for i in range(1, k + 1)
            ]
        )
    )
    return (
        manifest.withColumnRenamed("source_project", "scope")
        .join(severity, "scope")
        .join(tests, "scope", "left")
        .join(wanted, "scope", "left")
        .join(viable, "scope", "left")
        .join(text.select("scope", "combined_mean_chars"), "scope")
        .join(temporal.select("scope", "minimum_creation_time", "maximum_creation_time"), "scope")
        .join(ready.select("scope", "usable_rows", "status"), "scope")
        .join(links.withColumnRenamed("source_project", "scope"), "scope")
        .select(
            F.col("scope").alias("project"),
            F.col("raw_row_count").alias("raw_rows"),
            F.col("usable_rows").alias("modeling_eligible_rows"),
            F.col("missing_text_count").alias("missing_text_rows"),
            F.col("invalid_date_count").alias("invalid_date_rows"),
            F.col("exact_duplicate_row_count").alias("exact_duplicate_rows"),
            "dupe_of_relationships",
            "minimum_creation_time",
            "maximum_creation_time",
            "development_size",
            "test_size",
            F.col("status").alias("within_project_readiness"),
            volume_risk(F.col("usable_rows") * F.col("combined_mean_chars")).alias(
                "feature_building_risk"
            ),
            *[f"severity_{x}" for x in label_names],
            *[f"test_{x}" for x in label_names],
            *[
                (F.coalesce(f"_f{i}", F.lit(0)) >= F.col("_wanted")).alias(f"cv_fold_{i}_viable")
                for i in range(1, k + 1)
            ],
        )
    )


def class_matrix(labels: DataFrame, label_names: list[str]) -> DataFrame:
    return (
        labels.filter(F.col("scope") != COMBINED)
        .groupBy(F.col("scope").alias("project"))
        .pivot("normalized_severity", label_names)
        .agg(F.sum("count"))
        .na.fill(0)
    )


def text_volume(text: DataFrame) -> DataFrame:
    characters = F.col("rows") * F.col("combined_mean_chars")
    return text.select(
        "scope",
        F.round(characters).cast("bigint").alias("characters"),
        volume_risk(characters).alias("risk"),
    )


def _json_counts(rows: DataFrame, keys: list[str], column: str, missing: str, name: str):
    level = F.coalesce(F.col(column), F.lit(missing)).alias("_level")
    return (
        rows.groupBy(*keys, level)
        .agg(F.count("*").alias("_n"))
        .groupBy(*keys)
        .agg(
            F.to_json(
                F.map_from_entries(F.array_sort(F.collect_list(F.struct("_level", "_n"))))
            ).alias(name)
        )
    )


def temporal_drift(rows: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Per year: volume, text length, products, components, labels and distributions."""
    dated = rows.withColumn("year", F.year("creation_time"))
    length = F.length(X.joined(F.col("summary"), F.col("description"), " "))
    yearly = dated.groupBy("year").agg(
        F.count("*").alias("reports"),
        F.avg(length).alias("mean_text_length"),
        F.median(length).alias("median_text_length"),
        F.count_distinct("product").alias("products"),
        F.count_distinct("component").alias("components"),
        *[F.count_if(F.col("severity") == x).alias(x) for x in labels],
    )
    return yearly.join(
        _json_counts(dated, ["year"], "product", "[missing]", "product_distribution"), "year"
    ).join(
        _json_counts(dated, ["year"], "component", "[missing]", "component_distribution"), "year"
    )


def vocabulary_drift(rows: DataFrame) -> DataFrame:
    """Jaccard overlap of each year's summary vocabulary with the previous present year's."""
    words = (
        rows.select(
            F.year("creation_time").alias("year"),
            F.explode(X.whitespace_tokens(F.lower(X.text_or_empty(F.col("summary"))))).alias("w"),
        )
        .distinct()
    )
    years = rows.select(F.year("creation_time").alias("year")).distinct()
    # a handful of years, hence one small partition
    previous = years.select(
        "year", F.lag("year").over(Window.orderBy("year")).alias("previous_year")
    )
    sizes = words.groupBy("year").agg(F.count("*").alias("n"))
    following = previous.select(
        F.col("year").alias("next_year"), F.col("previous_year").alias("year")
    )
    # (word, year it belongs to or follows): two hits mean the word is in both vocabularies
    carried = (
        words.join(F.broadcast(following), "year")
        .select(F.col("next_year").alias("year"), "w")
        .unionByName(words)
    )
    shared = (
        carried.groupBy("year", "w")
        .agg(F.count("*").alias("c"))
        .groupBy("year")
        .agg(F.count_if(F.col("c") == 2).alias("shared"))
    )
    own, before = sizes.alias("a"), sizes.alias("b")
    return (
        previous.join(own, "year", "left")
        .join(before, F.col("previous_year") == F.col("b.year"), "left")
        .join(shared.withColumnRenamed("year", "_year"), previous["year"] == F.col("_year"), "left")
        .select(
            previous["year"].alias("year"),
            F.coalesce(F.col("a.n"), F.lit(0)).alias("summary_vocabulary"),
            F.when(
                F.col("previous_year").isNotNull(),
                F.coalesce("shared", F.lit(0))
                / F.greatest(
                    F.coalesce(F.col("a.n"), F.lit(0))
                    + F.coalesce(F.col("b.n"), F.lit(0))
                    - F.coalesce("shared", F.lit(0)),
                    F.lit(1),
                ),
            ).alias("jaccard_vs_previous"),
        )
    )


def quality_metrics(rows: DataFrame) -> DataFrame:
    """Text-quality counts with the row and exclusion reconciliation."""
    no_s, no_d = X.is_blank(F.col("summary")), X.is_blank(F.col("description"))
    text = X.joined(F.col("summary"), F.col("description"))
    wide = rows.select(
        no_s.alias("a"), no_d.alias("b"), F.length(text).alias("n"),
        text.contains("�").alias("r"),
    ).agg(
        F.count("*").alias("rows"),
        F.lit(0).cast("bigint").alias("additional_exclusions"),
        F.count_if("a").alias("blank_summary"),
        F.count_if("b").alias("blank_description"),
        F.count_if(F.col("a") & F.col("b")).alias("both_blank"),
        F.count_if(F.col("n") < 20).alias("very_short_under_20_chars"),
        F.count_if(F.col("n") > 10000).alias("extremely_long_over_10000_chars"),
        F.count_if("r").alias("replacement_character"),
    )
    return wide.unpivot([], wide.columns, "metric", "value")


def length_by_class(rows: DataFrame) -> DataFrame:
    text = X.joined(F.col("summary"), F.col("description"))
    per_row = rows.select(
        "severity",
        F.length(text).cast("bigint").alias("characters"),
        X.token_count(text).alias("tokens"),
    )
    measures = []
    for c in ("characters", "tokens"):
        measures += [
            F.count(c).alias(f"{c}_count"),
            F.avg(c).alias(f"{c}_mean"),
            F.median(c).alias(f"{c}_median"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return per_row.groupBy("severity").agg(*measures)


def task_labels_by_year(rows: DataFrame, tasks: dict[str, dict[str, str]]) -> DataFrame:
    from triagemill.functions.labels import task_label

    entries = F.array(
        *[
            F.struct(F.lit(t).alias("task"), task_label(F.col("severity"), t).alias("target"))
            for t in tasks
        ]
    )
    counts = (
        rows.select(F.year("creation_time").alias("year"), F.explode(entries).alias("e"))
        .groupBy("e.task", "year", "e.target")
        .agg(F.count("*").alias("rows"))
    )
    return counts.withColumn(
        "percentage_within_year",
        F.col("rows") / F.sum("rows").over(Window.partitionBy("task", "year")),
    )


def metadata_profile(rows: DataFrame, requested: list[str], rare_below: int = 5) -> DataFrame:
    """Availability, missing rate, cardinality, top levels and rare-level share per column."""
    present = [c for c in requested if c in rows.columns]
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level"))
            for c in present
        ]
    )
    levels = (
        rows.select(F.explode(entries).alias("e"))
        .groupBy("e.name", "e.level")
        .agg(F.count("*").alias("n"))
    )
    filled = F.col("level").isNotNull()
    stats = levels.groupBy("name").agg(
        (F.sum(F.when(~filled, F.col("n")).otherwise(0)) / F.sum("n")).alias("missingness"),
        F.count_if(filled).alias("cardinality"),
        (
            F.sum(F.when(filled & (F.col("n") < rare_below), F.col("n")).otherwise(0)) / F.sum("n")
        ).alias("rare_category_rate"),
    )
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "level"))
    top = (
        levels.filter(filled)
        .withColumn("r", rank)
        .filter(F.col("r") <= 10)
        .groupBy("name")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("r", "level", "n"))),
                    lambda e: F.concat(e["level"], F.lit("="), e["n"].cast("string")),
                ),
                ",",
            ).alias("top_levels")
        )
    )
    names = rows.sparkSession.createDataFrame([(c, c in present) for c in requested],
                                              "name string, availability boolean")
    return (
        names.join(stats, "name", "left")
        .join(top, "name", "left")
        .select(
            "name",
            "availability",
            F.coalesce("missingness", F.lit(1.0)).alias("missingness"),
            F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
            F.coalesce("rare_category_rate", F.lit(0.0)).alias("rare_category_rate"),
            F.coalesce("top_levels", F.lit("")).alias("top_levels"),
        )
    )


def review_sample(
    rows: DataFrame, strata: list[str], key: str, per_stratum: int, seed: int = 42
) -> DataFrame:
    """The first rows of every stratum in seeded hash order."""
    from triagemill.operators.evaluation import first_rows_per_group

    shuffled = rows.withColumn(
        "_shuffle", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    )
    return first_rows_per_group(shuffled, strata, ["_shuffle", key], per_stratum, [key])
