"""Features, models and routing as registered queries."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from triagemill.constants import HIERARCHIES, LABELS, ORDERED_LABELS, TICKET_LABELS
from triagemill.functions import ordinal as O
from triagemill.functions.labels import label_to_rank, lookup, task_label
from triagemill.operators import decisions as DEC
from triagemill.operators import evaluation as E
from triagemill.operators import features as X
from triagemill.operators import linear as N
from triagemill.operators import models as M
from triagemill.operators import splits as S
from triagemill.operators.positions import with_position
from triagemill.plans.evaluation_queries import (
    METRIC_COLUMNS,
    TICKET_GROUPS,
    metrics_sql,
    round_sql,
)
from triagemill.plans.label_queries import case_map
from triagemill.plans.oracle_views import NWS, VIEWS, W
from triagemill.plans.registry import query, rounded
from triagemill.plans.text_queries import STRUCTURE_SQL, clean_sql
from triagemill.session import materialize, new_table_path
from triagemill.sources import views

KEY = "global_report_key"
FOLDS = [1, 2, 3]


def word_branches():
    return X.variant_branches("summary_description", "word_1_2")


CLEAN = clean_sql("summary || ' ' || chr(10) || ' ' || description")
VIEWS["v_terms"] = f"""
SELECT {KEY}, term, count(*) AS tf FROM (
  SELECT {KEY}, unnest(toks) AS term FROM (SELECT {KEY}, regexp_extract_all(lower({CLEAN}), '{W}{{2,}}') AS toks FROM v_report_docs)
  UNION ALL
  SELECT {KEY}, toks[i] || ' ' || toks[i + 1] FROM (SELECT {KEY}, toks, unnest(range(1, len(toks))) AS i
    FROM (SELECT {KEY}, regexp_extract_all(lower({CLEAN}), '{W}{{2,}}') AS toks FROM v_report_docs)))
GROUP BY ALL"""
VIEWS["v_vocabulary"] = f"""
SELECT fold, term, df, occ, n, ln((n + 1) / (df + 1)) + 1 AS idf FROM (
  SELECT s.*, n, row_number() OVER (PARTITION BY s.fold ORDER BY occ DESC, term) AS rk FROM (
    SELECT fold, term, count(*) AS df, sum(tf) AS occ FROM v_terms t JOIN v_report_folds f USING ({KEY})
    WHERE role = 'train' GROUP BY ALL) s
  JOIN (SELECT fold, count(*) AS n FROM v_report_folds WHERE role = 'train' GROUP BY 1) c ON c.fold = s.fold
  WHERE df >= 2 AND df <= 0.98::DOUBLE * n) WHERE rk <= 50000"""
VIEWS["v_weighted"] = f"""
SELECT fold, role, {KEY}, severity AS label, source_project, term,
  raw / sqrt(sum(raw * raw) OVER (PARTITION BY fold, {KEY})) AS w FROM (
  SELECT f.fold, f.role, t.{KEY}, f.severity, f.source_project, t.term, (1 + ln(tf)) * idf AS raw
  FROM v_terms t JOIN v_report_folds f USING ({KEY}) JOIN v_vocabulary v ON v.fold = f.fold AND v.term = t.term)"""


def members(spark, sf_dir):
    return views.report_folds(spark, sf_dir).select(
        KEY,
        "fold",
        "role",
        F.col("severity").alias("label"),
        "source_project",
        label_to_rank(F.col("severity")).alias("rank"),
    )


def counted(spark, sf_dir):
    return views.remember(
        spark, sf_dir, "counted",
        lambda: X.counted_members(
            views.report_docs(spark, sf_dir), members(spark, sf_dir), KEY, word_branches()
        ),
    )


def vocabulary(spark, sf_dir):
    return views.remember(
        spark, sf_dir, "vocabulary",
        lambda: X.vocabulary_of(counted(spark, sf_dir), word_branches(), FOLDS),
    )


def weighted(spark, sf_dir):
    rows = views.remember(
        spark, sf_dir, "weighted",
        lambda: X.weighted_rows(
            counted(spark, sf_dir), vocabulary(spark, sf_dir), KEY, word_branches(), with_terms=True
        ),
    )
    return X.exploded_weights(rows, KEY)


def unigram_branches():
    return X.variant_branches("summary_description", "word_1_1")


def unigram_table(spark, sf_dir) -> X.FeatureTable:
    """Assembled unigram vectors of the three folds, shared by the iterative models."""
    key = (spark.sparkContext.applicationId, sf_dir, "unigram_table")
    if key not in views._memo:
        views._memo[key] = X.build_features(
            views.report_docs(spark, sf_dir), members(spark, sf_dir), KEY, unigram_branches(),
            FOLDS,
        )
    return views._memo[key]


def vectors(spark, sf_dir):
    """Unigram vectors of the three folds under Spark ML's vector type."""
    return unigram_table(spark, sf_dir).rows


def unigram_scores(spark, sf_dir, candidates: list[N.Candidate]):
    """Out-of-fold scores of ``candidates``, fitted together on unigrams; written once."""
    table = unigram_table(spark, sf_dir)
    bank = N.fit_bank(table.plain, table.size, candidates, KEY)
    return materialize(bank.scores(KEY), "scores")


def logistic(weighting="balanced") -> M.Spec:
    return M.Spec("LogisticRegression", 1.0, weighting)


def scored(predictions, keys, labels=LABELS):
    return rounded(E.metrics(predictions, keys, labels))


# ---- features ----------------------------------------------------------------------------


@query(
    "fea1",
    f"SELECT CAST(fold AS BIGINT) AS fold, role, {KEY}, term, round(w, 6) AS w FROM v_weighted WHERE fold = 3",
)
def fea1(spark, sf_dir):
    return rounded(
        weighted(spark, sf_dir).filter(F.col("fold") == 3).select("fold", "role", KEY, "term", "w")
    )


def variant_sql(variant: str, branch: str, grams: str, min_df: int, max_df: float, cap: int) -> str:
    return f"""
SELECT '{variant}' AS variant, '{branch}' AS branch, term, count(*) AS reports, round(sum(w), 6) AS weight FROM (
  SELECT {KEY}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {KEY})) AS w FROM (
    SELECT {KEY}, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS raw
    FROM ({grams}) JOIN (
      SELECT *, row_number() OVER (ORDER BY occ DESC, term) AS rk FROM (
        SELECT term, count(*) AS df, sum(tf) AS occ, any_value(n) AS n FROM ({grams})
        CROSS JOIN (SELECT count(*) AS n FROM v_report_docs) GROUP BY 1)
      WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * n) v USING (term) WHERE rk <= {cap})) GROUP BY term"""


SUMMARY = clean_sql("summary")
TOK = f"(SELECT {KEY}, regexp_extract_all(lower({SUMMARY}), '{W}{{2,}}') AS toks FROM v_report_docs)"
UNI = f"SELECT {KEY}, unnest(toks) AS term FROM {TOK}"
BI = f"SELECT {KEY}, toks[i] || ' ' || toks[i + 1] AS term FROM (SELECT {KEY}, toks, unnest(range(1, len(toks))) AS i FROM {TOK})"
CHARS = f"""SELECT {KEY}, substr(word, i, n) AS term FROM (SELECT {KEY}, word, n, unnest(range(1, greatest(length(word) - n + 1, 1) + 1)) AS i
  FROM (SELECT {KEY}, ' ' || unnest(regexp_extract_all(lower({SUMMARY}), '{NWS}+')) || ' ' AS word FROM v_report_docs)
  CROSS JOIN (SELECT unnest([3, 4, 5]) AS n) WHERE n = 3 OR length(word) >= n)"""


def tf_sql(body: str) -> str:
    return f"SELECT {KEY}, term, count(*) AS tf FROM ({body}) GROUP BY ALL"


@query(
    "fea2",
    " UNION ALL ".join(
        [
            variant_sql("word_1_1", "word", tf_sql(UNI), 2, 0.98, 35000),
            variant_sql("word_1_2", "word", tf_sql(f"{UNI} UNION ALL {BI}"), 2, 0.98, 50000),
            variant_sql("char_wb", "char", tf_sql(CHARS), 3, 0.995, 40000),
            variant_sql("word_char", "word", tf_sql(UNI), 2, 0.98, 35000),
            variant_sql("word_char", "char", tf_sql(CHARS), 3, 0.995, 30000),
        ]
    ),
)
def fea2(spark, sf_dir):
    """All four feature variants over the summary input, summed per term."""
    docs = views.report_docs(spark, sf_dir)
    everyone = docs.select(KEY).withColumns({"fold": F.lit(1), "role": F.lit("train")})
    parts = []
    for variant in X.FEATURE_VARIANTS:
        branches = X.variant_branches("summary", variant)
        tf = materialize(X.counted_members(docs, everyone, KEY, branches), "variant")
        vocab = materialize(X.vocabulary_of(tf, branches, [1]), "vocabulary")
        parts.append(
            X.exploded_weights(X.weighted_rows(tf, vocab, KEY, branches, with_terms=True), KEY)
            .groupBy("branch", "term")
            .agg(F.count("*").alias("reports"), F.sum("w").alias("weight"))
            .withColumn("variant", F.lit(variant))
        )
    return rounded(M.union_all(parts))


def measured_docs(spark, sf_dir):
    """The modelling view with its structural features, which two feature sets read."""
    return views.remember(
        spark, sf_dir, "measured_docs", lambda: X.with_structure_column(views.report_docs(spark, sf_dir))
    )


@query("fea3")
def fea3(spark, sf_dir):
    """Feature sets F0 to F4 on all folds: rows per side and width."""
    docs = measured_docs(spark, sf_dir)
    m = members(spark, sf_dir)
    parts = []
    sets = X.FeatureSets(docs, m, KEY, FOLDS, X.FEATURE_SETS)
    for name in X.FEATURE_SETS:
        table = sets.table(name)
        parts.append(
            table.rows.groupBy("fold", "role")
            .agg(F.count("*").alias("rows"))
            .select(
                F.lit(name).alias("feature_set"),
                "fold",
                "role",
                "rows",
                F.lit(table.size).cast("bigint").alias("width"),
            )
        )
    return M.union_all(parts)


STRUCT = {k: v for k, v in STRUCTURE_SQL.items()}


@query(
    "fea4",
    f"""WITH s AS (SELECT {KEY}, pos, n_rows, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in STRUCT.items())} FROM v_report_docs),
m AS (SELECT {', '.join(f'max(abs({k})) AS {k}' for k in STRUCT)} FROM s JOIN v_report_folds f ON f.{KEY} = s.{KEY} AND fold = 3 AND role = 'train')
SELECT s.{KEY}, {', '.join(f'round(CASE WHEN m.{k} = 0 THEN s.{k} ELSE s.{k} / m.{k} END, 6) AS {k}' for k in STRUCT)}
FROM s JOIN v_report_folds f ON f.{KEY} = s.{KEY} AND fold = 3 CROSS JOIN m""",
)
def fea4(spark, sf_dir):
    fold = members(spark, sf_dir).filter(F.col("fold") == 3)
    scaled = X.scaled_structure(views.report_docs(spark, sf_dir), fold, KEY)
    return rounded(scaled.drop("fold", "has_repeated_character"))


@query(
    "fea5",
    f"""SELECT CAST(fold AS BIGINT) AS fold, count(DISTINCT term) AS estimated_max_vocabulary_features, count(*) AS nonzero_entries,
  count(DISTINCT {KEY}) AS development_rows, count(*) * 12 + (count(DISTINCT {KEY}) + 1) * 4 AS sparse_matrix_bytes
FROM v_weighted WHERE role = 'train' GROUP BY fold""",
)
def fea5(spark, sf_dir):
    train = word_vectors(spark, sf_dir).plain.filter(F.col("role") == "train")
    return rounded(X.vector_dimensions(train))


# ---- closed-form models ------------------------------------------------------------------


@query(
    "mod1",
    """SELECT id, severity AS true_label, (SELECT arg_min(severity, (-n, severity)) FROM (SELECT severity, count(*) AS n FROM v_split
  WHERE partition = 'development' GROUP BY 1)) AS predicted_label FROM v_split WHERE partition = 'test'""",
)
def mod1(spark, sf_dir):
    split = views.positioned_tickets(spark, sf_dir)
    model = M.majority_class(split.filter(F.col("partition") == "development"), "severity")
    return (
        split.filter(F.col("partition") == "test")
        .select("id", F.col("severity").alias("true_label"))
        .crossJoin(F.broadcast(model))
    )


ALPHA = 0.5


def nb_views(keys: str = "fold") -> str:
    sums = ", ".join(f"coalesce(sum(w) FILTER (WHERE label = '{x}'), 0) AS s{i}" for i, x in enumerate(LABELS))
    n = range(len(LABELS))
    return f"""nb_s AS (SELECT fold, term, {sums} FROM v_weighted WHERE role = 'train' GROUP BY ALL),
nb_t AS (SELECT fold, count(*) AS v, {', '.join(f'sum(s{i}) AS t{i}' for i in n)} FROM nb_s GROUP BY 1),
nb_l AS (SELECT nb_s.fold, term, {', '.join(f'ln((s{i} + {ALPHA}) / (t{i} + {ALPHA} * v)) AS ll{i}' for i in n)} FROM nb_s JOIN nb_t ON nb_s.fold = nb_t.fold),
nb_p AS (SELECT fold, {', '.join(f"CASE WHEN count(*) FILTER (WHERE severity = '{x}') = 0 THEN '-infinity'::DOUBLE ELSE ln(count(*) FILTER (WHERE severity = '{x}') / count(*)) END AS p{i}" for i, x in enumerate(LABELS))}
  FROM v_report_folds WHERE role = 'train' GROUP BY 1),
nb_sc AS (SELECT w.fold, w.{KEY}, {', '.join(f'sum(w.w * ll{i}) AS sc{i}' for i in n)} FROM v_weighted w JOIN nb_l ON nb_l.fold = w.fold AND nb_l.term = w.term
  WHERE w.role = 'validation' GROUP BY 1, 2),
nb_f AS (SELECT f.fold, f.{KEY}, f.severity AS true_label, {', '.join(f'round(p{i} + coalesce(sc{i}, 0), 9) AS x{i}' for i in n)}
  FROM v_report_folds f JOIN nb_p ON nb_p.fold = f.fold LEFT JOIN nb_sc ON nb_sc.fold = f.fold AND nb_sc.{KEY} = f.{KEY} WHERE f.role = 'validation'),
nb AS (SELECT fold, {KEY}, true_label, CASE greatest({', '.join(f'x{i}' for i in n)}) {' '.join(f"WHEN x{i} THEN '{x}'" for i, x in enumerate(LABELS))} END AS predicted_label FROM nb_f)"""


def naive_bayes(spark, sf_dir, alpha: float = ALPHA):
    table = word_vectors(spark, sf_dir)
    likelihood, priors = M.vector_bayes_tables(table.plain, table.size, LABELS, alpha)
    return M.vector_bayes_predict(table.plain, table.size, likelihood, priors, LABELS, KEY)


@query(
    "mod2",
    f"WITH {nb_views()} SELECT CAST(fold AS BIGINT) AS fold, {KEY}, true_label, predicted_label FROM nb",
)
def mod2(spark, sf_dir):
    return rounded(naive_bayes(spark, sf_dir))


FLAT_TARGET = tuple((x, x) for x in LABELS)


def word_vectors(spark, sf_dir):
    """Assembled unigram and bigram vectors of the three folds, shared by the flat models."""
    key = (spark.sparkContext.applicationId, sf_dir, "word_table")
    if key not in views._memo:
        views._memo[key] = X.build_features(
            views.report_docs(spark, sf_dir), members(spark, sf_dir), KEY, word_branches(), FOLDS
        )
    return views._memo[key]


FLAT_MODELS = {
    "mod3": N.Candidate("LogisticRegression|C=1.0|weight=balanced", "LogisticRegression", 1.0, "balanced", FLAT_TARGET),
    "mod4": N.Candidate("LinearSVC|C=0.5|weight=balanced", "LinearSVC", 0.5, "balanced", FLAT_TARGET),
}


def flat_bank(spark, sf_dir) -> N.Bank:
    """Both flat models of every fold, fitted together."""
    key = (spark.sparkContext.applicationId, sf_dir, "flat_bank")
    if key not in views._memo:
        table = word_vectors(spark, sf_dir)
        views._memo[key] = N.fit_bank(table.plain, table.size, list(FLAT_MODELS.values()), KEY)
    return views._memo[key]


def _flat_predictions(spark, sf_dir, name):
    predicted = flat_bank(spark, sf_dir).predict(KEY)
    return predicted.filter(F.col("candidate") == FLAT_MODELS[name].name).drop("candidate")


@query("mod3")
def mod3(spark, sf_dir):
    """Balanced multinomial logistic regression on words and pairs of words, out of fold."""
    return rounded(_flat_predictions(spark, sf_dir, "mod3"))


@query("mod4")
def mod4(spark, sf_dir):
    """One-vs-rest support vector machines with squared hinge loss, out of fold."""
    return rounded(_flat_predictions(spark, sf_dir, "mod4"))


@query("mod19_linear")
def mod19_linear(spark, sf_dir):
    """Thirty largest coefficients of every class of both flat models, in every fold."""
    bank = flat_bank(spark, sf_dir)
    name_of = {c.name: m for m, c in FLAT_MODELS.items()}
    found = bank.influential(word_vectors(spark, sf_dir).vocabulary)
    return rounded(found.withColumn("model", lookup(F.col("candidate"), name_of)).drop("candidate"))


@query(
    "mod_optima",
    f"""SELECT model, CAST(fold AS BIGINT) AS fold, count(*) FILTER (role = 'train') AS train_rows,
  count(*) FILTER (role = 'validation') AS scored_rows, count(DISTINCT severity) FILTER (role = 'train') AS classes,
  true AS converged FROM v_report_folds CROSS JOIN (SELECT unnest(['mod3', 'mod4']) AS model) GROUP BY ALL""",
)
def mod_optima(spark, sf_dir):
    """Rows and classes of both flat models, and whether the gradient over all rows is zero."""
    bank = flat_bank(spark, sf_dir)
    name_of = {c.name: m for m, c in FLAT_MODELS.items()}
    facts = spark.createDataFrame(
        [
            (name_of[model.candidate.name], f, len(model.classes), bank.fits[f, i].converged)
            for f, own in bank.models.items()
            for i, model in enumerate(own)
        ],
        "model string, fold long, classes long, converged boolean",
    )
    train = (
        bank.blocks.filter("role = 'train'")
        .groupBy(F.col("fold").cast("long").alias("fold"))
        .agg(F.sum(F.size("labels")).alias("train_rows"))
    )
    scored_rows = (
        bank.predict(KEY)
        .groupBy(lookup(F.col("candidate"), name_of).alias("model"), F.col("fold").cast("long").alias("fold"))
        .agg(F.count("*").alias("scored_rows"))
    )
    return facts.join(train, "fold").join(scored_rows, ["model", "fold"])


@query("mod5")
def mod5(spark, sf_dir):
    """Ridge on ranks over the folds, decoded to labels with the clip count kept."""
    ranks = {x: i for i, x in enumerate(ORDERED_LABELS)}
    ridge = N.Candidate("Ridge", "Ridge", 1.0, None, tuple((x, str(i)) for x, i in ranks.items()))
    out = unigram_scores(spark, sf_dir, [ridge]).select(
        KEY, "fold", lookup(F.col("label"), ranks).alias("rank"), F.col("scores")[0][0].alias("prediction")
    )
    p = F.col("prediction")
    return rounded(
        out.select(
            KEY,
            "fold",
            F.col("rank").cast("int").alias("true_rank"),
            p.alias("continuous_rank"),
            O.clip_rank(p, len(ORDERED_LABELS)).alias("predicted_rank"),
            O.was_clipped(p, len(ORDERED_LABELS)).alias("was_clipped"),
        )
    )


@query(
    "mod6",
    """WITH c AS (SELECT CAST(fold AS BIGINT) AS fold, severity AS label, count(*) AS n FROM v_folds WHERE role = 'train' GROUP BY 1, 2),
b AS (SELECT *, sum(n) OVER (PARTITION BY fold) / (count(*) OVER (PARTITION BY fold) * n) AS balanced FROM c)
SELECT 'labels' AS node, fold, label, n, round(balanced, 6) AS balanced, round(sqrt(balanced), 6) AS sqrt_inverse_frequency, round(least(balanced, 3), 6) AS capped_balanced_3 FROM b
UNION ALL SELECT node, fold, label, n, round(x, 6), round(sqrt(x), 6), round(least(x, 3), 6) FROM (
  SELECT *, sum(n) OVER (PARTITION BY node, fold) / (2 * n) AS x FROM (
    SELECT 'gt_' || t AS node, CAST(fold AS BIGINT) AS fold, CAST((rank > t)::INTEGER AS VARCHAR) AS label, count(*) AS n
    FROM v_folds CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS t) WHERE role = 'train' GROUP BY ALL))""",
)
def mod6(spark, sf_dir):
    train = views.ticket_folds(spark, sf_dir).filter(F.col("role") == "train")
    flat = M.class_weights(train, "severity", ["fold"]).withColumn("node", F.lit("labels"))
    binary = train.select(
        "fold", "rank", F.explode(F.array(*[F.lit(t) for t in range(4)])).alias("t")
    ).select(
        F.concat(F.lit("gt_"), F.col("t").cast("string")).alias("node"),
        "fold",
        (F.col("rank") > F.col("t")).cast("int").cast("string").alias("target"),
    )
    return rounded(
        flat.unionByName(M.class_weights(binary, "target", ["node", "fold"]))
    )


@query("mod7")
def mod7(spark, sf_dir):
    """Grid search of naive Bayes: smoothing x n-gram range over the folds."""
    m = members(spark, sf_dir)
    docs = views.report_docs(spark, sf_dir)
    parts = []
    grid = M.candidate_grid({"alpha": [0.1, 0.5, 1.0], "ngrams": [(1, 1), (1, 2)]})
    tables = {}
    for low, high in sorted({c["ngrams"] for c in grid}):
        branches = X.variant_branches("summary_description", f"word_{low}_{high}")
        tables[(low, high)] = X.build_features(docs, m, KEY, branches, FOLDS)
    for position, c in enumerate(grid):
        table = tables[c["ngrams"]]
        likelihood, priors = M.vector_bayes_tables(table.plain, table.size, LABELS, c["alpha"])
        predicted = M.vector_bayes_predict(table.plain, table.size, likelihood, priors, LABELS, KEY)
        parts.append(
            E.metrics(predicted, ["fold"], LABELS).select(
                F.lit(f"alpha={c['alpha']}|ngrams={c['ngrams']}").alias("candidate"),
                F.lit(position).alias("position"),
                "macro_f1",
            )
        )
    return rounded(M.first_best(M.union_all(parts)))


@query(
    "mod8",
    f"""WITH {nb_views()}, maj AS (SELECT f.fold, {KEY}, f.severity AS true_label, predicted_label FROM v_report_folds f JOIN (
  SELECT fold, arg_min(severity, (-n, severity)) AS predicted_label FROM (SELECT fold, severity, count(*) AS n FROM v_report_folds
  WHERE role = 'train' GROUP BY ALL) GROUP BY 1) m ON m.fold = f.fold WHERE role = 'validation'),
allp AS (SELECT 'MultinomialNB' AS model, fold, true_label, predicted_label FROM nb
  UNION ALL SELECT 'DummyClassifier', fold, true_label, predicted_label FROM maj)
SELECT model, CAST(fold AS BIGINT) AS fold, rows, {round_sql(METRIC_COLUMNS)} FROM ({metrics_sql('allp', 'model, fold', LABELS)})""",
)
def mod8(spark, sf_dir):
    """Fold evaluation of the two closed-form models, end to end from texts."""
    m = members(spark, sf_dir)
    majority = M.majority_class(m.filter(F.col("role") == "train"), "label", ["fold"])
    dummy = (
        m.filter(F.col("role") == "validation")
        .join(F.broadcast(majority), "fold")
        .select(KEY, "fold", F.col("label").alias("true_label"), "predicted_label")
    )
    both = dummy.withColumn("model", F.lit("DummyClassifier")).unionByName(
        naive_bayes(spark, sf_dir).withColumn("model", F.lit("MultinomialNB"))
    )
    return scored(both, ["model", "fold"])


def _flat(spark, sf_dir, branches, specs, fold_members, folds):
    """Metrics of every (tag, spec) of ``specs`` over one table of features."""
    table = X.build_features(views.report_docs(spark, sf_dir), fold_members, KEY, branches, folds)
    candidates = [N.Candidate(tag, s.family, s.c, s.weighting, FLAT_TARGET) for tag, s in specs]
    bank = N.fit_bank(table.plain, table.size, candidates, KEY, lean=True)
    return E.metrics(bank.predict(KEY), ["candidate", "fold"], LABELS).select(
        "candidate", F.col("fold").cast("int").alias("fold"), *STUDY_COLUMNS,
        F.lit(table.size).cast("bigint").alias("feature_count"),
    )


FRACTIONS = (0.2, 0.4, 0.6, 0.8, 1.0)
STUDY_COLUMNS = ["macro_f1", "balanced_accuracy", "minimum_recall"]


def bank_results(spark, bank: N.Bank, labels, size: int, stage: str):
    """Metrics of every candidate and fold, with the gradient of its fit and its measured seconds.

    ``runtime_seconds``: time that tasks took for the candidate's steps and scores in that fold.
    """
    facts = spark.createDataFrame(
        [(c, f, g, t) for c, f, g, _, t, _ in bank.facts()],
        "candidate string, fold int, gradient_norm double, runtime_seconds double",
    )
    return (
        E.metrics(bank.predict(KEY), ["candidate", "fold"], labels)
        .join(F.broadcast(facts), ["candidate", "fold"])
        .select(
            F.lit(stage).alias("stage"), "candidate", "fold", *STUDY_COLUMNS, "gradient_norm",
            "runtime_seconds", F.lit(size).cast("long").alias("feature_count"),
        )
    )


def best_candidate(results):
    """Name of the candidate with the best mean macro-F1, ties by the smaller deviation and name."""
    means = results.groupBy("candidate").agg(
        F.round(F.avg("macro_f1"), 9).alias("m"), F.round(F.stddev_pop("macro_f1"), 9).alias("s")
    )
    return means.orderBy(F.desc("m"), "s", "candidate").first()["candidate"]


def vector_naive_bayes(table: X.FeatureTable, alpha: float = 1.0):
    """Out-of-fold multinomial naive Bayes on assembled vectors."""
    entries = table.plain.select(
        "fold", "role", KEY, "label", F.explode(F.arrays_zip("features.indices", "features.values")).alias("e")
    ).select("fold", "role", KEY, "label", F.lit("").alias("branch"), F.col("e.indices").alias("term"), F.col("e.values").alias("w"))
    rows = table.plain.select("fold", "role", KEY, "label")
    likelihood, priors = M.naive_bayes_tables(entries, rows, LABELS, alpha, ["fold"])
    return M.naive_bayes_predict(entries, rows, likelihood, priors, LABELS, KEY, ["fold"])


def study_weights(rows) -> dict[str, object]:
    """The four weightings; the derived ones are fixed on all development rows."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    derived = {x: tuple(sorted(N.weights_of(counts, x).items())) for x in ("sqrt_inverse_frequency", "capped_balanced_3")}
    return {"none": None, "balanced": "balanced"} | derived


@query("mod9")
def mod9(spark, sf_dir):
    """Ablation in sequence: inputs and features, then weights, then models, each on the winner of the
    stage before; and the chronological learning curve."""
    m = members(spark, sf_dir)
    docs = views.report_docs(spark, sf_dir)
    base = ("LogisticRegression", 1.0, "balanced", FLAT_TARGET)
    pairs = [(i, f) for i in X.INPUT_VARIANTS for f in X.FEATURE_VARIANTS]

    def ablated(pair):
        def run():
            table = X.build_features(docs, m, KEY, X.variant_branches(*pair), FOLDS)
            bank = N.fit_bank(table.plain, table.size, [N.Candidate("|".join(pair), *base)], KEY, lean=True)
            found = bank_results(spark, bank, LABELS, table.size, "features")
            return table, materialize(found, "ablation")

        return run

    done = dict(zip(pairs, M.in_parallel([ablated(p) for p in pairs], 4)))
    parts = [results for _, results in done.values()]
    best = tuple(best_candidate(M.union_all(parts)).split("|"))
    table = done[best][0]
    weights = study_weights(docs.select(F.col("severity").alias("label")))
    grid = [
        N.Candidate(f"{family}|{w}", family, 1.0, weights[w], FLAT_TARGET)
        for family in ("LogisticRegression", "LinearSVC")
        for w in weights
    ]
    bank = N.fit_bank(table.plain, table.size, grid, KEY, lean=True)
    weighted_results = materialize(bank_results(spark, bank, LABELS, table.size, "weights"), "weights")
    parts.append(weighted_results)
    chosen = best_candidate(weighted_results).split("|")[1]
    linear = weighted_results.filter(F.col("candidate").endswith(f"|{chosen}"))
    majority = M.majority_class(m.filter(F.col("role") == "train"), "label", ["fold"])
    dummy = (
        m.filter(F.col("role") == "validation")
        .join(F.broadcast(majority), "fold")
        .select(KEY, "fold", F.col("label").alias("true_label"), "predicted_label")
    )
    closed = dummy.withColumn("candidate", F.lit("DummyClassifier|n/a")).unionByName(
        vector_naive_bayes(table).withColumn("candidate", F.lit("MultinomialNB|n/a"))
    )
    closed = E.metrics(closed, ["candidate", "fold"], LABELS).select(
        F.lit("models").alias("stage"), "candidate", F.col("fold").cast("int").alias("fold"), *STUDY_COLUMNS,
        F.lit(None).cast("double").alias("gradient_norm"), F.lit(None).cast("double").alias("runtime_seconds"),
        F.lit(table.size).cast("long").alias("feature_count"),
    )
    models = closed.unionByName(linear.withColumn("stage", F.lit("models")))
    parts.append(models)
    # all prefixes of the learning curve are folds of one table of features
    positioned = with_position(docs.drop("summary", "description"), ["creation_time", KEY])
    curves = []
    for no, fraction in enumerate(FRACTIONS):
        subset = S.learning_subsets(positioned, (fraction,)).drop("n_rows")
        folds = S.expanding_folds(subset.withColumn("n_rows", F.lit(subset.count())), 3)
        curves.append(
            folds.select(KEY, (F.col("fold") + 10 * no).alias("fold"), "role", F.col("severity").alias("label"))
        )
    curve = materialize(M.union_all(curves), "curve")
    numbers = [10 * no + f for no in range(len(FRACTIONS)) for f in FOLDS]
    table = X.build_features(docs, curve, KEY, word_branches(), numbers)
    bank = N.fit_bank(table.plain, table.size, [N.Candidate("curve", *base)], KEY, lean=True)
    grown = bank_results(spark, bank, LABELS, table.size, "curve")
    fraction_of = F.element_at(F.array(*[F.lit(x) for x in FRACTIONS]), (F.col("fold") / 10).cast("int") + 1)
    parts.append(
        grown.withColumn("candidate", F.concat(F.lit("fraction="), fraction_of.cast("string"))).withColumn(
            "fold", (F.col("fold") % 10).cast("int")
        )
    )
    return rounded(M.union_all(parts))


STUDY_TASKS = ["s6", "s3", "s2"]


TASK_LABELS = {"s6": LABELS, "s3": ["HIGH", "MEDIUM", "LOW"], "s2": ["HIGH_IMPACT", "LOWER_IMPACT"]}
OUTER, INNER = 100, 1  # of a fold's number: outer fold times OUTER, plus inner fold


def task_targets(spark, tasks) -> dict[str, tuple[tuple[str, str], ...]]:
    """Row label to label of every task."""
    rows = spark.createDataFrame([(x,) for x in LABELS], "label string")
    mapped = rows.select("label", *[task_label(F.col("label"), t).alias(t) for t in tasks]).collect()
    return {t: tuple(sorted((r["label"], r[t]) for r in mapped if r[t] is not None)) for t in tasks}


def nested_members(spark, sf_dir):
    """Inner folds of every outer training side, and the outer folds, as folds of one plan."""
    parts = []
    for fold in FOLDS:
        outer = views.report_folds(spark, sf_dir).filter(F.col("fold") == fold)
        inner = nested_inner_folds(outer, "severity", LABELS)
        parts.append(inner.withColumn("fold", F.col("fold") * INNER + F.lit(OUTER * fold)))
        parts.append(
            outer.select(KEY, F.lit(OUTER * fold).alias("fold"), "role", F.col("severity").alias("label"))
        )
    plan = M.union_all([p.withColumn("fold", F.col("fold").cast("int")) for p in parts])
    return materialize(plan, "nested")


def study_candidates(feature: str, targets, specs) -> list[N.Candidate]:
    return [
        N.Candidate(f"{task}|{feature}|{s.name}", s.family, s.c, s.weighting, target)
        for task, target in targets.items()
        for s in specs
    ]


def nested_study(spark, docs, plan, tasks, feature_sets, specs):
    """(inner results by candidate, winners' outer results).

    The features of a set are made once for all inner and outer folds, and all candidates of all
    tasks are fitted on them together. The winner of a task and outer fold by the eight-key rule
    over its inner folds is refitted on the outer training side.
    """
    targets = task_targets(spark, tasks)
    numbers = sorted(r["fold"] for r in plan.select("fold").distinct().collect())
    is_inner = F.col("fold") % OUTER > 0

    def metrics_of(predicted):
        own = []
        for task in tasks:
            mine = predicted.filter(F.col("candidate").startswith(f"{task}|"))
            keys, labels = ["candidate", "fold"], TASK_LABELS[task]
            recall = E.class_metrics(mine, keys, labels).filter(F.col("label") == labels[0])
            own.append(
                E.metrics(mine, keys, labels)
                .join(recall.select(*keys, F.col("recall").alias("priority")), keys)
                .withColumn("task", F.lit(task))
            )
        return M.union_all(own)

    sets = X.FeatureSets(docs, plan, KEY, numbers, feature_sets)

    def one(name):
        def run():
            began = time.perf_counter()
            table = sets.table(name)
            candidates = study_candidates(name, targets, specs)
            # what the features took belongs to all their candidates
            shared = (time.perf_counter() - began) / (len(candidates) * len(numbers))
            bank = N.fit_bank(table.plain.filter(is_inner), table.size, candidates, KEY, lean=True)
            facts = spark.createDataFrame(
                [(c, f, g, t + shared) for c, f, g, _, t, _ in bank.facts()],
                "candidate string, fold int, gradient_norm double, runtime_seconds double",
            )
            found = (
                metrics_of(bank.predict(KEY))
                .join(F.broadcast(facts), ["candidate", "fold"])
                .withColumn("feature", F.lit(name))
                .withColumn("feature_count", F.lit(table.size))
            )
            return table, materialize(found, "candidates")

        return run

    done = dict(zip(feature_sets, M.in_parallel([one(f) for f in feature_sets], 4)))
    results = M.union_all([found for _, found in done.values()]).withColumn(
        "outer_fold", F.floor(F.col("fold") / OUTER).cast("int")
    )
    ranked = M.rank_candidates(results, "priority", X.FEATURE_SETS, ["task", "outer_fold"])
    # one row for each task and outer fold
    winners = materialize(ranked.filter(F.col("candidate_rank") == 1), "winners")
    chosen = winners.collect()
    parts = []
    for name in sorted({r["feature"] for r in chosen}):
        table, own = done[name][0], {}
        by_name = {c.name: c for c in study_candidates(name, targets, specs)}
        for r in chosen:
            if r["feature"] == name:
                own.setdefault(OUTER * r["outer_fold"], []).append(by_name[r["candidate"]])
        bank = N.fit_bank(
            table.plain.filter(F.col("fold").isin(list(own))), table.size, own, KEY, lean=True
        )
        facts = spark.createDataFrame(
            [(c, f, g) for c, f, g, *_ in bank.facts()], "candidate string, fold int, gradient_norm double"
        )
        parts.append(metrics_of(bank.predict(KEY)).join(F.broadcast(facts), ["candidate", "fold"]))
    refitted = M.union_all(parts).withColumn("outer_fold", F.floor(F.col("fold") / OUTER).cast("int"))
    return results, refitted.drop("fold").join(
        F.broadcast(winners.select("task", "outer_fold", "candidate", "mean_macro_f1", "runtime")),
        ["task", "outer_fold", "candidate"],
    )


@query("mod10")
def mod10(spark, sf_dir):
    """Nested selection inside every outer fold: candidates on inner folds, winner refitted."""
    docs, plan = measured_docs(spark, sf_dir), nested_members(spark, sf_dir)
    _, refitted = nested_study(spark, docs, plan, STUDY_TASKS, X.FEATURE_SETS, M.study_specs())
    return rounded(
        refitted.select(
            "task", F.col("outer_fold").cast("long").alias("fold"), "candidate",
            F.col("mean_macro_f1").alias("inner_macro_f1"), *METRIC_COLUMNS, "rows", "gradient_norm",
            F.col("runtime").alias("runtime_seconds"),
        )
    )


@query("mod10_identity")
def mod10_identity(spark, sf_dir):
    """Rows and row-set hashes of every inner fold."""
    plan = nested_members(spark, sf_dir).filter(F.col("fold") % OUTER > 0)
    # a sum of hashes names a set of rows in any order, and is made before rows move
    hashed = F.sum(F.xxhash64(KEY).cast("decimal(38,0)")).cast("string")
    return plan.groupBy(
        F.floor(F.col("fold") / OUTER).cast("long").alias("outer_fold"),
        (F.col("fold") % OUTER).cast("long").alias("inner_fold"), "role",
    ).agg(F.count("*").alias("rows"), hashed.alias("row_set"))


def nested_inner_folds(outer, label, labels):
    """Inner folds of one outer training side, with positions renumbered by its size."""
    train = outer.filter(F.col("role") == "train").drop("fold", "role", "n_rows")
    base = train.withColumn("n_rows", F.lit(train.count()))
    return materialize(
        S.inner_folds(base, label, labels, "duplicate_group").select(
            KEY, "fold", "role", F.col(label).alias("label")
        ),
        "inner",
    )


FEATURE_OF = {"component_majority": "F0", "previous_ticket": "F2", "project_majority": "F1"}


@query(
    "mod11",
    f"""WITH m AS ({metrics_sql('v_predictions', 'model, project, fold', TICKET_LABELS)}),
r AS (SELECT m.*, coalesce(p.hit, 0) AS priority FROM m LEFT JOIN (SELECT model, project, fold,
  avg((predicted_label = '1-URGENT')::INTEGER) AS hit FROM v_predictions WHERE true_label = '1-URGENT' GROUP BY ALL) p
  ON p.model = m.model AND p.project = m.project AND p.fold = m.fold),
a AS (SELECT project, model AS candidate, {case_map('model', FEATURE_OF)} AS feature, avg(macro_f1) AS mean_macro_f1, stddev_pop(macro_f1) AS std_macro_f1,
  avg(minimum_recall) AS mean_minimum_recall, avg(priority) AS priority_recall, avg(length(model)) AS mean_features, 0.0::DOUBLE AS runtime FROM r GROUP BY 1, 2)
SELECT project, candidate, feature, {round_sql(['mean_macro_f1', 'std_macro_f1', 'mean_minimum_recall', 'priority_recall', 'mean_features', 'runtime'])},
  row_number() OVER (PARTITION BY project ORDER BY round(mean_macro_f1, 9) DESC, round(mean_minimum_recall, 9) DESC, round(priority_recall, 9) DESC,
    round(std_macro_f1, 9), feature, mean_features, candidate) AS candidate_rank FROM a""",
)
def mod11(spark, sf_dir):
    """Rank the rule models of every project over its folds."""
    df = views.predictions(spark, sf_dir)
    keys = ["model", "project", "fold"]
    urgent = E.class_metrics(df, keys, TICKET_LABELS).filter(F.col("label") == "1-URGENT")
    results = (
        E.metrics(df, keys, TICKET_LABELS)
        .join(urgent.select(*keys, F.col("recall").alias("priority")), keys)
        .select(
            "project",
            F.col("model").alias("candidate"),
            lookup(F.col("model"), FEATURE_OF).alias("feature"),
            "fold",
            "macro_f1",
            "minimum_recall",
            "priority",
            F.length("model").alias("feature_count"),
            F.lit(0.0).alias("runtime_seconds"),
        )
    )
    return rounded(M.rank_candidates(results, "priority", X.FEATURE_SETS, ["project"]))


@query("mod12")
def mod12(spark, sf_dir):
    """Both two-level hierarchies: hard, soft and oracle routing, out of fold."""
    nodes = {name: M.hierarchy_nodes(name, logistic()) for name in HIERARCHIES}
    # the nodes of both hierarchies are fitted together
    scores = unigram_scores(spark, sf_dir, [node for own in nodes.values() for node in own])
    parts, first = [], 0
    for name, own in nodes.items():
        found = M.evaluate_hierarchy(scores, name, KEY, first)
        parts.append(found.withColumn("hierarchy", F.lit(name)))
        first += len(own)
    return rounded(M.union_all(parts))


ROUTE_GROUPS = {"SEVERE": ["2-HIGH", "1-URGENT"], "NON_SEVERE": ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM"]}
GROUP_CASE = case_map("severity", TICKET_GROUPS)


@query(
    "mod13",
    f"""WITH d AS (SELECT *, {GROUP_CASE} AS grp FROM v_split),
g AS (SELECT component, grp, count(*) / sum(count(*)) OVER (PARTITION BY component) AS gs FROM d WHERE partition = 'development' GROUP BY 1, 2),
c AS (SELECT project, grp, severity AS label, count(*) / sum(count(*)) OVER (PARTITION BY project, grp) AS cs FROM d WHERE partition = 'development' GROUP BY 1, 2, 3),
t AS (SELECT id, component, project, grp AS true_grp FROM d WHERE partition = 'test'),
l1 AS (SELECT component, arg_min(grp, (-round(gs, 12), grp)) AS grp FROM g GROUP BY 1),
ch AS (SELECT project, grp, arg_min(label, (-round(cs, 12), label)) AS label FROM c GROUP BY 1, 2),
s AS (SELECT t.id, arg_min(c.label, (-round(gs * cs, 12), {case_map('c.label', {x: i for i, x in enumerate(TICKET_LABELS)})})) AS label
  FROM t JOIN g ON g.component = t.component JOIN c ON c.project = t.project AND c.grp = g.grp GROUP BY 1)
SELECT t.id, h.label AS hard, s.label AS soft, o.label AS oracle FROM t JOIN l1 ON l1.component = t.component
JOIN ch h ON h.project = t.project AND h.grp = l1.grp JOIN ch o ON o.project = t.project AND o.grp = t.true_grp JOIN s ON s.id = t.id""",
)
def mod13(spark, sf_dir):
    """Routing over frequency tables: groups by component, labels by project and group."""
    split = views.positioned_tickets(spark, sf_dir).withColumn(
        "grp", lookup(F.col("severity"), TICKET_GROUPS)
    )
    dev, test = split.filter(F.col("partition") == "development"), split.filter(
        F.col("partition") == "test"
    )

    def shares(by, value, name):
        n = dev.groupBy(*by, value).agg(F.count("*").alias("_n"))
        total = n.groupBy(*by).agg(F.sum("_n").alias("_all"))
        return n.join(total, by).select(*by, value, (F.col("_n") / F.col("_all")).alias(name))

    groups = shares(["component"], "grp", "group_score")
    labels = shares(["project", "grp"], "severity", "child_score").withColumnRenamed(
        "severity", "label"
    )

    def winner(df, by, value, score):
        return df.groupBy(*by).agg(
            F.min_by(value, F.struct(-F.round(score, 12), F.col(value))).alias(value)
        )

    level1 = winner(groups, ["component"], "grp", "group_score")
    child = winner(labels, ["project", "grp"], "label", "child_score").withColumnRenamed(
        "label", "predicted_label"
    )
    ids = test.select("id", "component", "project", F.col("grp").alias("true_grp"))
    # no broadcast hints: the planner broadcasts these tables when their size allows it
    children = ids.select("id", "project").join(child, "project").select(
        "id", "grp", "predicted_label"
    )
    hard = M.hard_route(
        ids.join(level1, "component").select("id", "grp"), children, ["id"]
    )
    oracle = M.hard_route(
        ids.select("id", F.col("true_grp").alias("grp")), children, ["id"]
    )
    soft = M.soft_route(
        ids.join(groups, "component").select("id", "grp", "group_score"),
        ids.select("id", "project").join(labels, "project").select(
            "id", "grp", "label", "child_score"
        ),
        ["id"],
        TICKET_LABELS,
    )
    p = F.col("predicted_label")
    return (
        hard.select("id", p.alias("hard"))
        .join(soft.select("id", p.alias("soft")), "id")
        .join(oracle.select("id", p.alias("oracle")), "id")
    )


@query("mod14")
def mod14(spark, sf_dir):
    """Cumulative ordinal model: raw, projected and decoded, out of fold."""
    k = len(ORDERED_LABELS)
    models = M.threshold_models(ORDERED_LABELS, logistic())
    raw = M.evaluate_ordinal(unigram_scores(spark, sf_dir, models), ORDERED_LABELS, KEY)
    fitted = raw.withColumn("m", O.project_monotonic(F.col("q"), k - 1))
    decoded = fitted.withColumn("p", O.class_probabilities(F.col("m")))
    return rounded(
        decoded.select(
            KEY,
            "fold",
            "true_rank",
            O.decode_hard(F.col("q")).alias("hard"),
            O.decode_argmax(F.col("p")).alias("argmax"),
            O.clip_rank(O.expected_rank(F.col("p")), k).alias("expected"),
        )
    )


def unit_embeddings(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x * x))
    return (
        e.select("vec_id", "label", values.alias("_v"))
        .withColumn("_norm", F.greatest(norm, F.lit(1e-12)))
        .select(
            "vec_id",
            "label",
            F.transform("_v", lambda x: x / F.col("_norm")).alias("unit"),
        )
    )


@query("mod18")
def mod18(spark, sf_dir):
    """Stored unit vectors, three expanding folds by id, logistic regression and SVC."""
    from pyspark.ml.functions import array_to_vector

    rows = unit_embeddings(spark, sf_dir).select(
        "vec_id", F.col("label").cast("string").alias("label"),
        array_to_vector("unit").alias("features"),
    )
    positioned = with_position(rows.select("vec_id"), ["vec_id"])
    folds = S.expanding_folds(positioned, 3, group=None).select("vec_id", "fold", "role")
    table = materialize(folds.join(rows, "vec_id"), "unit-vectors")
    parts = [
        M.evaluate_folds(table, FOLDS, M.Spec(family, 1.0, "balanced", 1e-5), "vec_id").withColumn(
            "classifier", F.lit(family)
        )
        for family in ("LogisticRegression", "LinearSVC")
    ]
    names = [str(i) for i in range(10)]
    return scored(M.union_all(parts), ["classifier", "fold"], names)


@query(
    "mod18_norm",
    """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first_value,
  round(list_sum(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))), 6) AS total FROM n""",
)
def mod18_norm(spark, sf_dir):
    unit = unit_embeddings(spark, sf_dir)
    total = F.aggregate("unit", F.lit(0.0), lambda acc, x: acc + x)
    return rounded(
        unit.select("vec_id", F.col("unit")[0].alias("first_value"), total.alias("total"))
    )


@query(
    "mod19",
    f"""WITH {nb_views()}, u AS ({' UNION ALL '.join(f"SELECT fold, term, '{x}' AS label, round(ll{i}, 9) AS coefficient FROM nb_l" for i, x in enumerate(LABELS))})
SELECT CAST(fold AS BIGINT) AS fold, label, term, round(coefficient, 6) AS coefficient, rk AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY coefficient DESC, term) AS rk FROM u) WHERE rk <= 30""",
)
def mod19(spark, sf_dir):
    table = word_vectors(spark, sf_dir)
    likelihood, _ = M.vector_bayes_tables(table.plain, table.size, LABELS, ALPHA)
    # bounded by folds x max_features rows
    named = likelihood.join(F.broadcast(table.vocabulary.select("fold", "idx", "term")), ["fold", "idx"])
    return rounded(M.influential_terms(named, LABELS, ["fold"]))


@query(
    "mod20",
    """WITH f AS (SELECT source_project AS project, term FROM (SELECT source_project, term, row_number() OVER (PARTITION BY source_project
  ORDER BY round(sum(w), 9) DESC, term) AS rk FROM v_weighted WHERE fold = 3 AND role = 'train' GROUP BY 1, 2) WHERE rk <= 30),
n AS (SELECT project, count(*) AS n FROM f GROUP BY 1),
s AS (SELECT a.project AS pa, b.project AS pb, count(*) AS c FROM f a JOIN f b ON a.term = b.term AND a.project < b.project GROUP BY 1, 2)
SELECT a.project AS project_a, b.project AS project_b, round(coalesce(c, 0) / greatest(a.n + b.n - coalesce(c, 0), 1), 6) AS jaccard
FROM n a JOIN n b ON a.project < b.project LEFT JOIN s ON pa = a.project AND pb = b.project""",
)
def mod20(spark, sf_dir):
    """Overlap between the 30 heaviest training terms of every two projects."""
    heavy = (
        weighted(spark, sf_dir)
        .filter((F.col("fold") == 3) & (F.col("role") == "train"))
        .groupBy("source_project", "term")
        .agg(F.round(F.sum("w"), 9).alias("weight"))
    )
    top = E.first_rows_per_group(
        heavy.withColumn("_minus", -F.col("weight")), ["source_project"], ["_minus", "term"], 30,
        ["term"],
    )
    return rounded(M.feature_overlap(top, "source_project", "term"))


def report_holdout(spark, sf_dir):
    """Development rows as the training side of fold 0, held-out rows as its validation side."""
    def build():
        rows = views.report_docs(spark, sf_dir).drop("summary", "description")
        split = S.chronological_holdout(rows, "creation_time", KEY, "severity")
        role = F.when(F.col("partition") == "development", "train").otherwise("validation")
        return split.select(
            KEY, F.lit(0).alias("fold"), role.alias("role"), F.col("severity").alias("label")
        )

    return views.remember(spark, sf_dir, "report_holdout", build)


def stored_model(spark, sf_dir) -> str:
    """Fit on all development rows, store as tables, return the folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "stored_model")
    if key not in views._memo:
        table = X.build_features(
            views.report_docs(spark, sf_dir), report_holdout(spark, sf_dir), KEY,
            unigram_branches(), [0],
        )
        spec = logistic()
        flat = N.Candidate(spec.name, spec.family, spec.c, spec.weighting, FLAT_TARGET)
        bank = N.fit_bank(table.plain.filter(F.col("role") == "train"), table.size, [flat], KEY)
        path = new_table_path(spark, "model")
        M.save_linear(bank.fitted(0), table.vocabulary, path)
        views._memo[key] = path
    return views._memo[key]


@query("mod21")
def mod21(spark, sf_dir):
    """Status of a stored model after loading it back."""
    terms, labels = M.load_linear(spark, stored_model(spark, sf_dir))
    return terms.agg(F.count("*").alias("terms")).crossJoin(
        F.broadcast(labels.agg(F.count("*").alias("labels")))
    )


def score_held_out(spark, sf_dir, run_id: str, log: str):
    """Score all held-out reports with the stored model, once for each run: the log is asked first."""
    DEC.claim_run(spark, log, run_id)
    terms, labels = M.load_linear(spark, stored_model(spark, sf_dir))
    held = report_holdout(spark, sf_dir).filter(F.col("role") == "validation").select(KEY)
    docs = views.report_docs(spark, sf_dir).join(held, KEY, "left_semi")
    return M.score_linear(docs, KEY, unigram_branches(), terms, labels)


@query("mod22")
def mod22(spark, sf_dir):
    """Score all held-out reports with the stored model, as a run of its own in a new log."""
    return score_held_out(spark, sf_dir, stored_model(spark, sf_dir), new_table_path(spark, "run-log"))


@query("mod23")
def mod23(spark, sf_dir):
    """Label words masked in every branch, same configuration, refitted on every fold."""
    m = members(spark, sf_dir)
    spec = M.Spec("LogisticRegression", 1.0, "balanced")
    parts = [
        _flat(spark, sf_dir, X.set_branches("F1", mask), [(f"mask={mask}", spec)], m, FOLDS)
        for mask in (False, True)
    ]
    return rounded(M.union_all(parts))
