"""Quality rules: n-gram log-likelihood ratio of a trusted target to the raw corpus.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 8_192
THRESHOLD = -0.05
_WORD = r"[^\x20\x09-\x0D]+"
_MIX = 1_000_003


def words(text: Column) -> Column:
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>")
    )


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for several uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _beside(a: Column, b: Column, distance: int, join) -> Column:
    """``join`` of each element of ``a`` and the one of ``b`` that stands ``distance`` behind it."""
    n = F.greatest(F.size(b) - distance, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(distance + 1), n), join)


def gram_buckets(own_words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of a text's words and of its pairs of neighbouring words."""
    hashes = F.transform(own_words, lambda w: F.crc32(w.cast("binary")))
    return _let(
        hashes,
        lambda h: F.concat(
            F.transform(h, lambda x: x % buckets),
            _beside(h, h, 1, lambda x, y: (x * _MIX + y) % buckets),
        ),
    )


def ratio_weights(
    docs: DataFrame,
    trusted: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
) -> list[float]:
    """Log ratio of each bucket's share in the trusted rows to its share in all rows.

    ``trusted`` has the keys of the target's rows. Counts cover all texts of both; they are
    summed up before they move, and one number for each bucket reaches the driver. Shares are
    smoothed by one occurrence in every bucket.
    """
    marks = trusted.select(F.col(key).alias("_mark")).distinct()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    # both sides grow with the table, so small ones are joined in the same way
    rows = rows.join(marks.hint("merge"), F.col("_key") == F.col("_mark"), "left")
    grams = rows.select(
        F.col("_mark").isNotNull().cast("long").alias("target"),
        F.explode(gram_buckets(words(F.col("_text")), buckets)).alias("bucket"),
    )
    counted = grams.groupBy("bucket").agg(F.sum("target").alias("t"), F.count("*").alias("r"))
    target, raw = [1] * buckets, [1] * buckets
    for row in counted.collect():  # one row for each bucket at most
        target[row["bucket"]] += row["t"]
        raw[row["bucket"]] += row["r"]
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw)]


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs again: equal hashes are neighbours once sorted."""
    spots = F.array_sort(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )

    def starts(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    return F.aggregate(
        _let(spots, starts),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            (x + 5).alias("end"), (s["n"] + x + 5 - F.greatest(x, s["end"])).alias("n")
        ),
        lambda s: s["n"],
    )


def base_measures(df: DataFrame, text: str) -> DataFrame:
    """Add _words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    own = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(own, "\n", -1), lambda x: x.rlike(_WORD))
    # hashes of one, two, four and five words that start at each word
    pair = lambda x, y: F.xxhash64(x, y)
    windows = _let(
        F.transform(F.col("_words"), lambda w: F.xxhash64(w)),
        lambda one: _let(
            _beside(one, one, 1, pair),
            lambda two: _beside(_beside(two, two, 2, pair), one, 4, pair),
        ),
    )
    return (
        df.withColumn("_words", words(F.col(text)))
        .withColumn("_lines", lines)
        .withColumn("_windows", windows)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn(
            "word_chars", F.length(F.array_join("_words", "")).cast("long")
        )
        .withColumn(
            "n_symbols", (F.length(own) - F.length(F.translate(own, "#*$%&|<>", ""))).cast("long")
        )
        .withColumn(
            "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
        )
        .withColumn(
            "n_repeat_words",
            F.when(
                F.size(F.array_distinct("_windows")) < F.size("_windows"),
                _covered(F.col("_windows")),
            ).otherwise(F.lit(0).cast("long")),
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        )
        .drop("_lines", "_windows")
    )


def quality_rules(
    docs: DataFrame,
    weights: list[float],
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Measures, score and verdict of every row, from its whole text, without a shuffle.

    ``score`` is the mean weight (``ratio_weights``) of the text's n-grams, so long texts are
    judged like short ones; texts without a word score 0. ``kept``: not base_failed, and the
    score reaches ``threshold``. Null texts have no words and fail the base rules; repeated rows
    and null keys are rows like others; other columns are ignored; an empty table gives an empty
    result. n_repeat_words tells 5-word windows apart by a 64-bit hash.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")

    def mean(grams: Column) -> Column:
        total = F.aggregate(
            grams, F.lit(0.0), lambda s, g: s + F.get(table, g.cast("int"))
        )
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))

    return (
        base_measures(rows, "_text")
        .withColumn("score", _let(gram_buckets(F.col("_words"), len(weights)), mean))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .drop("_text", "_words")
    )
