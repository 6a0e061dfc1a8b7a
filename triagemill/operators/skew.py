"""Joins of rows with one-row-per-key facts that stay balanced when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key holding more than 1/HOT_SHARE of all rows is hot; at most HOT_SHARE keys can be.
HOT_SHARE = 1000


def attach_facts(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    weight: str,
    spread: Column,
    how: str = "left",
) -> DataFrame:
    """Join ``facts`` (one row per ``key``) onto ``rows`` by the string column ``key``.

    A null key is a key: it meets the facts of the null key, if there are any. ``how="inner"``
    drops rows whose key has no facts, so it is for lists of facts only; facts grouped from
    ``rows`` themselves never lose a row. ``weight`` is the facts column that says how many rows carry the key, and ``spread`` an
    expression that differs between rows. Facts of hot keys are broadcast: fewer than
    ``HOT_SHARE`` keys can exceed the share, so that side has a fixed bound. Everything else
    is an ordinary shuffle join, in which rows of hot keys are dealt out by ``spread`` under
    keys that match nothing.
    """
    payload = [c for c in facts.columns if c != key]
    share = facts.select(F.sum(weight).alias("_all_rows"))
    sized = facts.crossJoin(F.broadcast(share))
    is_hot = F.col(weight) * HOT_SHARE > F.col("_all_rows")
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    hot = sized.filter(is_hot).select(named.alias("_hot_key"), F.struct(*payload).alias("_hot"))
    cold = sized.filter(~is_hot).select(
        named.alias("_cold_key"), F.struct(*payload).alias("_cold")
    )
    marked = rows.join(F.broadcast(hot), named == F.col("_hot_key"), "left")
    marked = marked.withColumn(
        "_join_key",
        F.when(
            F.col("_hot_key").isNotNull(),
            F.concat(F.lit("\x00"), F.xxhash64(spread).cast("string")),
        ).otherwise(named),
    )
    joined = marked.join(cold, F.col("_join_key") == F.col("_cold_key"), "left")
    both = F.coalesce(F.col("_hot"), F.col("_cold"))
    if how == "inner":
        joined = joined.filter(both.isNotNull())
    return joined.select(
        *[F.col(c) for c in rows.columns], *[both[c].alias(c) for c in payload]
    )
