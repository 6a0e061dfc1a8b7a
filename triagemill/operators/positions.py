"""Row positions in a total order, without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagemill.operators.skew import attach_facts
from triagemill.session import materialize

_SLOT_BITS = 33
# No window of with_previous holds more than about one of this many equal parts of all rows.
PIECES = 100
# One row in so many tells which keys are that large.
_SAMPLED = 64


def with_position(
    df: DataFrame, order_by: list[str], scope: str | None = None, materialized: bool = True
) -> DataFrame:
    """Add ``pos`` (0-based) and ``n_rows``, per ``scope`` value when one is named.

    ``order_by`` must be a total order, so end it with a unique key. Rows are range-partitioned
    and sorted on the composite key, hence many equal leading values still spread over tasks.
    The layout is written once because partition bounds are sampled and could otherwise differ
    between the counting and the numbering pass. ``df`` should be narrow.
    """
    keys = ([scope] if scope else []) + order_by
    laid_out = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    stored = materialize(laid_out, "positions") if materialized else laid_out
    part = F.shiftright("_slot", _SLOT_BITS)
    # one row per shuffle partition, so the running total and the broadcast are bounded
    starts = (
        stored.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select(
            "_part",
            (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_start"),
            F.sum("_rows").over(Window.partitionBy()).alias("n_rows"),
        )
    )
    numbered = stored.join(F.broadcast(starts), part == F.col("_part")).select(
        *df.columns,
        (F.col("_start") + F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))).alias("pos"),
        "n_rows",
    )
    if scope is None:
        return numbered
    facts = numbered.groupBy(F.col(scope).alias(scope)).agg(
        F.min("pos").alias("_scope_start"), F.count("*").alias("_scope_rows")
    )
    scoped = attach_facts(
        numbered.drop("n_rows"), facts, scope, "_scope_rows", F.col("pos"), "inner"
    )
    return scoped.select(
        *df.columns,
        (F.col("pos") - F.col("_scope_start")).alias("pos"),
        F.col("_scope_rows").alias("n_rows"),
    )


def with_previous(positioned: DataFrame, key: str, value: str, name: str = "previous") -> DataFrame:
    """Add ``name``: ``value`` of the row before, by ``pos``, that has the same ``key``.

    The first row of a key gets null; null is a key. Rows move once, by key. A key that holds
    more than 1/PIECES of a hashed sample is cut at positions, so no task gets it whole; the
    last row of a piece, at most PIECES of them for each such key, is handed to the next one.
    """
    sampled = (
        positioned.filter(F.pmod(F.xxhash64("pos"), F.lit(_SAMPLED)) == 0)
        .groupBy(F.col(key).alias("_hot"))
        .agg(F.count("*").alias("_n"))
    )
    total = F.broadcast(sampled.select(F.sum("_n").alias("_all")))
    hot = (
        sampled.crossJoin(total)
        .filter(F.col("_n") * PIECES > F.col("_all"))
        .select("_hot", F.lit(True).alias("_cut"))
    )
    piece = F.when(F.col("_cut"), F.floor(F.col("pos") * PIECES / F.col("n_rows"))).otherwise(-1)
    rows = (
        positioned.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left")
        .withColumn("_piece", piece.cast("int"))
        .select(*positioned.columns, "_piece")
    )
    # a struct is null only where there is no row before, the value in it may be null
    one = F.struct(F.col(value).alias("v"))
    carried = (
        rows.filter(F.col("_piece") >= 0)
        .groupBy(F.col(key).alias("_key"), F.col("_piece").alias("_at"))
        .agg(F.max_by(one, F.col("pos")).alias("_last"))
        .select(
            "_key",
            "_at",
            F.lag("_last").over(Window.partitionBy("_key").orderBy("_at")).alias("_carried"),
        )
    )
    before = F.lag(one).over(Window.partitionBy(key, "_piece").orderBy("pos"))
    return (
        rows.withColumn("_before", before)
        .join(
            F.broadcast(carried),
            F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_at")),
            "left",
        )
        .select(*positioned.columns, F.coalesce("_before", "_carried")["v"].alias(name))
    )


def thirds(pos: Column, n_rows: Column, rule: str) -> Column:
    """Early / middle / late by 1-based rank = pos + 1.

    ``qcut`` cuts at the rank quantiles 1 + (n - 1) k / 3, ``cut`` at n k / 3; both close on
    the right. Integer arithmetic keeps the edges exact.
    """
    rank = pos + 1
    if rule == "qcut":
        early = 3 * rank <= 3 + (n_rows - 1)
        middle = 3 * rank <= 3 + 2 * (n_rows - 1)
    elif rule == "cut":
        early = 3 * rank <= n_rows
        middle = 3 * rank <= 2 * n_rows
    else:
        raise ValueError(f"Unknown rule: {rule}")
    return F.when(early, "early").when(middle, "middle").otherwise("late")
