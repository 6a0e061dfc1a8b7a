"""Mixing sources to target weights: blocks apportioned by highest quotients (Sainte-Laguë)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagemill.operators.skew import attach_facts
from triagemill.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 16
SHARD_WORDS = 65_536
MAX_SHARDS = 4_096
SEED = "mix-1"
_WORD = r"[^\x20\x09-\x0D]+"
# fixed values: primes above any number of blocks in a shard, so each is coprime to it
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def seats(df: DataFrame, scope: list[str], tie: list[str], votes: str, total: str) -> DataFrame:
    """Add ``seats``: ``total`` seats of a scope dealt out by the highest quotients v / (2k + 1).

    One row per party. A divisor d gives a party v / d + 1/2 seats, rounded down; divisors are
    known that give all parties of a scope at most, and at least, the seats there are. Only the
    quotients between these two, fewer than four for each party on average, are ranked.
    """
    w = Window.partitionBy(*scope)
    n, v = F.count("*").over(w), F.col(votes).cast("double")
    few = F.greatest(F.floor(v * (F.col(total) - n / 2) / F.col("_votes") + 0.5) - 1, F.lit(0))
    many = F.floor(v * (F.col(total) + n / 2) / F.col("_votes") + 0.5) + 1
    bounds = (
        df.withColumn("_votes", F.sum(v).over(w))
        .withColumn("_few", F.when(F.col("_votes") > 0, few).otherwise(0).cast("long"))
        .withColumn("_many", F.when(F.col("_votes") > 0, many).otherwise(0).cast("long"))
        .withColumn("_left", F.col(total) - F.sum("_few").over(w))
    )
    ranked = (
        bounds.filter(F.col("_many") > F.col("_few"))
        .withColumn("_k", F.explode(F.sequence(F.col("_few"), F.col("_many") - 1)))
        .withColumn("_quotient", v / (2 * F.col("_k") + 1))
        .withColumn(
            "_rank",
            F.row_number().over(w.orderBy(F.desc("_quotient"), *[F.col(c) for c in tie])),
        )
    )
    won = ranked.filter("_rank <= _left").groupBy(*scope, *tie).agg(F.count("*").alias("_more"))
    return (
        bounds.join(won, [*scope, *tie], "left")
        .withColumn("seats", F.col("_few") + F.coalesce(F.col("_more"), F.lit(0)))
        .select(*df.columns, "seats")
    )


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP
) -> DataFrame:
    """_src, source_size, target: targets by weight, none above ``cap`` times its size.

    ``sizes``: _src, source, source_size, one row per source. A source is full where even the
    level of all sources after it, in order of cap over weight, would exceed its cap.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("_ratio", "_no")
    at = (F.row_number().over(in_order) - 1).cast("long")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    filled = (
        sizes.withColumn("_no", at)
        .withColumn("_weight", weight.cast("long"))
        .withColumn("_cap", F.lit(cap) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        .withColumn("_caps", F.sum("_cap").over(by_ratio) - F.col("_cap"))
        .withColumn(
            "_weights",
            F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        )
        .withColumn("_level", (F.col("_total") - F.col("_caps")) / F.col("_weights"))
        .withColumn("_open", F.col("_ratio") > F.col("_level"))
    )
    first = F.min(F.when(F.col("_open"), F.struct("_ratio", "_no", "_level"))).over(
        Window.partitionBy()
    )["_level"]
    target = F.when(F.col("_open"), F.col("_weight") * first).otherwise(F.col("_cap").cast("double"))
    return filled.withColumn("target", target).select("_src", "_no", "source_size", "target")


def _hex(column: Column, start: int) -> Column:
    return F.conv(F.substring(column, start, 8), 16, 10).cast("long")


def place(
    docs: DataFrame,
    carry: list[str],
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """``carry`` columns of every row, with its place and its share in the mix.

    Adds _size, _source_size, _target, _start (words before it in its shard), and of its shard
    _blocks, _quota (blocks to take), _prime and _turn (the seeded order of its blocks). A source
    is cut into shards by a seeded hash of the key, as many as its words ask for and
    ``MAX_SHARDS`` at most, so a source with a third of all words is many windows.
    """
    measured = docs.select(
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("_row"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(_WORD)), F.lit(0)).cast("long").alias("_size"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~")).alias("_src"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("_order"),
        F.xxhash64(F.col(text).cast("string")).alias("_tie"),  # rows that repeat a key
    )
    narrow = materialize(measured.drop("_row"), "mix-sizes")
    sizes = narrow.groupBy("_src", "source").agg(
        F.sum("_size").alias("source_size"), F.count("*").alias("_n")
    )
    targets = source_targets(sizes.drop("_n"), weights, share, cap)
    n_blocks = F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5).cast("long")
    quotas = seats(targets.withColumn("_all", n_blocks).withColumn("_one", F.lit(0)), ["_one"], ["_no"], "target", "_all")
    facts = quotas.join(sizes.select("_src", "_n"), "_src").select(
        "_src",
        "_n",
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        F.col("seats").alias("_seats"),
        F.greatest(
            F.least(F.ceil(F.col("source_size") / shard_words), F.lit(MAX_SHARDS)), F.lit(1)
        ).cast("long").alias("_shards"),
    )
    facts = materialize(facts, "mix-sources")

    def sharded(rows: DataFrame) -> DataFrame:
        known = attach_facts(rows, facts, "_src", "_n", F.col("_order"))
        return known.withColumn("_shard", _hex(F.col("_order"), 1) % F.col("_shards"))

    shards = sharded(narrow).groupBy("_src", "_shard", "_seats").agg(F.sum("_size").alias("_words"))
    dealt = seats(shards, ["_src"], ["_shard"], "_words", "_seats")
    mark = F.md5(F.concat(F.lit(seed), F.col("_src"), F.lit("/"), F.col("_shard").cast("string")))
    blocks = F.ceil(F.col("_words") / block).cast("long")
    dealt = (
        dealt.withColumn("_blocks", blocks)
        .withColumn("_quota", F.least(F.col("seats"), cap * F.col("_blocks")))
        .withColumn(
            "_prime",
            F.element_at(
                F.array(*[F.lit(p) for p in _PRIMES]), (_hex(mark, 1) % len(_PRIMES) + 1).cast("int")
            ).cast("long"),
        )
        .withColumn("_turn", _hex(mark, 9))
        .select("_src", "_shard", "_blocks", "_quota", "_prime", "_turn")
    )
    dealt = materialize(dealt, "mix-shards")
    stream = Window.partitionBy("_src", "_shard").orderBy("_order", "_size", "_tie")
    before = F.sum("_size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    placed = sharded(measured).withColumn("_start", before).join(dealt, ["_src", "_shard"])
    own = ["_size", "_source_size", "_target", "_start", "_blocks", "_quota", "_prime", "_turn"]
    return placed.select(
        *[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(carry)], *own
    )


def _passes() -> tuple[Column, Column]:
    """Times every block of the shard is taken, and how many are taken once more."""
    safe = F.greatest(F.col("_blocks"), F.lit(1))
    return F.floor(F.col("_quota") / safe).cast("long"), F.col("_quota") % safe


def _chosen(block_no: Column, extra: Column) -> Column:
    """Whether a block is among the ``extra`` first of its shard's seeded order."""
    rank = (block_no * F.col("_prime") + F.col("_turn")) % F.greatest(F.col("_blocks"), F.lit(1))
    return rank < extra


def _own_blocks(block: int) -> Column:
    start, end = F.col("_start"), F.col("_start") + F.col("_size") - 1
    numbers = F.sequence(F.floor(start / block).cast("long"), F.floor(end / block).cast("long"))
    return F.when(F.col("_size") > 0, numbers).otherwise(F.array().cast("array<bigint>"))


def mix(docs: DataFrame, key: str = "doc_id", block: int = BLOCK_WORDS, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each row.

    Words are runs of characters other than space and tab to carriage return. A source's rows
    form streams of words, one for each shard, in a seeded order; streams are cut into blocks of
    ``block`` words. Sainte-Laguë deals the mix's blocks out to sources by their targets and on to
    shards by their words. A shard with q of n blocks takes each block q div n times, and
    the first q mod n blocks of a seeded order once more; q is at most ``cap`` times n, so no row
    exceeds that many times its size. Null and empty texts have size 0 and take 0 words. A null
    source is a source; a null key counts as empty text in the seeded hash. Repeated rows are
    rows of their own. Other columns are ignored; an empty table gives an empty result.
    DataFrame functions only; results do not depend on partitioning.
    """
    placed = place(docs, [key], key=key, block=block, **options)
    base, extra = _passes()
    start, end = F.col("_start"), F.col("_start") + F.col("_size")

    def overlap(so_far: Column, b: Column) -> Column:
        words = F.least(end, (b + 1) * block) - F.greatest(start, b * block)
        return so_far + F.when(_chosen(b, extra), words).otherwise(F.lit(0))

    once_more = F.aggregate(_own_blocks(block), F.lit(0).cast("long"), overlap)
    return placed.select(
        F.col(key).alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (base * F.col("_size") + once_more).alias("taken"),
    )


def apply_mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block: int = BLOCK_WORDS,
    **options,
) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``, whatever their names.

    The blocks of a shard that are taken once more are neighbours: a run of its stream from a
    seeded block on. Shards, passes and numbers of blocks are those of ``mix``. As a stream is whole documents in a seeded order, a run is whole documents too, cut
    only where it begins and ends. A row appears once for each full pass of its shard, and once
    more if the run covers it, with the words (white space before a word kept) of its covered
    blocks if not all are. Rows without a word are in no block and appear once, as no mix takes
    anything of them.
    """
    names = docs.columns
    columns = [f"c{i}" for i in range(len(names))]  # no name of its own begins with a letter
    inner = dict(zip(names, columns))
    placed = place(
        docs.toDF(*columns), columns, key=inner[key], text=inner[text], source=inner[source],
        block=block, **options,
    )
    text = inner[text]
    base, extra = _passes()
    run = F.col("_turn") % (F.greatest(F.col("_blocks"), F.lit(1)) - extra + 1)
    chosen = F.filter(_own_blocks(block), lambda b: (b >= run) & (b < run + extra))
    all_chosen = F.size("_some") == F.size("_own")
    placed = (
        placed.withColumn("_own", _own_blocks(block))
        .withColumn("_some", chosen)
        .withColumn("_times", base + F.when((F.size("_own") > 0) & all_chosen, 1).otherwise(0))
        .withColumn("_times", F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.col("_times")))
    )
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + _WORD), F.lit(0))
    first = F.col("_start")

    def cut(own_words: Column, b: Column) -> Column:
        low = F.greatest(b * block, first) - first
        high = F.least((b + 1) * block, first + F.col("_size")) - first
        part = F.slice(own_words, (low + 1).cast("int"), (high - low).cast("int"))
        return F.array_join(part, "")

    partial = (F.size("_some") > 0) & ~all_chosen
    # the words are bound to a variable, so that they are cut out once and not for each block
    joined = F.transform(
        F.array(words),
        lambda w: F.array_join(F.transform("_some", lambda b: cut(w, b)), ""),
    )
    part_text = F.when(partial, F.ltrim(F.element_at(joined, 1)))
    texts = F.concat(
        F.array_repeat(F.col(text), F.col("_times").cast("int")),
        F.when(partial, F.array(part_text)).otherwise(F.array().cast("array<string>")),
    )
    exploded = placed.withColumn("_text", F.explode(texts))
    return exploded.select(
        *[F.col("_text" if c == text else c).alias(n) for c, n in zip(columns, names)]
    )
