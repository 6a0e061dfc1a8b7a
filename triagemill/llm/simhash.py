"""SimHash near-dedup: all fingerprints within a few bits of each other, by vantage-point trees.

1. A text's fingerprint has the majority of each bit over the hashes of its runs of three words.
2. A vantage-point tree deals distinct fingerprints to shards: a node sends those within a radius of
   its vantage point left and the others right. Its upper levels are chosen from a bounded sample,
   below them vantage points follow from the node's number. A fingerprint on the left that lies so
   near the radius that the triangle inequality allows a link across it is also sent to the right,
   as a query; a query goes to every child that may hold a fingerprint in reach.
3. A shard searches its own fingerprints for each of them and for its queries in a tree of its own,
   prunes branches by the same bounds, and compares leaves exactly. Links leave a task as stars.
4. Components of the stars' links, and the smallest document of each, go back to the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.llm.graph import Stars, components, join_facts
from triagemill.operators.skew import attach_facts
from triagemill.session import materialize

WORDS = 3
SEED = 42
RADIUS = 2
SHARD_ROWS = 4096  # fingerprints that a shard of the tree holds on average
SAMPLE_ROWS = 16_384
PART_ROWS = 1 << 16  # a shard with more rows is searched in pairs of parts
LEAF_ROWS = 128
_SEGMENT = 1 << 20
_HASHES = 1 << 15
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


# --- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: str, words: int = WORDS) -> Iterator[np.ndarray]:
    """Hashes of a text's runs of words, a part of the text at a time."""
    data = text.encode("utf-8", "surrogatepass").lower()  # of bytes: A to Z only
    carry: list[bytes] = []
    at = n_runs = 0
    while at < len(data):
        blank = _BLANK.search(data, at + _SEGMENT)
        stop = blank.start() if blank else len(data)
        own = carry + data[at:stop].split()
        at = stop
        if len(own) >= words:
            joined = b" ".join(own)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
            starts = [0, *(ends[: len(own) - words] + 1).tolist()]
            h = xxhash.xxh64_intdigest
            runs = [h(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
            n_runs += len(runs)
            yield np.array(runs, np.uint64)
        carry = own[-(words - 1) :] if words > 1 else []
    if carry and not n_runs:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprints(texts: list[str], words: int = WORDS) -> np.ndarray:
    """A 64-bit fingerprint of each text; zero for one without words."""
    counts, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    of: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for runs in shingle_hashes(t, words):
            n[i] += len(runs)
            for at in range(0, len(runs), _HASHES):
                held.append(runs[at : at + _HASHES])
                of.append(i)
                size += len(held[-1])
                if size >= _HASHES:
                    _count(held, of, counts)
                    held, of, size = [], [], 0
    if held:
        _count(held, of, counts)
    bits = 2 * counts > n[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def _count(held: list[np.ndarray], of: list[int], counts: np.ndarray) -> None:
    """Add the set bits of each part's hashes to the counts of its text."""
    flat = np.concatenate(held).astype("<u8")
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
    np.add.at(counts, np.array(of), sums)


def _prints(words: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = fingerprints([t or "" for t in part.column(1).to_pylist()], words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"]
                )

    return prints


# --- the tree over shards -------------------------------------------------------------------


@dataclass(frozen=True)
class ShardTree:
    """A vantage-point tree whose nodes are numbered from 1 as in a heap; leaves are shards."""

    depth: int
    points: np.ndarray  # of the nodes of the upper levels
    radii: np.ndarray

    def _at(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = node < len(self.points)
        inside = np.where(known, node, 0)
        point = np.where(known, self.points[inside], _mixed(node.astype(np.uint64)))
        # below the sample: half of all fingerprints are within 31 or 32 bits of any point
        radius = np.where(known, self.radii[inside], 31 + (point & np.uint64(1)).astype(np.int64))
        return point, radius

    def shards(self, prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the fingerprint, shard, whether the shard is its own) for all it goes to."""
        row, node = np.arange(len(prints)), np.ones(len(prints), np.int64)
        home = np.ones(len(prints), bool)
        for _ in range(self.depth):
            point, radius = self._at(node)
            away = np.bitwise_count(prints[row] ^ point).astype(np.int64)
            left = away <= radius
            # own ones cross to the right only, queries to wherever a link may lead
            to_left = np.where(home, left, away - reach <= radius)
            to_right = np.where(home, ~left | (away > radius - reach), away + reach > radius)
            row = np.concatenate([row[to_left], row[to_right]])
            stays = np.concatenate([home[to_left], home[to_right] & ~left[to_right]])
            node = np.concatenate([2 * node[to_left], 2 * node[to_right] + 1])
            home = stays
        return row, node - (1 << self.depth), home


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def plant(sample: np.ndarray, n_rows: int, shard_rows: int, reach: int) -> ShardTree:
    """A tree with about ``n_rows / shard_rows`` shards, its upper levels fitted to ``sample``.

    Of some vantage points and radii that cut a node's sample about in half, the pair with the
    fewest fingerprints near the radius is taken.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, n_rows / shard_rows)))))
    upper = min(depth, max(0, int(np.log2(max(1, len(sample) / 32)))))
    points, radii = np.zeros(1 << upper, np.uint64), np.zeros(1 << upper, np.int64)
    rng = np.random.default_rng(5)
    own = {1: sample}
    for node in range(1, 1 << upper):
        here = own.pop(node)
        best = None
        some = rng.choice(here, min(len(here), 12), replace=False) if len(here) else here
        for point in [*some.tolist(), int(_mixed(np.array([node], np.uint64))[0])]:
            away = np.bitwise_count(here ^ np.uint64(point)).astype(np.int64)
            share = np.cumsum(np.bincount(away, minlength=65)) / max(1, len(here))
            for radius in np.flatnonzero((share >= 0.35) & (share <= 0.65)).tolist() or [31]:
                near = ((away > radius - reach) & (away <= radius + reach)).mean() if len(here) else 0
                cost = near + 0.2 * abs(share[radius] - 0.5)
                if best is None or cost < best[0]:
                    best = (cost, point, radius)
        _, points[node], radii[node] = best
        left = np.bitwise_count(here ^ points[node]).astype(np.int64) <= radii[node]
        own[2 * node], own[2 * node + 1] = here[left], here[~left]
    return ShardTree(depth, points, radii)


def _dealt(tree: ShardTree, reach: int):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy()
            row, shard, home = tree.shards(prints.view(np.uint64), reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(prints[row]), pa.array(home)],
                names=["shard", "print", "home"],
            )

    return dealt


def _in_parts(dealt: DataFrame) -> DataFrame:
    """Rows with the pair of parts (_i, _j) they are searched in: those in _i for those in _j.

    A shard of ordinary size is one part. ``_own``: to be searched, ``_asks``: to be searched for.
    """
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("_rows"))
    sizes = sizes.filter(F.col("_rows") > PART_ROWS).select(
        F.col("shard").cast("string").alias("_big"),
        F.ceil(F.col("_rows") / PART_ROWS).cast("int").alias("_parts"),
        "_rows",
    )
    # the weight of a shard is what it holds, so that large ones are known to every task
    rows = dealt.withColumn("_big", F.col("shard").cast("string"))
    rows = attach_facts(rows, sizes, "_big", "_rows", F.col("print"))
    parts = F.coalesce("_parts", F.lit(1))
    mine = F.pmod(F.xxhash64("print"), parts).cast("int")
    every = F.sequence(F.lit(0), parts - 1)

    def asked(i: Column) -> Column:
        return F.struct(
            i.alias("_i"), F.col("_mine").alias("_j"),
            (F.col("home") & (i == F.col("_mine"))).alias("_own"), F.lit(True).alias("_asks"),
        )

    def held(j: Column) -> Column:
        return F.struct(
            F.col("_mine").alias("_i"), j.alias("_j"), F.lit(True).alias("_own"),
            F.lit(False).alias("_asks"),
        )

    rows = rows.withColumn("_mine", mine).withColumn("_every", every)
    others = F.filter("_every", lambda j: F.col("home") & (j != F.col("_mine")))
    places = F.concat(F.transform("_every", asked), F.transform(others, held))
    return rows.select("shard", "print", F.explode(places).alias("_at")).select(
        "shard", "print", "_at.*"
    )


# --- search inside a shard ------------------------------------------------------------------


def search(held: np.ndarray, asks: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (held, asks) of different fingerprints within ``reach`` bits, some at a time."""
    todo = [(held, asks)]
    while todo:
        held, asks = todo.pop()
        if not len(held) or not len(asks):
            continue
        if len(held) > LEAF_ROWS:
            point = held[len(held) // 2]
            away = np.bitwise_count(held ^ point).astype(np.int64)
            radius = int(np.partition(away, (len(away) - 1) // 2)[(len(away) - 1) // 2])
            left = away <= radius
            if not left.all():
                asked = np.bitwise_count(asks ^ point).astype(np.int64)
                todo.append((held[left], asks[asked - reach <= radius]))
                todo.append((held[~left], asks[asked + reach > radius]))
                continue
        width = max(1, (1 << 18) // len(held))
        for at in range(0, len(asks), width):
            own = asks[at : at + width]
            for low in range(0, len(held), 1 << 18):
                some = held[low : low + (1 << 18)]
                differ = np.bitwise_count(some[:, None] ^ own[None, :])
                a, b = np.nonzero((differ <= reach) & (differ > 0))
                if len(a):
                    yield some[a], own[b]


def _linked(reach: int):
    def linked(table: pa.Table) -> pa.Table:
        prints = table["print"].to_numpy().view(np.uint64)
        own, asks = table["_own"].to_numpy(), table["_asks"].to_numpy()
        found = Stars()
        for a, b in search(prints[own], prints[asks], reach):
            found.add(a.view(np.int64), b.view(np.int64))
        a, b = found.found()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return linked


# --- the operator ---------------------------------------------------------------------------


def simhash_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    reach: int = RADIUS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row.

    Two rows are linked if their fingerprints differ in ``reach`` bits or fewer; ``component_id`` is
    the smallest key reached over links, the row's own included. A bit of a fingerprint is set if
    over half of the XXH64 (seed 42) of the text's runs of ``words`` words have it, repeats
    counted; A to Z are lower-cased, words are runs of characters other than space and tab to
    carriage return; fewer words are one run. Null texts and texts without words have fingerprint
    zero, linked like any other. Repeated rows are rows of their own. Rows with a null key are
    linked too, but never name a component; one of such rows alone has none. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = materialize(
        rows.mapInArrow(_prints(words), f"doc_id {kind}, print long"), "fingerprints"
    )
    distinct = materialize(
        rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")),
        "distinct-fingerprints",
    )
    n_distinct = distinct.count()
    share = min(0.25, SAMPLE_ROWS / max(1, n_distinct))
    sampled = distinct.filter(
        F.pmod(F.xxhash64("print"), F.lit(1 << 20)) < int(share * (1 << 20))
    ).select("print")
    # at most about SAMPLE_ROWS values, whatever there is
    sample = np.sort(np.array([r["print"] for r in sampled.collect()], np.int64)).view(np.uint64)
    tree = plant(sample, n_distinct, shard_rows, reach)
    dealt = distinct.select("print").mapInArrow(
        _dealt(tree, reach), "shard long, print long, home boolean"
    )
    dealt = materialize(dealt, "shards")
    edges = (
        _in_parts(dealt)
        .groupBy("shard", "_i", "_j")
        .applyInArrow(_linked(reach), "a long, b long")
    )
    labels = components(edges)
    linked = distinct.join(labels, F.col("print") == F.col("node")).select("print", "root", "first")
    roots = linked.groupBy("root").agg(
        F.min("first").alias("component_id"), F.count("*").alias("_members")
    )
    named = join_facts(linked, materialize(roots, "roots"), "root", "_members").select(
        F.col("print").alias("_print"), "component_id"
    )
    facts = distinct.join(named, F.col("print") == F.col("_print"), "left").select(
        "print", "n", F.coalesce("component_id", "first").alias("component_id")
    )
    facts = materialize(facts, "components")
    return attach_facts(rows, facts, "print", "n", F.col("doc_id"), "inner").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
