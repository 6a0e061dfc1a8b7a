"""N-gram Jaccard join: MinHash bands, Bayesian pruning of pairs, exact verification in blocks.

1. Every text becomes a set of hashed runs of five words and a MinHash signature; equal texts
   are one text from here on.
2. Texts that share a band of the signature are candidates. A band's members are compared in
   blocks inside a task: signatures are read a part at a time, and a pair is dropped once the
   posterior probability that its similarity reaches the threshold is below the tolerance. What
   is left is written as a spanning star of each block, not as pairs.
3. Each connected group of these stars gets its texts' sets, again in pairs of blocks; exact
   intersections decide, and links are counted per text inside the task.

Every text of a group is compared with every other one, so a group of m texts costs m * m / 2
comparisons in its tasks, but the rows that move are m times the number of its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.llm.graph import Stars, components, join_facts
from triagemill.operators.skew import attach_facts
from triagemill.session import materialize

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 3  # a pair at 0.8 shares no band with probability 6e-7
HASHES = 128
STEP = 32
TOLERANCE = 1e-6
BLOCK = 2048
SETS = 512  # texts whose sets are compared with each other at once
PACK_ROWS = 20_000
PACK_SHINGLES = 500_000
PAIRS = 1 << 15  # pairs that are looked at together
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


# --- sets and signatures --------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all texts, one after another, and the number of each text's.

    Words are runs of characters other than space and tab to carriage return. A text of fewer
    than ``size`` words has one run, all its words; a text without a word has none.
    """
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    letter = ~_SPACE[data]
    before = np.concatenate([[False], letter[:-1]])
    starts = np.flatnonzero(letter & ~before)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(letter)
    first = np.flatnonzero(~before[at])  # of each word among its letters
    length = np.diff(np.append(first, len(at)))
    power = np.cumprod(np.full(length.max(), 0x5851F42D4C957F2D, np.uint64))
    place = np.arange(len(at)) - np.repeat(first, length)
    word = _mixed(np.add.reduceat((data[at] + np.uint64(1)) * power[place], first))
    owner = np.searchsorted(ends, starts, "right")
    n_words = np.bincount(owner, minlength=len(texts))
    factor = np.cumprod(np.full(size, 0xDA942042E4DD58B5, np.uint64))
    runs = len(word) - size + 1
    if runs > 0:
        h = sum(word[i : i + runs] * factor[i] for i in range(size))
        inside = owner[:runs] == owner[size - 1 :]
        hashes, owners = [_mixed(h[inside])], [owner[:runs][inside]]
    else:
        hashes, owners = [], []
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        begin = (np.cumsum(n_words) - n_words)[short]
        sums = [(word[b : b + n] * factor[:n]).sum() for b, n in zip(begin, n_words[short])]
        hashes.append(_mixed(np.array(sums, np.uint64)))
        owners.append(short)
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))


def signatures(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16-bit MinHash values, a row of ``HASHES`` for each set that is not empty."""
    some = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    rng = np.random.default_rng(7)
    odd = rng.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, HASHES, np.uint64)
    out = np.empty((len(starts), HASHES), np.uint16)
    for k in range(HASHES):
        least = np.minimum.reduceat(flat * odd[k] + add[k], starts) if len(starts) else flat[:0]
        out[:, k] = (_mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in parts of about a million characters."""
    texts = [t or "" for t in batch.column(text).to_pylist()]
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= 1 << 20 or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _slices(batch, 2):
            flat, sizes = shingle_sets(texts)
            rows = iter(signatures(flat, sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:2],
                    pa.array(sizes),
                    pa.array([next(rows).tobytes() if n else None for n in sizes], pa.binary()),
                ],
                names=["id", "digest", "n", "sig"],
            )


# --- candidates -----------------------------------------------------------------------------


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among n hashes for which P(similarity >= threshold) reaches the tolerance.

    With a uniform prior the posterior after m matches is Beta(m + 1, n - m + 1), whose upper
    tail at the threshold is a binomial sum.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = _stack(batch.column(1))
        bands = sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.int64)
        keys = (bands[:, :, 0] << 32) | (bands[:, :, 1] << 16) | bands[:, :, 2]
        keys |= np.arange(BANDS, dtype=np.int64) << 48
        each = pa.array(np.repeat(np.arange(len(sig)), BANDS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(each), pa.array(keys.reshape(-1))], names=["node", "key"]
        )


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def _in_blocks(rows: DataFrame, group: str, blocks: Column, n_packs: float | None) -> DataFrame:
    """Rows of each group in pairs of its blocks, dealt to packs of about equal weight.

    Adds _i and _j (the pair) and _mine (the row's block); a row is in one pair for each block.
    """
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    paired = rows.withColumn("_mine", mine).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
    )
    paired = paired.withColumn("_i", F.least("_mine", "_other")).withColumn(
        "_j", F.greatest("_mine", "_other")
    )
    return paired.drop("_other").withColumn(
        "_pack", F.pmod(F.xxhash64(group, "_i", "_j"), F.lit(max(1, math.ceil(n_packs or 0))))
    )


def _groups(table: pa.Table, group: str) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per group and pair of blocks: rows of its first and of its second block, and the group."""
    columns = [table[c].to_numpy() for c in (group, "_i", "_j", "_mine")]
    key, i, j, mine = columns
    order = np.lexsort((mine, j, i, key))
    changed = np.zeros(len(order), bool)
    for c in (key, i, j):
        changed[1:] |= c[order][1:] != c[order][:-1]
    for own in np.split(order, np.flatnonzero(changed)):
        if len(own):
            first = own[mine[own] == i[own[0]]]
            second = first if i[own[0]] == j[own[0]] else own[mine[own] == j[own[0]]]
            yield first, second, int(key[own[0]])


def _pairs(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a row of either list, or of two rows of one list, some at a time."""
    width = max(1, PAIRS // max(1, len(second)))
    for at in range(0, len(first), width):
        own = np.arange(at, min(at + width, len(first)))
        a, b = np.repeat(own, len(second)), np.tile(np.arange(len(second)), len(own))
        if first is second:
            a, b = a[a < b], b[a < b]
        yield first[a], second[b]


def _survivors(sig, a, b, band, needed) -> np.ndarray:
    """Pairs whose first common band is ``band`` and that no part of the signatures rules out."""
    width = BANDS * ROWS
    same = (sig[a, :width] == sig[b, :width]).reshape(-1, BANDS, ROWS).all(axis=2)
    left = np.flatnonzero(same.argmax(axis=1) == band)
    matches = np.zeros(len(left), np.int64)
    for stop in range(STEP, HASHES + 1, STEP):
        part = slice(stop - STEP, stop)
        matches += (sig[a[left], part] == sig[b[left], part]).sum(axis=1)
        kept = matches >= needed[stop]
        left, matches = left[kept], matches[kept]
    return left


def _prune(threshold: float, tolerance: float):
    needed = {n: least_matches(n, threshold, tolerance) for n in range(STEP, HASHES + 1, STEP)}

    def prune(table: pa.Table) -> pa.Table:
        nodes, sig = table["node"].to_numpy(), _stack(table["sig"])
        found = Stars()
        for first, second, key in _groups(table, "key"):
            for a, b in _pairs(first, second):
                left = _survivors(sig, a, b, key >> 48, needed)
                found.add(nodes[a[left]], nodes[b[left]])
        node, root = found.found()
        return pa.table({"a": pa.array(node), "b": pa.array(root)})

    return prune


# --- verification ---------------------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _slices(batch, 3):
            flat, sizes = shingle_sets(texts)
            cuts = np.cumsum(sizes)[:-1]
            sets = pa.array([s.tobytes() for s in np.split(flat, cuts)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], sets], names=["root", "node", "blocks", "shingles"]
            )


def _intersections(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, a few thousand elements at a time."""
    both = [np.concatenate(first), np.concatenate(second)]
    names, at = np.unique(np.concatenate(both), return_inverse=True)
    of = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (first, second)]
    column = np.split(at, [len(both[0])])
    order = [np.argsort(c, kind="stable") for c in column]
    out = np.zeros((len(first), len(second)), np.int64)
    width = 2048
    for low in range(0, len(names), width):
        halves = []
        for side, x in enumerate((first, second)):
            c = column[side][order[side]]
            own = order[side][np.searchsorted(c, low) : np.searchsorted(c, low + width)]
            dense = np.zeros((len(x), width), np.float32)
            dense[of[side][own], column[side][own] - low] = 1
            halves.append(dense)
        out += (halves[0] @ halves[1].T).astype(np.int64)
    return out


def _verify(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        links, found = np.zeros(len(nodes), np.int64), Stars()
        for first, second, _ in _groups(table, "root"):
            if len(first) and len(second):
                common = _intersections([sets[x] for x in first], [sets[x] for x in second])
                union = size[first][:, None] + size[second][None, :] - common
                linked = common / np.maximum(union, 1) >= threshold
                if first is second:
                    np.fill_diagonal(linked, False)
                    links[first] += linked.sum(axis=1)
                else:
                    links[first] += linked.sum(axis=1)
                    links[second] += linked.sum(axis=0)
                a, b = np.nonzero(linked)
                found.add(nodes[first[a]], nodes[second[b]])
        node, root = found.found()
        own = np.flatnonzero(links)
        return pa.table(
            {
                "a": pa.array(np.concatenate([node, nodes[own]])),
                "b": pa.array(np.concatenate([root, nodes[own]])),
                "links": pa.array(np.concatenate([np.zeros(len(node), np.int64), links[own]])),
            }
        )

    return verify


# --- the operator ---------------------------------------------------------------------------


def _text_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, digest, text of the rows with an integer key."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(key).cast("long").alias("id"), F.md5(own.cast("binary")).alias("digest"), own.alias("text")
    ).filter(F.col("id").isNotNull())


def text_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """id, digest, n_rows, root, class_id, n_links, n_copies of each key and text.

    One key may have several texts. Texts are told apart by their MD5 and numbered; ``root`` is
    the number of a class, ``n_rows`` says how often key and text are repeated. See
    ``jaccard_join`` for the others.
    """
    source = _text_rows(docs, key, text)
    signed = materialize(
        source.mapInArrow(_signed, "id long, digest string, n long, sig binary"), "signatures"
    )
    # a third of all rows may share a digest: these sums are made before rows move
    rows = signed.groupBy("id", "digest").agg(F.count("*").alias("n_rows"))
    same = rows.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    same = materialize(same.withColumn("node", F.monotonically_increasing_id()), "texts")
    named = same.select(F.col("digest").alias("_d"), F.col("rep"), "node")
    # the pair of digest and id is as good as unique, whatever the copies of a text
    reps = (
        signed.filter(F.col("sig").isNotNull())
        .join(named, (F.col("digest") == F.col("_d")) & (F.col("id") == F.col("rep")))
        .groupBy("node")
        .agg(F.max("n").alias("n"), F.max("sig").alias("sig"))
    )
    reps = materialize(reps, "representatives")
    bands = reps.select("node", "sig").mapInArrow(_band_keys, "node long, key long")
    bands = materialize(bands, "band-keys")
    shared = materialize(
        bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "shared-bands"
    )
    blocks = F.ceil(F.col("m") / BLOCK)
    members = join_facts(bands, shared, "key", "m").join(reps.select("node", "sig"), "node")
    n_packs = shared.agg(F.sum(F.col("m") * blocks) / PACK_ROWS).first()[0]
    candidates = (
        _in_blocks(members, "key", blocks, n_packs)
        .groupBy("_pack")
        .applyInArrow(_prune(threshold, tolerance), "a long, b long")
    )
    groups = components(candidates)
    sized = (
        groups.join(reps.select("node", "n"), "node")
        .groupBy("root")
        .agg(F.count("*").alias("m"), F.sum("n").alias("total"))
        .withColumn(
            "blocks",
            F.greatest(F.ceil(F.col("m") / SETS), F.ceil(F.col("total") / PACK_SHINGLES)),
        )
    )
    sized = materialize(sized, "groups")
    involved = join_facts(groups, sized, "root", "m").join(
        same.select("node", F.col("digest").alias("_d"), "rep"), "node"
    ).select("root", "node", "blocks", "_d", "rep")
    texts = source.join(
        involved, (F.col("digest") == F.col("_d")) & (F.col("id") == F.col("rep"))
    ).select("root", "node", "blocks", "text")
    sets = texts.mapInArrow(_sets, "root long, node long, blocks long, shingles binary")
    sets = sets.dropDuplicates(["node"])
    n_packs = sized.agg(F.sum(F.col("total") * F.col("blocks")) / PACK_SHINGLES).first()[0]
    verified = (
        _in_blocks(sets, "root", F.col("blocks"), n_packs)
        .groupBy("_pack")
        .applyInArrow(_verify(threshold), "a long, b long, links long")
    )
    verified = materialize(verified, "verified")
    links = verified.groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("n_links"))
    linked = components(verified).join(links, F.col("node") == F.col("_a"))
    linked = linked.join(
        same.select(F.col("node").alias("_node"), "rep"), F.col("node") == F.col("_node")
    ).select("node", "root", "n_links", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("_m"))
    classes = join_facts(linked, materialize(least, "classes"), "root", "_m")
    classes = classes.select(F.col("node").alias("_node"), "root", "n_links", "class_id")
    known = same.join(classes, F.col("node") == F.col("_node"), "left").select(
        "digest",
        F.coalesce("root", "node").alias("root"),
        F.coalesce("class_id", "rep").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "n_copies",
    )
    known = materialize(known, "text-classes")
    return attach_facts(rows, known, "digest", "n_copies", F.col("id"), "inner")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document, a key with its text.

    Two texts are linked if their sets of five-word runs have a Jaccard similarity of at least
    ``threshold``. ``n_links``: other different texts linked to the document's; ``n_copies``:
    documents with exactly its text, itself included; ``class_id``: smallest key of the documents
    reached over links and copies. Null texts count as empty; texts without a word link to none,
    but are copies of equal ones. Rows without an integer key take no part; rows that repeat key
    and text are one document, and a key with two texts is two documents. Other columns are
    ignored; an empty table gives an empty result.
    """
    found = text_classes(docs, key, text, **options)
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each class: that with the smallest key, of its texts the smallest
    digest. Rows that repeat this key and text are one row, any of them. Rows without a key stay.
    """
    found = text_classes(docs, key, text, **options)
    first = found.groupBy("root").agg(F.min(F.struct("id", "digest", "n_rows")).alias("_first"))
    first = materialize(first.select("_first.*"), "first-rows")
    own_digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(row.alias("_row"), F.col(key).cast("long").alias("_id"), own_digest.alias("_digest"))
    kept = rows.join(first, (F.col("_id") == F.col("id")) & (F.col("_digest") == F.col("digest")))
    once = kept.filter("n_rows = 1").select("_row")
    if not first.filter("n_rows > 1").isEmpty():
        again = kept.filter("n_rows > 1").dropDuplicates(["_id", "_digest"]).select("_row")
        once = once.unionByName(again)
    once = once.unionByName(rows.filter("_id is null").select("_row"))
    return once.select(*[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
