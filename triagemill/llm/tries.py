"""Conversation prefix trie by truncation peeling.

1. Every conversation becomes a path: 16 bytes of digest and 8 of size for each turn. Turns are
   range-partitioned by conversation and order, so a conversation with very many turns is packed
   by several tasks, and its pieces are joined afterwards.
2. Paths are range-partitioned in their own order, so the members of a node are neighbours. A chunk
   of neighbouring paths is peeled: from its greatest depth down, conversations that end at a depth
   meet the surviving nodes of the depth below, all are regrouped by prefix, each group is a node and
   is summed up there and then, and with its last turn stripped it survives to the next depth.
3. Only nodes on the first or the last path of a chunk can have members elsewhere. What such a node
   has got in its chunk travels on with that path, two paths for each chunk, and is peeled in the
   next round with those of the other chunks, until all are one chunk.

Memory is bounded by a chunk or by the longest conversation's path, and rows that move between
rounds by the number of chunks. A group of equal conversations is many rows of many chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagemill.operators.skew import attach_facts
from triagemill.session import materialize

TURN_BYTES = 16
SIZE_BYTES = 8
CHUNK_TURNS = 1 << 16
CHUNK_ITEMS = 8  # a chunk has as many paths at least, however long, so that rounds end
SLAB_BITS = 10  # conversations whose ids agree above these bits are listed together
_NONE = np.iinfo(np.int64).max
_FIELDS = 5  # members, least member, children, leaves, saved

_PEELED = (
    "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, path binary, sizes binary, own binary"
)


# --- paths ----------------------------------------------------------------------------------


def conversation_paths(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """conv_id, path, sizes of every conversation, written to the shared folder.

    ``path`` holds a digest of role and text for each turn, ``sizes`` the UTF-8 bytes of its text
    (little-endian longs). Turns are ordered by ``turn``, null first; ties by digest, so repeated
    rows are turns of their own and no other order is promised. Null roles and texts are empty.
    Rows without an integer conversation id take no part. Other columns are ignored.
    """
    own_role = F.coalesce(F.col(role).cast("string"), F.lit(""))
    own_text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = F.concat(F.octet_length(own_role).cast("string"), F.lit(":"), own_role, own_text)
    turns = conversations.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.unhex(F.md5(named.cast("binary"))).alias("digest"),
        F.octet_length(own_text).cast("long").alias("size"),
    ).filter("conv_id is not null")
    turns = materialize(turns, "turns")
    order = ["conv_id", "turn", "digest"]
    pieces = (
        turns.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "digest", "size")
        .mapInArrow(_pack, "conv_id long, part int, no int, path binary, sizes binary")
    )
    # a conversation has a piece for each task and batch that held some of it
    gathered = pieces.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "no", "path", "sizes"))).alias("pieces")
    )
    return materialize(
        gathered.select("conv_id", _joined("path").alias("path"), _joined("sizes").alias("sizes")),
        "paths",
    )


def _joined(field: str):
    return F.aggregate(
        "pieces", F.lit("").cast("binary"), lambda so_far, piece: F.concat(so_far, piece[field])
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, no = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        digests = b"".join(batch.column(1).to_pylist())
        sizes = batch.column(2).to_numpy().astype("<i8").tobytes()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        runs = list(zip(cuts, cuts[1:]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[cuts[:-1]]),
                pa.array(np.full(len(runs), part, np.int32)),
                pa.array(np.full(len(runs), no, np.int32)),
                pa.array([digests[a * TURN_BYTES : b * TURN_BYTES] for a, b in runs], pa.binary()),
                pa.array([sizes[a * SIZE_BYTES : b * SIZE_BYTES] for a, b in runs], pa.binary()),
            ],
            names=["conv_id", "part", "no", "path", "sizes"],
        )
        no += 1


def forked_paths(paths: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """``paths`` rebuilt so that neighbouring conversations share their first turns.

    Conversation c gets the first h turns of conversation c - c % ``every`` (all if it has fewer,
    none if there is no such conversation), then its own turns after its first h, where h is the
    unsigned crc32 of c in decimal modulo ``most``.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = paths.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_base"),
        F.expr(f"substring(path, 1, {(most - 1) * TURN_BYTES})").alias("_path"),
        F.expr(f"substring(sizes, 1, {(most - 1) * SIZE_BYTES})").alias("_sizes"),
    )
    shared = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")

    def rebuilt(column: str, width: int) -> str:
        return (
            f"concat(coalesce(substring(_{column}, 1, _h * {width}), cast('' as binary)), "
            f"substring({column}, _h * {width} + 1))"
        )

    joined = paths.withColumn("_h", shared).join(heads, base == F.col("_base"), "left")
    return joined.select(
        "conv_id",
        F.expr(rebuilt("path", TURN_BYTES)).alias("path"),
        F.expr(rebuilt("sizes", SIZE_BYTES)).alias("sizes"),
    )


# --- peeling --------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def prefix_keys(paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys (two columns) of all prefixes of all paths but the empty one, and their number.

    A key is the sum of mixes of each turn's digest with its place, so that one running sum gives
    the keys of all prefixes. The empty prefix has the key zero.
    """
    lengths = np.fromiter((len(p) // TURN_BYTES for p in paths), np.int64, len(paths))
    digests = np.frombuffer(b"".join(paths), "<u8").reshape(-1, 2)
    begin = np.cumsum(lengths) - lengths
    place = (np.arange(len(digests)) - np.repeat(begin, lengths) + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        low = _mixed(digests[:, 0] + place * np.uint64(0xBF58476D1CE4E5B9))
        high = _mixed(digests[:, 1] + _mixed(low ^ place))
        total = np.zeros((len(digests) + 1, 2), np.uint64)
        np.cumsum(np.stack([low, high], axis=1), axis=0, out=total[1:])
        keys = total[1:] - np.repeat(total[begin], lengths, axis=0)
    return keys, lengths


def peel(
    paths: list[bytes],
    sizes: list[bytes],
    convs: np.ndarray,
    own: list[bytes | None],
    last: bool,
) -> tuple[dict[str, np.ndarray], list[tuple[bytes, bytes, bytes]]]:
    """Nodes of sorted ``paths``; and, unless ``last``, what is left for the next round.

    A path is a conversation, or (``own``) carries for each depth what its node has got so far:
    members, least member, children, leaves and saved bytes. What is left are at most two paths of
    that kind, the first and the last, with all they hold themselves and got from other branches.
    """
    keys, lengths = prefix_keys(paths)
    begin = np.cumsum(lengths) - lengths
    size = np.frombuffer(b"".join(sizes), "<i8")
    item, depth, values = _entries(lengths, convs, own)
    by_depth = np.argsort(-depth, kind="stable")
    item, depth, values = item[by_depth], depth[by_depth], values[by_depth]
    top = int(depth[0])
    edges = [] if last else ([0] if len(paths) == 1 else [0, len(paths) - 1])
    rest = {e: np.zeros((int(lengths[e]) + 1, _FIELDS), np.int64) for e in edges}
    for kept in rest.values():
        kept[:, 1] = _NONE
    out: list[tuple] = []
    alive = np.empty(0, np.int64)  # a path through each surviving node, one turn deeper
    got = np.empty((0, _FIELDS), np.int64)
    waiting = None  # the surviving nodes' own rows, without their parents
    at = 0
    for d in range(top, -1, -1):
        upto = at + int(np.searchsorted(-depth[at:], -d, "right"))
        every = np.concatenate([alive, item[at:upto]])
        held = np.concatenate([got, values[at:upto]])
        at = upto
        order = np.argsort(every, kind="stable")
        every, held = every[order], held[order]
        here = keys[begin[every] + d - 1] if d else np.zeros((len(every), 2), np.uint64)
        new = np.ones(len(every), bool)
        new[1:] = (here[1:] != here[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        total = np.add.reduceat(held, starts, axis=0)
        total[:, 1] = np.minimum.reduceat(held[:, 1], starts)
        node, key = every[starts], here[starts]
        edge = np.full(len(starts), -1, np.int64)
        for e in edges[::-1]:  # the first path takes what both have in common
            if lengths[e] >= d:
                mine = keys[begin[e] + d - 1] if d else np.zeros(2, np.uint64)
                edge[(key == mine).all(axis=1)] = e
        whole = edge < 0
        if waiting is not None:
            group = np.empty(len(every), np.int64)
            group[order] = np.cumsum(new) - 1
            above = group[: len(alive)]
            out.append((*waiting, key[above], np.where(whole[above], total[above, 1], _NONE)))
        for i in np.flatnonzero(~whole).tolist():
            rest[edge[i]][d] = total[i]
        node, total, key = node[whole], total[whole], key[whole]
        leaf = total[:, 2] == 0
        total[leaf, 3] = 1
        if d:
            total[:, 4] += (total[:, 0] - 1) * size[begin[node] + d - 1]
        waiting = (key, np.full(len(node), d, np.int64), total)
        alive, got = node, total.copy()
        got[:, 2] = 1
    if last:
        no_parent = np.zeros((len(alive), 2), np.uint64), np.full(len(alive), _NONE)
        out.append((*waiting, *no_parent))
    return _node_rows(out), [(paths[e], sizes[e], rest[e].tobytes()) for e in edges]


def _entries(lengths: np.ndarray, convs: np.ndarray, own: list[bytes | None]):
    """What each path brings in, and at which depth."""
    ends = np.flatnonzero([o is None for o in own])
    held = np.zeros((len(ends), _FIELDS), np.int64)
    held[:, 0], held[:, 1] = 1, convs[ends]
    items, depths, values = [ends], [lengths[ends]], [held]
    for i, o in enumerate(own):
        if o is not None:
            values.append(np.frombuffer(o, np.int64).reshape(-1, _FIELDS))
            items.append(np.full(len(values[-1]), i))
            depths.append(np.arange(len(values[-1])))
    return np.concatenate(items), np.concatenate(depths), np.concatenate(values)


def _node_rows(levels: list[tuple]) -> dict[str, np.ndarray]:
    if not levels:
        levels = [(np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros((0, _FIELDS), np.int64), np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))]
    key, depth, total, parent, parent_conv = (np.concatenate(x) for x in zip(*levels))
    return {
        "key": key, "parent": parent, "conv_id": total[:, 1], "depth": depth,
        "parent_conv_id": parent_conv, "n_convs": total[:, 0], "n_children": total[:, 2],
        "n_leaves": total[:, 3], "saved_tokens": total[:, 4],
    }


def _fixed(keys: np.ndarray) -> pa.Array:
    """Rows of two unsigned longs as 16-byte values."""
    raw = pa.py_buffer(np.ascontiguousarray(keys).tobytes())
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(TURN_BYTES), len(keys), [None, raw])
    return fixed.cast(pa.binary())


def _chunks(batches: Iterator[pa.RecordBatch], last: bool, most: int) -> Iterator[list[tuple]]:
    """Rows (path, sizes, own, conv_id), about ``most`` turns and ``CHUNK_ITEMS`` rows or more."""
    rows, turns = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            turns += len(row[0]) // TURN_BYTES + 1
            if not last and turns >= most and len(rows) >= CHUNK_ITEMS:
                yield rows
                rows, turns = [], 0
    if rows:
        yield rows


def _peeled(last: bool, most: int):
    def peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, last, most):
            paths, sizes, own, convs = (list(c) for c in zip(*rows))
            ids = np.array([_NONE if c is None else c for c in convs], np.int64)
            nodes, left = peel(paths, sizes, ids, own, last)
            n = len(nodes["depth"])
            longs = [nodes[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
            longs = [pa.array(c, pa.int64(), mask=(c == _NONE)) for c in longs]
            arrays = [_fixed(nodes["key"]), _fixed(nodes["parent"]), *longs, *[pa.nulls(n, pa.binary())] * 3]
            names = [c.split()[0] for c in _PEELED.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            if left:
                some = [pa.array(c, pa.binary()) for c in zip(*left)]
                empty = [pa.nulls(len(left), t) for t in [pa.binary()] * 2 + [pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([*empty, *some], names=names)

    return peeled


# --- members that end at a node -------------------------------------------------------------


def _end_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        for at in range(0, len(paths), 1024):
            keys, lengths = prefix_keys(paths[at : at + 1024])
            ends = np.zeros((len(lengths), 2), np.uint64)
            some = lengths > 0
            ends[some] = keys[np.cumsum(lengths)[some] - 1]
            yield pa.RecordBatch.from_arrays(
                [_fixed(ends), batch.column(1).slice(at, 1024)], names=["key", "conv_id"]
            )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 from lists of ids, sorted by key and then by id; one digest is open."""
    key, digest = None, None
    for batch in batches:
        keys, found = [], []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                keys.append(key)
                found.append(digest.hexdigest())
            key, digest = own, hashlib.sha256(ids.encode())
        yield _ends(keys, found)
    if key is not None:
        yield _ends([key], [digest.hexdigest()])


def _ends(keys: list, found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"]
    )


def end_hashes(paths: DataFrame) -> DataFrame:
    """key, ends_sha256 of every node at which a conversation ends.

    Ids are listed in slabs of 1024 neighbouring ones first, by as many tasks as there are; the
    digest of a node then reads its lists one after another.
    """
    ended = paths.select("path", "conv_id").mapInArrow(_end_keys, "key binary, conv_id long")
    ids = F.sort_array(F.collect_list("conv_id")).cast("array<string>")
    lists = ended.groupBy("key", F.shiftright("conv_id", SLAB_BITS).alias("slab")).agg(
        F.array_join(ids, ",").alias("ids")
    )
    in_order = lists.repartition("key").sortWithinPartitions("key", "slab").select("key", "ids")
    return in_order.mapInArrow(_hashed, "key binary, ends_sha256 string")


# --- the operator ---------------------------------------------------------------------------


def prefix_trie(paths: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row for each distinct sequence of first turns of ``paths`` (``conversation_paths``).

    conv_id: smallest member (a conversation that starts with the sequence), depth, parent_conv_id
    (null for the root), n_convs: members, n_children, n_leaves: childless nodes in the subtree,
    saved_tokens: over the subtree, members but one times bytes of the last text; ends_sha256 of the
    ids, ascending and joined by commas, of the members that end there. The root has depth 0 and no
    text; a conversation without turns ends there. No conversation gives no node.
    """
    paths = materialize(paths, "trie-paths")
    items = paths.select("path", "sizes", F.lit(None).cast("binary").alias("own"), "conv_id")
    nodes, last = [], False
    while not last:
        if nodes:
            turns = items.agg(F.sum(F.octet_length("path") / TURN_BYTES + 1)).first()[0] or 0
            last = turns <= chunk_turns
        if last:
            laid = items.coalesce(1).sortWithinPartitions("path")
        else:
            laid = items.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
        peeled = materialize(laid.mapInArrow(_peeled(last, chunk_turns), _PEELED), "peeled")
        nodes.append(peeled.filter("depth is not null").drop("path", "sizes", "own"))
        items = peeled.filter("depth is null").select("path", "sizes", "own", "conv_id")
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    # a parent that was finished in a later round: a third of all nodes may have the same one
    late = nodes[1]
    for more in nodes[2:]:
        late = late.unionByName(more)
    facts = late.select(
        F.hex("key").alias("parent_hex"), F.col("conv_id").alias("_late"), F.col("n_children").alias("_n")
    ).filter("_n > 0")
    open_rows = every.filter("parent_conv_id is null and depth > 0")
    found = attach_facts(
        open_rows.withColumn("parent_hex", F.hex("parent")), facts, "parent_hex", "_n", F.col("key")
    )
    found = found.withColumn("parent_conv_id", F.col("_late")).select(*every.columns)
    done = every.filter("parent_conv_id is not null or depth = 0").unionByName(found)
    ends = end_hashes(paths).select(F.col("key").alias("_key"), "ends_sha256")
    empty = hashlib.sha256(b"").hexdigest()
    return done.join(ends, F.col("key") == F.col("_key"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
