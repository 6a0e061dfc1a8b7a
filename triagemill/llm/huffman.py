"""Token ids as a compact binary file: canonical length-limited Huffman code, blocks, checkpoints.

A file is a sequence of frames, one binary value each, in ascending document order; a frame
holds whole documents. Layout of a frame, all integers little-endian:

    magic "HUF1" | u32 documents | u32 ids | u32 checkpoint step | u64 payload bytes
    u32 ids of each document | u64 bit offset of every ``step``-th id | payload

Bits fill 64-bit words from the highest down. The code book is the length in bits of each id
(u8, 0: id not in use), stored in a table beside the frames; codes follow from the lengths in
canonical order (length, then id).
Blocks between two checkpoints can be decoded on their own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.llm.packing import tokenized, with_global_start
from triagemill.llm.tokens import encoder
from triagemill.session import new_table_path

MAX_BITS = 18
STEP = 256
FRAME_IDS = 1 << 18
_HEAD = struct.Struct("<4sIIIQ")
_MAGIC = b"HUF1"


# --- the code -------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for counts of 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError("max_bits is too small for the ids in use")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    # per level: which of the merged, sorted items are leaves
    is_leaf, merged = [], leaves
    is_leaf.append(np.ones(len(leaves), bool))
    for _ in range(max_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        is_leaf.append(rank < len(leaves))
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for level in reversed(is_leaf):
        n_leaves = int(level[:take].sum())
        depth[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: consecutive numbers in the order (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        # left-aligned to the longest code, each code takes up 2 ** (longest - length) numbers
        longest = int(lengths[order[-1]])
        span = np.left_shift(np.uint64(1), (longest - lengths[order]).astype(np.uint64))
        before = np.cumsum(span) - span
        codes[order] = np.right_shift(before, (longest - lengths[order]).astype(np.uint64))
    return codes


def decode_table(lengths: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each ``max_bits``-bit prefix."""
    ids, bits = np.zeros(1 << max_bits, np.int32), np.zeros(1 << max_bits, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.left_shift(1, max_bits - lengths[order].astype(np.int64))
    ids[: span.sum()] = np.repeat(order, span)
    bits[: span.sum()] = np.repeat(lengths[order], span)
    return ids, bits


# --- frames ---------------------------------------------------------------------------------


def encode_frame(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate(docs) if docs else np.empty(0, np.int64)
    size = lengths[ids].astype(np.int64)
    if len(ids) and not size.all():
        raise ValueError("an id has no code")
    at = np.cumsum(size) - size
    n_bits = int(size.sum())
    words = np.zeros(n_bits // 64 + 2, np.uint64)
    if len(ids):
        word, free = at >> 6, 64 - (at & 63) - size  # bits left in the word behind the code
        code = codes[ids]
        high = np.where(
            free >= 0,
            code << np.maximum(free, 0).astype(np.uint64),
            code >> np.maximum(-free, 0).astype(np.uint64),
        )
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(free < 0)  # at most one code crosses the end of a word
        words[word[over] + 1] |= code[over] << (64 + free[over]).astype(np.uint64)
    payload = words[: (n_bits + 63) // 64].astype(">u8").tobytes()
    head = _HEAD.pack(_MAGIC, len(docs), len(ids), STEP, len(payload))
    sizes = np.fromiter((len(d) for d in docs), "<u4", len(docs))
    return b"".join([head, sizes.tobytes(), at[::STEP].astype("<u8").tobytes(), payload])


def decode_frame(frame: bytes, table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Ids of each document; all blocks of the frame advance together, an id a step."""
    magic, n_docs, n_ids, step, n_bytes = _HEAD.unpack_from(frame)
    if magic != _MAGIC:
        raise ValueError("not a frame")
    n_blocks = -(-n_ids // step)
    sizes = np.frombuffer(frame, "<u4", n_docs, _HEAD.size).astype(np.int64)
    at = np.frombuffer(frame, "<u8", n_blocks, _HEAD.size + 4 * n_docs).astype(np.int64)
    start = _HEAD.size + 4 * n_docs + 8 * n_blocks
    if len(frame) != start + n_bytes:
        raise ValueError("a frame is cut short")
    words = np.frombuffer(frame, ">u8", n_bytes // 8, start).astype(np.uint64)
    words = np.concatenate([words, np.zeros(2, np.uint64)])
    of, bits = table
    drop = np.uint64(64 - (len(of).bit_length() - 1))
    out = np.zeros((step, n_blocks), np.int32)
    for i in range(min(step, n_ids)):
        if i == n_ids - (n_blocks - 1) * step and n_blocks > 1:  # the last block has ended
            at = at[:-1]
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        low = (words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - shift)
        prefix = ((words[word] << shift) | low) >> drop
        out[i, : len(at)] = of[prefix]
        at = at + bits[prefix]
    ids = out.T.reshape(-1)[:n_ids]
    return np.split(ids, np.cumsum(sizes)[:-1]) if n_docs else []


# --- the operator ---------------------------------------------------------------------------


def id_counts(counted: DataFrame) -> DataFrame:
    """id, n over the count rows of ``tokenized`` data, one for each task that wrote some."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                total = np.frombuffer(raw.as_buffer(), "<i8")
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"]
                )

    return counted.select("ids").mapInArrow(spread, "id int, n long").groupBy("id").agg(
        F.sum("n").alias("n")
    )


def code_book(counts: DataFrame, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths by id. One row for each id in use reaches the driver: the vocabulary at most."""
    rows = counts.toPandas()
    if rows.empty:
        return np.zeros(1, np.uint8)
    dense = np.zeros(int(rows["id"].max()) + 1, np.int64)
    dense[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return code_lengths(dense, max_bits)


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> str:
    """Write all texts' ids in ascending ``key`` order to the folder ``path``, and return it.

    The folder, a new one among the intermediate tables if none is named, must not exist. It is all
    that ``read_ids`` needs, in any session: ``frames``, a Parquet table with part (number of the
    file), part_start (ids before the frame in its file), n_ids, doc_ids (array) and frame; and
    ``book``, a table of one row with the code: max_bits, and lengths, a byte for each id from 0 on.

    Texts are range-partitioned by key and tokenized once, so a file is one range; their ids are
    stored, counted on the way, and encoded in stored order. Memory is bounded by a frame or the
    longest text. All is stored through Spark's writer, which commits whole tasks only. Null texts
    count as empty and hold ``end_id``; null keys come first; rows with equal keys are each written;
    other columns are ignored; an empty table gives no frame.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    in_order = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    spark = docs.sparkSession
    path = path or new_table_path(spark, "id-files")
    ids = tokenized(in_order, tokenizer, end_id, counted=True)
    ids_path = new_table_path(spark, "ids")
    ids.write.option("compression", "zstd").parquet(ids_path)
    every = spark.read.schema(ids.schema).parquet(ids_path)
    stored = every.filter("n_ids is not null")
    dtype = encoder(tokenizer).dtype
    lengths = code_book(id_counts(every.filter("n_ids is null")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        part, start, held = None, 0, 0  # of the frame that is being filled
        own: list[np.ndarray] = []
        keys: list = []
        key_type = pa.null()

        def frame() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([keys], pa.list_(key_type)),
                    pa.array([encode_frame(own, lengths, codes)], pa.binary()),
                ],
                names=["part", "part_start", "n_ids", "doc_ids", "frame"],
            )

        for batch in batches:
            key_type = batch.schema.field(2).type
            for row_part, row_start, row_key, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if own and (held >= FRAME_IDS or (row_part, row_start) != (part, start + held)):
                    yield frame()
                    own, keys = [], []
                if not own:
                    part, start, held = row_part, row_start, 0
                own.append(np.frombuffer(raw, dtype))
                keys.append(row_key)
                held += len(own[-1])
        if own:
            yield frame()

    frames = stored.select("part", "part_start", "doc_id", "ids").mapInArrow(
        encode, f"part int, part_start long, n_ids long, doc_ids array<{kind}>, frame binary"
    )
    frames.write.mode("errorifexists").parquet(f"{path}/frames")
    book = spark.createDataFrame(
        [(MAX_BITS, bytearray(lengths.tobytes()))], "max_bits int, lengths binary"
    )
    book.coalesce(1).write.mode("errorifexists").parquet(f"{path}/book")
    return path


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document in the folder ``path``.

    ``start`` counts the ids of all documents before it in the files' order. The code is read from
    the folder too: one row, of as many bytes as the vocabulary has ids.
    """
    book = spark.read.parquet(f"{path}/book").first()
    lengths, max_bits = np.frombuffer(bytes(book["lengths"]), np.uint8), book["max_bits"]
    frames = spark.read.parquet(f"{path}/frames")
    kind = frames.schema["doc_ids"].dataType.elementType.simpleString()
    placed = with_global_start(frames)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, max_bits)
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(0)[i].values
                ids = decode_frame(batch.column(1)[i].as_py(), table)
                size = np.fromiter((len(x) for x in ids), np.int64, len(ids))
                start = batch.column(2)[i].as_py() + np.cumsum(size) - size
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                arrays = [keys, pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return placed.select("doc_ids", "frame", "start").mapInArrow(
        decode,
        f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids,
    )
