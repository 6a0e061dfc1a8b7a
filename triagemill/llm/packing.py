"""Concatenate and cut: documents become one id stream that is cut into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagemill.llm.tokens import encoder, text_slices
from triagemill.session import materialize


def tokenized(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    counted: bool = False,
) -> DataFrame:
    """part, part_start, doc_id, n_ids, ids: each text's ids, then ``end_id``, as bytes.

    ``part`` is the task that made the row and ``part_start`` the ids of the rows before it
    there. Ids are little-endian, two bytes wide where the vocabulary allows it, else four.
    ``counted`` adds a row for each task that had any, without ``n_ids``: its ``ids`` hold how often
    each id occurs there, as little-endian longs from id 0 on.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        part, start = TaskContext.get().partitionId(), 0
        total, kind = np.zeros(enc.vocab_size, np.int64), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for keys, texts in text_slices(batch):
                ids = [enc.encode(t) + end for t in texts]
                if counted:
                    flat = np.frombuffer(b"".join(ids), enc.dtype)
                    total += np.bincount(flat, minlength=len(total))
                sizes = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(starts),
                        pa.array(keys, batch.schema.field(0).type),
                        pa.array(sizes),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["part", "part_start", "doc_id", "n_ids", "ids"],
                )
        if counted and start:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([start]),
                    pa.nulls(1, kind),
                    pa.nulls(1, pa.int64()),
                    pa.array([total.astype("<i8").tobytes()], pa.binary()),
                ],
                names=["part", "part_start", "doc_id", "n_ids", "ids"],
            )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        encode, f"part int, part_start long, doc_id {kind}, n_ids long, ids binary"
    )


def with_global_start(stored: DataFrame, size: str = "n_ids") -> DataFrame:
    """Add ``start``: ids before a row in the order (part, part_start).

    ``stored`` must be written data. Its per-part totals, one row for each task that wrote it,
    are summed up in a first pass and joined back by broadcast; no row is shuffled.
    """
    totals = stored.groupBy("part").agg(F.sum(size).alias("_ids"))
    before = totals.select(
        F.col("part").alias("_part"),
        (F.sum("_ids").over(Window.orderBy("part")) - F.col("_ids")).alias("_before"),
    )
    joined = stored.join(F.broadcast(before), F.col("part") == F.col("_part"))
    return joined.select(
        *[F.col(c) for c in stored.columns],
        (F.col("_before") + F.col("part_start")).alias("start"),
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = 2048,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids; only the last one may be shorter.

    Per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (in the sequence), ``boundary``, the kind of record ('whole', 'head',
    'middle' or 'tail' of its document), and with ``with_ids`` the ids (array<int>). The first pass tokenizes and
    writes ids with their task's running totals; the second adds each task's global offset and
    cuts at the multiples of ``window``. A document's place depends on file order only.
    Null texts count as empty and hold ``end_id`` alone; repeated rows and null keys are packed
    like any other; other columns are ignored; an empty table gives an empty result.
    """
    if window < 1:
        raise ValueError("window must be positive")
    stored = with_global_start(materialize(tokenized(docs, tokenizer, end_id, key, text), "tokens"))
    kind = stored.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _pieces(part, dtype, window, with_ids)

    return stored.select("doc_id", "start", "ids").mapInArrow(
        cut,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, boundary string" + ", ids array<int>" * with_ids,
    )


def _pieces(
    rows: pa.RecordBatch, dtype: np.dtype, window: int, with_ids: bool
) -> pa.RecordBatch:
    out: list[tuple] = []
    ids_of: list[np.ndarray] = []
    for doc, first, raw in zip(*(rows.column(i).to_pylist() for i in range(3))):
        ids = np.frombuffer(raw, dtype).astype("<u4")
        last = first + len(ids)
        cuts = range((first // window + 1) * window, last, window)
        edges = [first, *cuts, last]
        for a, b in zip(edges, edges[1:]):
            own = ids[a - first : b - first]
            kind = ("whole" if b == last else "head") if a == first else ("tail" if b == last else "middle")
            crc = zlib.crc32(own.tobytes())
            out.append((doc, a - first, b - a, crc, len(ids), a // window, a % window, kind))
            ids_of.append(own)
    columns = list(zip(*out)) or [()] * 8
    kinds = [rows.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    names = "doc_id start length ids_crc32 doc_tokens sequence_id offset boundary".split()
    if with_ids:
        sizes = np.fromiter((len(x) for x in ids_of), np.int32, len(ids_of))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.concatenate(ids_of).astype(np.int32) if ids_of else np.empty(0, np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names)
