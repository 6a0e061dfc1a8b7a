"""Token counts of whole texts; huge texts by overlapping chunks that are resynchronised."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.llm.tokens import count_spliced, encoder, text_slices

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int,
    key: str | Column = "doc_id",
    text: str | Column = "text",
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit, n_splices, n_widened.

    ``tokenizer`` is the path of a tokenizer file that every executor can open. Texts of more
    than ``chunk`` characters are encoded as overlapping chunks with offsets and spliced at
    stable boundaries (``count_spliced``), so memory for encodings does not grow with a text.
    Nothing is shuffled. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and null
    keys give a row each; other columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    if overlap < 3 or overlap >= chunk:
        raise ValueError("overlap must be at least 3 and below chunk")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for keys, texts in text_slices(batch):
                found = [
                    count_spliced(enc.tokenizer, t, chunk, overlap)
                    if len(t) > chunk
                    else (len(enc.ids(t)), 0, 0)
                    for t in texts
                ]
                n_tokens, n_splices, n_widened = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, batch.schema.field(0).type),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(n_tokens, pa.int64()),
                        pa.array([n > limit for n in n_tokens], pa.bool_()),
                        pa.array(n_splices, pa.int64()),
                        pa.array(n_widened, pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_splices", "n_widened"],
                )

    rows = docs.select(_col(key).alias("doc_id"), _col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        count,
        f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_splices long, "
        "n_widened long",
    )


def _col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name
