"""Records of CSV files whose quoted fields may hold newlines, read in parts of any file.

Spark's text reader deals out byte ranges and gives each line to the range that it starts in. Whether
a range begins inside quotes depends on all quotes before it, so

1. a first pass leaves one row for each range: whether it holds an odd number of quotes (a doubled
   quote changes nothing), and for the first range of a file its first records;
2. a running count over the ranges of a file says in which state each of them begins;
3. a second pass cuts every range into records. What is left of a record at the end of a range is
   put together with the beginnings of the ranges behind it; only such pieces are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = 3  # first records of a file that the first pass brings along, its header among them


def read_lines(spark: SparkSession, sources: list[str]) -> DataFrame:
    """file, range, line of all lines, as they are between two newlines."""
    try:
        text = spark.read.option("lineSep", "\n").text(sources)
    except AnalysisException as exc:
        raise FileNotFoundError(f"Cannot read {sources}") from exc
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.col("value").alias("line"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of batches that are of one range, under (file, range)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, ranges = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(ranges) != 0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            yield (part.column(0)[0].as_py(), part.column(1)[0].as_py()), part


def _open_after(lines: pa.Array, open_: bool) -> np.ndarray:
    """Whether quotes are open after each line."""
    quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
    return (np.cumsum(quotes) + open_) % 2 == 1


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, open_, first, held = None, False, [], []
    for own, part in _runs(batches):
        if own != at:
            if at is not None:
                yield _survey_row(at, open_, first)
            at, open_, first, held = own, False, [], []
        lines = part.column(2)
        after = _open_after(lines, open_)
        if at[1] == 0 and len(first) < SAMPLE:
            for line, inside in zip(lines, after):
                held.append(line.as_py())
                if not inside:
                    record = _finished("\n".join(held), first=not first)
                    if record:
                        first.append(record)
                    held = []
                    if len(first) == SAMPLE:
                        break
        open_ = bool(after[-1])
    if at is not None:
        yield _survey_row(at, open_, first)


def _survey_row(at: tuple, odd: bool, first: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([odd]), pa.array([first], pa.list_(pa.string()))],
        names=["file", "range", "odd", "first"],
    )


def _finished(record: str, first: bool) -> str:
    """A record without the byte-order mark of its file and the end of a line in other style."""
    if first:
        record = record.removeprefix("﻿")
    return record.removesuffix("\r")


def survey(lines: DataFrame) -> DataFrame:
    """file, range, opens (inside quotes), first (first records of the file, on its first range).

    One row for each byte range.
    """
    found = lines.mapInArrow(_surveyed, "file string, range long, odd boolean, first array<string>")
    order = Window.partitionBy("file").orderBy("range")
    before = F.sum(F.col("odd").cast("int")).over(order) - F.col("odd").cast("int")
    return found.select("file", "range", (before % 2 == 1).alias("opens"), "first")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, range, kind, no, record: whole records; 'tail' of one begun before; 'head' of one not ended."""
    at, open_, begun, kept, leading, no = None, False, False, [], True, 0
    for own, part in _runs(batches):
        if own != at:
            if kept:
                yield _cut_rows(at, "head" if begun else "tail", no, ["\n".join(kept)])
            at, open_, kept, leading, no = own, part.column(3)[0].as_py(), [], own[1] == 0, 0
            begun = not open_
        lines = part.column(2)
        after = _open_after(lines, open_)
        ends = np.flatnonzero(~after)
        texts = lines.to_pylist()
        start, done = 0, []
        for end in ends.tolist():
            kept.extend(texts[start : end + 1])
            record = "\n".join(kept) if len(kept) > 1 else kept[0]
            kept, start = [], end + 1
            if not begun:  # the end of a record of an earlier range
                yield _cut_rows(at, "tail", no, [record])
                begun = True
                no += 1
                continue
            record = _finished(record, first=leading)
            if record:
                if leading:  # the header
                    leading = False
                else:
                    done.append(record)
        kept.extend(texts[start:])
        open_ = bool(after[-1])
        if done:
            yield _cut_rows(at, "whole", no, done)
            no += 1
    if kept:
        yield _cut_rows(at, "head" if begun else "tail", no, ["\n".join(kept)])


def _cut_rows(at: tuple, kind: str, no: int, records: list[str]) -> pa.RecordBatch:
    n = len(records)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([at[0]] * n), pa.array([at[1]] * n, pa.int64()), pa.array([kind] * n),
            pa.array([no] * n, pa.int64()), pa.array(records, pa.string()),
        ],
        names=["file", "range", "kind", "no", "record"],
    )


def csv_records(lines: DataFrame, surveyed: DataFrame) -> DataFrame:
    """file, record (text) of all records but each file's first one, the header.

    ``surveyed`` must be written data of ``lines``; it has one row for each byte range, so it goes to
    all tasks. Blank lines between records are none.
    """
    known = surveyed.select(F.col("file").alias("_file"), F.col("range").alias("_range"), "opens")
    stated = lines.join(
        F.broadcast(known), (F.col("file") == F.col("_file")) & (F.col("range") == F.col("_range")), "left"
    ).select(
        "file", "range", "line",
        F.coalesce("opens", F.raise_error("a byte range was not surveyed").cast("boolean")).alias("opens"),
    )
    schema = "file string, range long, kind string, no long, record string"
    cut = stated.mapInArrow(_cut, schema)
    # pieces of records that cross ranges: two for each range at most
    order = Window.partitionBy("file").orderBy("range", "no")
    pieces = cut.filter("kind <> 'whole'").withColumn(
        "_of", F.sum((F.col("kind") == "head").cast("int")).over(order)
    )
    joined = pieces.groupBy("file", "_of").agg(
        F.sort_array(F.collect_list(F.struct("range", "no", "record"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    whole = F.regexp_replace(text, "\r$", "")
    return cut.filter("kind = 'whole'").select("file", "record").unionByName(
        joined.select("file", whole.alias("record"))
    )
