"""Report exports: CSV scan and CSV / JSON sinks."""

from __future__ import annotations

import csv
import io
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.constants import CORE_ALIASES
from triagemill.session import materialize
from triagemill.sources.records import SAMPLE, csv_records, read_lines, survey
from triagemill.sources.schema import require_mapping

_RECORD = {
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "mode": "FAILFAST",
    "maxCharsPerColumn": "-1",
    "maxColumns": "100000",
}


def resolve_sources(
    spark: SparkSession, path: str | None = None, paths: list[str] | None = None,
    glob: str | None = None,
) -> list[str]:
    """Sorted source paths from exactly one of a path, a list or a glob."""
    given = [x for x in (path, paths, glob) if x]
    if len(given) != 1:
        raise ValueError("Give exactly one of path, paths or glob")
    if path:
        return [path]
    if paths:
        return sorted(paths)
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(glob)
    fs = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = sorted(s.getPath().toString() for s in fs.globStatus(pattern) or [])
    if not found:
        raise FileNotFoundError(f"No source matches {glob}")
    return found


def _header_names(record: str) -> list[str]:
    """Column names of a header record; empty and repeated ones get their position."""
    names = next(csv.reader(io.StringIO(record, newline="")))
    seen = Counter(n.lower() for n in names)
    return [
        f"_c{i}" if not n else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(names)
    ]


def _plain_path(path: Column) -> Column:
    """A path without scheme and authority."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _source_of(files: DataFrame, sources: list[str]) -> DataFrame:
    """file, source_file: last part of the source that names the file or a folder above it."""
    given = files.sparkSession.createDataFrame([(s.rstrip("/"),) for s in sources], "source string")
    given = given.select(
        _plain_path(F.col("source")).alias("_up"),
        F.element_at(F.split("source", "/"), -1).alias("source_file"),
    )
    # metadata paths are URL-encoded, but for the plus sign
    decoded = F.url_decode(F.regexp_replace("file", r"\+", "%2B"))
    parts = F.split(_plain_path(decoded), "/")
    above = F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    found = files.select("file", F.explode(above).alias("_up")).join(given, "_up")
    return found.groupBy("file").agg(F.max_by("source_file", F.length("_up")).alias("source_file"))


@dataclass(frozen=True)
class Exports:
    """Files of one reading: their lines, the written survey of their ranges, and their headers."""

    lines: DataFrame
    surveyed: DataFrame
    headers: dict[str, list[str]]  # column names by header record


def open_exports(spark: SparkSession, sources: list[str]) -> Exports:
    """Survey all ranges of all files in one job. Different headers come to the driver, not files."""
    lines = read_lines(spark, sources)
    surveyed = materialize(survey(lines), "csv-ranges")
    first = surveyed.filter("range = 0")
    if first.filter("size(first) = 0").head(1):
        raise FileNotFoundError("Cannot read a header: a source is empty or its header never ends")
    headers = [r["header"] for r in first.select(F.col("first")[0].alias("header")).distinct().collect()]
    return Exports(lines, surveyed, {h: _header_names(h) for h in sorted(headers)})


def _fields(record: Column, width: Column, widths: list[int]) -> Column:
    """Fields of a record as an array; a record of another width than its header's is an error."""
    out = F.raise_error("a header of unknown width").cast("array<string>")
    for n in widths:
        schema = ", ".join(f"c{i} STRING" for i in range(n))
        row = F.from_csv(record, F.lit(schema), _RECORD)
        out = F.when(width == n, F.array(*[row[f"c{i}"] for i in range(n)])).otherwise(out)
    return out


def scan_exports(
    spark: SparkSession, sources: list[str], aliases: dict[str, list[str]] = CORE_ALIASES
) -> DataFrame:
    """All mapped columns of every export as strings, under canonical names.

    Values are never inferred, so identifiers keep leading zeros. Files are cut into byte ranges,
    newlines in quotes included (``records``); the headers of all files come from one job, each
    different header is resolved once, and all records are parsed in one scan.
    """
    opened = open_exports(spark, sources)
    places = {h: require_mapping(names, aliases) for h, names in opened.headers.items()}
    numbers = list(opened.headers)

    def by_header(value_of) -> Column:
        return F.array(*[F.lit(value_of(h)) for h in numbers])

    number = F.array_position(F.array(*[F.lit(h) for h in numbers]), F.col("first")[0]).cast("int")
    files = opened.surveyed.filter("range = 0").select("file", number.alias("_header"))
    # a row for each file, as the survey has one or more
    files = files.join(_source_of(files, sources), "file").withColumnRenamed("file", "_file")
    records = csv_records(opened.lines, opened.surveyed)
    records = records.join(F.broadcast(files), F.col("file") == F.col("_file"))
    widths = sorted({len(n) for n in opened.headers.values()})
    width = F.element_at(by_header(lambda h: len(opened.headers[h])), F.col("_header"))
    parsed = records.select(
        "_header", "source_file", _fields(F.col("record"), width, widths).alias("_fields")
    )

    def value(canonical: str) -> Column:
        at = {
            h: opened.headers[h].index(own[canonical]) + 1 if canonical in own else 0
            for h, own in places.items()
        }
        if not any(at.values()):
            return F.lit("").alias(canonical)
        place = F.element_at(by_header(at.get), F.col("_header"))
        found = F.when(place > 0, F.element_at("_fields", F.greatest(place, F.lit(1))))
        return F.coalesce(found, F.lit("")).alias(canonical)

    return parsed.select(*[value(c) for c in aliases], "source_file")


def probe_exports(spark: SparkSession, sources: list[str]) -> DataFrame:
    """source_file, column_names, sample_rows_read: the header of every file, and how many of its
    first two records parse under it. Only what the survey brought along is parsed."""
    opened = open_exports(spark, sources)
    first = opened.surveyed.filter("range = 0")
    names = F.element_at(
        F.create_map(*[x for h, n in opened.headers.items() for x in (F.lit(h), F.array(*map(F.lit, n)))]),
        F.col("first")[0],
    )
    widths = sorted({len(n) for n in opened.headers.values()})
    lenient = _RECORD | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}

    def parses(record: Column) -> Column:
        ok = F.lit(False)
        for n in widths:
            schema = ", ".join([*[f"c{i} STRING" for i in range(n)], "_bad STRING"])
            bad = F.from_csv(record, F.lit(schema), lenient)["_bad"]
            ok = F.when(F.size("column_names") == n, bad.isNull()).otherwise(ok)
        return ok

    named = first.select("file", "first", names.alias("column_names"))
    rows = F.filter(F.slice("first", 2, SAMPLE - 1), parses)
    read = named.select("file", "column_names", F.size(rows).cast("long").alias("sample_rows_read"))
    return read.join(_source_of(read, sources), "file").select(
        "source_file", "column_names", "sample_rows_read"
    )


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    options = {k: v for k, v in _RECORD.items() if k not in ("mode", "multiLine")}
    writer = df.write.mode("errorifexists").options(header="true", encoding="UTF-8", **options)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
