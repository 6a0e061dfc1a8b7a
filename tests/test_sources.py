from __future__ import annotations

import csv
import io

import pytest
from pyspark.sql import functions as F

from triagemill.session import new_table_path
from triagemill.sources import core, exports, schema

HEADER = "﻿Issue URL,ID,Product,Component,Summary,Description,Severity,Creation time,Dupe of,Comments\n"


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_scan_keeps_zeros_newlines_and_strips_bom(spark, tmp_path):
    body = 'u1,007,P,C,"say ""hi""","line one\nline two",Major,2024-01-01 00:00:00,,secret@x.org\n'
    path = write(tmp_path, "alpha_dataset_issues.csv", HEADER + body)
    rows = exports.scan_exports(spark, [path]).collect()
    assert len(rows) == 1
    assert rows[0]["issue_id"] == "007"
    assert rows[0]["issue_url"] == "u1"
    assert rows[0]["summary"] == 'say "hi"'
    assert rows[0]["description"] == "line one\nline two"
    assert "comments" not in rows[0].asDict()


def hard_table(n):
    """Records with newlines, doubled quotes, separators and empty fields in quotes."""
    odd = ["plain", 'a "quoted" word', "two\nlines", 'x,"y"\n\n",z"', "", '"', "\r\nafter a return", "é 日本\n" * 3]
    return [[f"u{i}", f"{i:05d}", "P", "C", odd[i % 8], odd[(i * 5 + 3) % 8] * (1 + i % 3), "Major", "2024-01-01", "", ""] for i in range(n)]


@pytest.mark.parametrize("size", ["7", "64", "1000", "134217728"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_byte_ranges(spark, tmp_path, size, end):
    """Ranges that cut quoted newlines anywhere, or lie within one field as a whole, change nothing."""
    rows = hard_table(60)
    rows[9][5] = "\n".join(f'line "{k}"' for k in range(200))
    text = io.StringIO(newline="")
    out = csv.writer(text, lineterminator=end)
    out.writerow(HEADER.strip().removeprefix("\ufeff").split(","))
    out.writerows(rows)
    path = tmp_path / "beta +dataset issues.csv"
    path.write_bytes(("\ufeff" + text.getvalue() + end).encode())
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        # a range must hold the header
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(200, int(size))))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = exports.scan_exports(spark, [str(path)]).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    found = sorted((r["issue_url"], r["issue_id"], r["summary"], r["description"], r["source_file"]) for r in got)
    assert found == sorted((r[0], r[1], r[4], r[5], "beta +dataset issues.csv") for r in rows)


def test_many_files_are_one_scan(spark, tmp_path):
    """Headers of all files come from one job; different orders of columns meet in one plan."""
    orders = ["ID,Summary,Description,Severity,Creation time\n", "Severity,Creation time,ID,Extra,Summary,Description\n"]
    for i in range(30):
        values = f'{i},s{i},"d\n{i}",Major,2024\n' if i % 2 == 0 else f'Minor,2023,{i},x,s{i},"d,{i}"\n'
        write(tmp_path, f"p{i}_issues.csv", orders[i % 2] + values * 2)
    sources = exports.resolve_sources(spark, glob=f"{tmp_path}/*_issues.csv")
    scanned = exports.scan_exports(spark, sources)
    plan = scanned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text") <= 4 and len(exports.open_exports(spark, sources).headers) == 2
    got = sorted((r["issue_id"], r["summary"], r["description"], r["severity"], r["source_file"]) for r in scanned.collect())
    want = [(str(i), f"s{i}", f"d\n{i}" if i % 2 == 0 else f"d,{i}", "Major" if i % 2 == 0 else "Minor", f"p{i}_issues.csv") for i in range(30)] * 2
    assert got == sorted(want)
    probed = exports.probe_exports(spark, sources).collect()
    assert len(probed) == 30 and {(len(r["column_names"]), r["sample_rows_read"]) for r in probed} == {(5, 2), (6, 2)}


def test_probe_counts_rows_that_parse(spark, tmp_path):
    head = "ID,Summary,Description,Severity,Creation time\n"
    paths = [write(tmp_path, n, head + t) for n, t in (("a.csv", ""), ("b.csv", "1,s,d,M,t\n"), ("c.csv", "1,s,d,M,t,more\n2,s,d,M,t\n3,s,d,M,t\n"))]
    got = {r["source_file"]: r["sample_rows_read"] for r in exports.probe_exports(spark, paths).collect()}
    assert got == {"a.csv": 0, "b.csv": 1, "c.csv": 1}
    assert exports.scan_exports(spark, paths[:1]).count() == 0
    with pytest.raises(FileNotFoundError):
        exports.scan_exports(spark, [str(tmp_path / "absent.csv")])
    with pytest.raises(FileNotFoundError):
        exports.scan_exports(spark, [write(tmp_path, "empty.csv", "\n")])


def test_malformed_row_fails(spark, tmp_path):
    text = HEADER + "u1,1,P,C,s,d,Major,2024-01-01,,c,extra,more\n"
    path = write(tmp_path, "bad.csv", text)
    with pytest.raises(Exception):
        exports.scan_exports(spark, [path]).select("issue_url", "dupe_of").collect()


def test_source_arguments(spark, tmp_path):
    with pytest.raises(ValueError):
        exports.resolve_sources(spark, path="a", glob="b")
    with pytest.raises(FileNotFoundError):
        exports.resolve_sources(spark, glob=f"{tmp_path}/none*.csv")
    assert exports.resolve_sources(spark, paths=["b", "a"]) == ["a", "b"]


def test_names_and_aliases():
    assert schema.normalize_name(" Creation time ") == "creation_time"
    assert schema.resolve_lenient(["id", "title"], {"summary": ["short_desc", "title"]}) == {
        "summary": "title"
    }
    with pytest.raises(ValueError, match="ambiguous"):
        schema.require_mapping(
            ["ID", "Issue ID", "Summary", "Description", "Severity", "Creation time"]
        )
    with pytest.raises(ValueError, match="missing"):
        schema.require_mapping(["ID", "Summary"])


def raw(spark, n=4, project="p"):
    return spark.createDataFrame(
        [
            (str(i), f"summary {i}", "text", "Major", "2024-01-01 00:00:00", project)
            for i in range(n)
        ],
        "issue_id string, summary string, description string, severity string,"
        " creation_time string, project string",
    )


def build(spark, n=4, project="p"):
    return core.core_rows(
        raw(spark, n, project), F.col("project"), F.concat("project", F.lit(".csv"))
    )


def test_write_replaces_only_its_projects(spark):
    path = new_table_path(spark, "core")
    core.write_core(build(spark, 4, "a").unionByName(build(spark, 3, "b")), path)
    core.write_core(build(spark, 2, "a"), path)
    counts = {
        r["source_project"]: r["count"]
        for r in core.read_core(spark, path).groupBy("source_project").count().collect()
    }
    assert counts == {"a": 2, "b": 3}


def test_study_results_refuse_to_overwrite(spark):
    path = new_table_path(spark, "once")
    core.write_once(build(spark), path)
    with pytest.raises(Exception):
        core.write_once(build(spark), path)


def test_contract(spark):
    df = build(spark)
    good = spark.createDataFrame([("p", "p.csv", 4)], "source_project string, source_file string, rows long")
    core.check_contract(df, good)
    with pytest.raises(ValueError):
        core.check_contract(df, good.withColumn("rows", F.lit(5)))
    with pytest.raises(ValueError, match="Forbidden"):
        core.check_core_schema(df.withColumn("comments", F.lit("x")))
    with pytest.raises(ValueError, match="lacks"):
        core.check_core_schema(df.drop("dupe_of"))


def test_predictors(spark):
    status = spark.createDataFrame(
        [("summary", "PRIMARY_ELIGIBLE"), ("status", "PRIMARY_ELIGIBLE")],
        "normalized_name string, eligibility_status string",
    )
    ask = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    core.require_predictors(ask(" Summary "), status)
    with pytest.raises(ValueError):
        core.require_predictors(ask("Status"), status)
    with pytest.raises(ValueError):
        core.require_predictors(ask("Product"), status)


def test_resume_and_guard(spark):
    columns = ["issue_id", "summary"]
    before = core.source_fingerprints(raw(spark), "project", columns)
    manifest = before.select(
        "source_project",
        "content_fingerprint",
        F.lit("cfg").alias("configuration_fingerprint"),
        F.lit("complete").alias("completion_status"),
    )
    status = lambda df, **k: df and core.changed_sources(df, manifest, "cfg", **k).first()
    assert status(before)["resume_status"] == "skipped_unchanged"
    assert status(before, force=True)["resume_status"] == "rebuilt"
    changed = core.source_fingerprints(
        raw(spark).withColumn("summary", F.upper("summary")), "project", columns
    )
    assert status(changed)["resume_status"] == "built"
    core.unchanged_guard(before, before)
    with pytest.raises(ValueError):
        core.unchanged_guard(before, changed)


def test_delta_against_a_stored_build(spark):
    schema = "p string, k string, a string"
    path = new_table_path(spark, "build")
    old = [("x", "1", "a"), ("x", "2", "b"), ("x", "2", "b"), ("y", "1", "a"), (None, "1", "a"), ("z", "1", "a"), ("w", None, "a")]
    new = [("x", "2", "b"), ("x", "2", "c"), ("x", "3", "d"), ("y", "1", "a"), (None, "1", "A"), ("v", "1", "a"), ("w", None, "a")]
    args = ("p", "k", ["k", "a"], "config")
    delta = lambda rows, config="config": {
        r[0]: tuple(r[1:]) for r in core.build_delta(spark.createDataFrame(rows, schema), path, *args[:3], config).collect()
    }
    assert set(delta(new).values()) == {("built", n, 0, 0, 0) for n in (1, 2)}
    core.store_build(spark.createDataFrame(old, schema), path, *args)
    same = ("skipped_unchanged", 0, 0, 0, 1)
    want = {"x": ("changed", 1, 1, 1, 0), "y": same, None: ("changed", 0, 1, 0, 0), "z": ("lost", 0, 0, 1, 0), "v": ("built", 1, 0, 0, 0), "w": same}
    assert delta(new) == want
    assert delta(old[::-1]) == {p: ("skipped_unchanged", 0, 0, 0, 2 if p == "x" else 1) for p in ("x", "y", None, "z", "w")}
    assert {v[0] for v in delta(old, "other").values()} == {"rebuilt"}
