"""Compare registered queries with their SQL twins in DuckDB, the way the gate does."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for row in pdf.itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                out.append("NULL")
            elif isinstance(v, bool):
                out.append(str(v))
            elif isinstance(v, float):
                out.append(f"{v:.6f}")
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def difference(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    kinds = [
        (c, str(spark_pdf[c].dtype), str(duck_pdf[c].dtype))
        for c in spark_pdf.columns
        if str(spark_pdf[c].dtype) != str(duck_pdf[c].dtype)
    ]
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; e.g. {a[:2]} vs {b[:2]}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        cols = sorted(spark_pdf.columns)
        x, y = bad[0]
        return f"{len(bad)} rows differ: {[(c, i, j) for c, i, j in zip(cols, x, y) if i != j]}"
    if kinds:
        return f"TYPES {kinds}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = argv[1] if len(argv) > 1 else "0.01"
    wanted = argv[2].split(",") if len(argv) > 2 else None
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1]))
                              for w in wanted):
            continue
        try:
            t = time.time()
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - t
            if name not in oracle:
                print(f"{name:8s} rows  {len(got):6d} {took:6.2f}s")
                continue
            t = time.time()
            want = con.execute(oracle[name]).fetchdf()
            bad = difference(got, want)
            mark = "ok   " if bad is None else "DIFF "
            failed += bad is not None
            print(f"{name:8s} {mark} {len(got):6d} {took:6.2f}s duck {time.time()-t:5.2f}s {bad or ''}",
                  flush=True)
        except Exception as exc:  # noqa: BLE001
            failed += 1
            print(f"{name:8s} ERROR {type(exc).__name__}: {str(exc)[:700]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv), 100))
