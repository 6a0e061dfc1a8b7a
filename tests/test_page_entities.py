"""Entities of pages without their semicolon are decoded alike by txt1 and its SQL."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.plans.text_queries import clean_sql, decoded_sql

PAGES = ["und&&&amp</p>", "a &amp;lt; b &ltb&gt c", "caf&eacute &eacute; &copy2 &middot;x", "&amp;amp &quot&#39;q&nbsp;z"]


def test_missing_semicolons(spark):
    df = spark.createDataFrame([(p,) for p in PAGES], "html string")
    got = [r[0] for r in df.select(X.clean_text(F.col("html"))).collect()]
    con = duckdb.connect()
    sql = f"SELECT {clean_sql(decoded_sql('html'))} FROM (SELECT ? AS html)"
    assert got == [con.execute(sql, [p]).fetchone()[0] for p in PAGES]
