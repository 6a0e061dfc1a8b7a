"""Registered queries: name -> Spark callable and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.plans.oracle_views import with_views
from triagemill.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison, turn times into text, widen integers.

    A double is rounded as SQL does it: the product with a power of ten, to a whole number, half up.
    Its decimal digits would end at another number where the product lies beside a half, as that
    of 41 / 640 does.
    """
    out = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        col = F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            scale = F.lit(10.0**digits)
            # adding zero folds -0.0 into 0.0
            col = F.round(col.cast("double") * scale, 0) / scale + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind.startswith("timestamp"):
            col = col.cast("string")
        out.append(col.alias(field.name))
    return df.select(*out)
