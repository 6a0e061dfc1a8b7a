"""Session defaults and the shared folder used for tables that must outlive one plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on; leave sizing to the cluster."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, as the cluster names it.

    Only a single local process may do without; it gets a temporary folder.
    """
    path = spark.conf.get(_CHECKPOINT_DIR, None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{_CHECKPOINT_DIR} must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="spark-triagemill-")
    spark.conf.set(_CHECKPOINT_DIR, path)
    return path


def new_table_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/triagemill/{app}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = new_table_path(spark, tag)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
