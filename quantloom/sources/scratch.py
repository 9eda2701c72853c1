"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new name under spark.checkpoint.dir. Where that is unset, a session on one machine gets a local folder;
    on a cluster it is an error, as executors share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there, and a lost executor
    takes nothing with it."""
    path, schema = scratch_path(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by sorted shuffles. Spark takes a stored table for as large as its files, but rows of repeated texts and
    codes are many times larger in memory: the driver would collect them to broadcast them."""
    return df.hint("merge")
