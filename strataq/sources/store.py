"""Intermediate tables in the folder that all executors share: lineage ends there, and the planner sees real sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, wherever the session was started; on a cluster it is installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the session's spark.checkpoint.dir.

    A local session without that setting gets a folder of its own, kept in the session; a cluster gets an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="strataq-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over the cores where its files split into fewer pieces; larger tables keep their own splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pieces(rows: int, each: int = 1 << 19) -> int:
    """How many pieces of about `each` rows: what one task holds then does not grow with the table."""
    return max(1, -(-rows // each))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of so many rows by its keys, into pieces of one size and no fewer than there are cores: grouped or joined by these keys, it moves no more."""
    return df.repartition(max(pieces(rows), df.sparkSession.sparkContext.defaultParallelism), *keys)
