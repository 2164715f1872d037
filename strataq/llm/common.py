"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space class of the word and line contracts.
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Where the session names none, a local session (tests) gets a folder of its own,
    recorded in the session so that later calls find it; a cluster gets an error,
    as no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataq-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here.  folders: columns to write a folder each for.

    Unlike a local checkpoint the copy survives the loss of any executor, and
    the reread scan carries real sizes for the planner's broadcast checks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataq/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataq_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more: what came of them is written already."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table._strataq_path)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files and broadcasts of finished plans now: it does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1024, most_bytes: int = 8 << 20) -> None:
    """Before a Python stage: bound the rows and the bytes of one Arrow batch, as texts may be long, and let workers on this machine import the package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def least_hashed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Of rows at rest with distinct keys, the `most` with the least hashes (all, where there are fewer).

    A sort with a limit hands on `most` rows of every partition.  So a range of hashes that holds about `most`
    rows, and eight deviations more, is cut out first: what moves is bounded by `most`, whatever the partitions.
    """
    total, place = rows.count(), F.xxhash64(key)
    share = (most + 8 * max(most, 1) ** 0.5) / max(total, 1)
    if share < 1:
        rows = rows.filter(place <= F.lit(int(share * 2**64) - 2**63))
    return rows.orderBy(place, key).limit(most)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that working columns beside it cannot clash with their names."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column has it."""
    while name in df.columns:
        name = "_" + name
    return name
