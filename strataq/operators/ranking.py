"""Ranked lists: fusion, knees, thresholds, windows around anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of least order per key."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def margin(gaps: str, floor: float) -> Column:
    """Aggregate: the lower median of a column without interpolation, at least floor; floor for fewer than two values.

    Spark merges counts of distinct values on the map side; no list of a group is made.
    """
    median = F.expr(f"percentile_disc(0.5) within group (order by `{gaps}`)")
    return F.when(F.count(gaps) < 2, F.lit(floor)).otherwise(F.greatest(median, F.lit(floor)))


def expand_window(anchors: DataFrame, chunks: DataFrame, *, before: int, after: int, keep: list[str] | None = None) -> DataFrame:
    """anchor, neighbour, neighbour_index, *keep: chunks within the window, as an equi join on exploded positions."""
    near = anchors.select(F.col("chunk_id").alias("anchor"), "doc_id", *(keep or []), F.explode(F.sequence(F.col("chunk_index") - before, F.col("chunk_index") + after)).alias("chunk_index"))
    return near.join(chunks.select("doc_id", "chunk_index", F.col("chunk_id").alias("neighbour")), ["doc_id", "chunk_index"]).withColumnRenamed("chunk_index", "neighbour_index")


def rank(lists: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """lists (keys, id, score) with `rank` from 1 by score, then id; the first `most` of each."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    out = lists.withColumn("rank", F.row_number().over(w))
    return out if most is None else out.filter(F.col("rank") <= most)


def fuse(ranked: DataFrame, key: str = "query_id", k: int = 60) -> DataFrame:
    """key, id, score: reciprocal rank fusion, sum of 1 / (k + rank) over all lists of a key."""
    return ranked.groupBy(key, "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))


def knee(lists: DataFrame, key: str, *, min_points: int = 3, min_curvature: float = 0.01, sensitivity: float = 1.0) -> DataFrame:
    """lists (key, id, score) with `knee`: the score at the knee of the key's falling curve, null without one.

    Scores and ranks are scaled to [0, 1]; the knee is the first inner local maximum of
    (1 - x) - y that is at least its maximum less its mean.  All windows share one
    partitioning, so the lists move once.
    """
    part, order = Window.partitionBy(key), Window.partitionBy(key).orderBy(F.desc("score"), "id")
    rows = lists.withColumn("_i", F.row_number().over(order) - 1).withColumns({"_n": F.count(F.lit(1)).over(part), "_hi": F.max("score").over(part), "_lo": F.min("score").over(part)})
    usable = (F.col("_n") >= min_points) & (F.col("_hi") - F.col("_lo") >= 1e-12)
    x = F.try_divide(F.col("_i").cast("double"), (F.col("_n") - 1).cast("double"))
    y = F.try_divide(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    rows = rows.withColumn("_d", F.when(usable, 1 - x - y))
    rows = rows.withColumns({"_top": F.max("_d").over(part), "_mean": F.avg("_d").over(part), "_a": F.lag("_d").over(order), "_b": F.lead("_d").over(order)})
    is_knee = (F.col("_top") >= min_curvature) & (F.col("_d") >= F.col("_a")) & (F.col("_d") >= F.col("_b")) & (F.col("_d") >= F.col("_top") - sensitivity * F.col("_mean"))
    rows = rows.withColumn("knee", F.min_by(F.when(is_knee, F.col("score")), F.when(is_knee, F.col("_i"))).over(part))
    return rows.withColumn("knee_index", F.min(F.when(is_knee, F.col("_i"))).over(part)).drop("_i", "_n", "_lo", "_d", "_top", "_mean", "_a", "_b")


def relevant(lists: DataFrame, key: str = "query_id", *, floor: float = 0.001, share: float = 0.15) -> DataFrame:
    """Rows at or above the knee, else above max(floor, share of the best); nothing where the best is not positive."""
    rows = knee(lists, key)
    cut = F.coalesce("knee", F.greatest(F.lit(floor), share * F.col("_hi")))
    return rows.filter((F.col("_hi") > 0) & (F.col("score") >= cut)).drop("_hi", "knee", "knee_index")
