"""The feedback loop: events to artifact metrics, streaming and in batch.

The fold is m, v -> (m + v + 1) div 2 in integer cents, v for the first event,
ordered by (time, id) within a micro-batch; late events of an earlier batch fold
where they arrive, as the running average is order-dependent by definition.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import store

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Event type -> metric.
METRICS = {"view": "retention_24h", "purchase": "conversion_30d"}


def metric_of(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, metric in METRICS.items():
        out = F.when(event_type == kind, metric).otherwise(out)
    return out


def mapped(events: DataFrame) -> DataFrame:
    """Events of a known metric with a value."""
    return events.filter("metric is not null and cents is not null").select("event_id", "artifact_id", "metric", "cents")


def mapped_with_time(events: DataFrame) -> DataFrame:
    return events.filter("metric is not null and cents is not null").select("event_id", "ts", "artifact_id", "metric", "cents")


#: Halvings that a run of events keeps exactly; past them its effect on any average is one of two values.
EXACT = 62


def _run_effect(cents: list[int]) -> tuple:
    """What a run of events in order makes of the average m before it: (first, halvings, added, low, high, step).

    first: the average without one before.  k events make floor((m + added) / 2**k) of m; for k past EXACT and m within
    2**61 that is `low`, or `high` for m from `step` on, and both go on as averages do.
    """
    first, added = None, 0
    for k, v in enumerate(cents[:EXACT]):
        first = v if first is None else (first + v + 1) // 2
        added += (v + 1) << k
    if len(cents) <= EXACT:
        return first, len(cents), added, None, None, None
    low = (added - (1 << EXACT - 1)) >> EXACT
    high, step = low + 1, ((low + 1) << EXACT) - added
    for v in cents[EXACT:]:
        first, low, high = (first + v + 1) // 2, (low + v + 1) // 2, (high + v + 1) // 2
    return first, None, None, low, high, step


def folded(events: DataFrame) -> DataFrame:
    """artifact_id, metric, cents of the batch fold.

    Events are dealt and sorted by key and time in ranges, so a key may spread over tasks; each task sums its runs up as
    functions of the average before them, and a key's few functions (one per task that has it) are applied in order.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, key, held = TaskContext.get().partitionId(), None, []
        kinds = [("artifact_id", pa.int64()), ("metric", pa.string()), ("pid", pa.int32()), ("first", pa.int64()), ("halvings", pa.int32()), ("added", pa.decimal128(38, 0)), ("low", pa.int64()), ("high", pa.int64()), ("step", pa.decimal128(38, 0))]

        def packed(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[] for _ in kinds]
            exact = lambda x: None if x is None else Decimal(x)
            return pa.RecordBatch.from_arrays([pa.array([exact(x) for x in c] if pa.types.is_decimal(t) else list(c), t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])

        for batch in batches:
            done = []
            ids, metrics, cents = (batch.column(n).to_pylist() for n in ("artifact_id", "metric", "cents"))
            starts = [i for i in range(len(ids)) if not i or (ids[i], metrics[i]) != (ids[i - 1], metrics[i - 1])]
            for i, j in zip(starts, [*starts[1:], len(ids)]):
                if (ids[i], metrics[i]) != key:
                    if held:
                        done.append((*key, pid, *_merged(held)))
                    key, held = (ids[i], metrics[i]), []
                held = [_merged([*held, _run_effect(cents[i:j])])]
            yield packed(done)
        if held:
            yield packed([(*key, pid, *_merged(held))])

    order = ("artifact_id", "metric", "ts", "event_id")
    rows = events.select(F.col("artifact_id").cast("long").alias("artifact_id"), "metric", "ts", "event_id", F.col("cents").cast("long").alias("cents"))
    effects = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, "artifact_id long, metric string, pid int, first long, halvings int, added decimal(38,0), low long, high long, step decimal(38,0)")
    each = effects.groupBy("artifact_id", "metric").agg(F.sort_array(F.collect_list(F.struct("pid", "first", "halvings", "added", "low", "high", "step"))).alias("e"))  # tasks at most

    def then(m: Column, e: Column) -> Column:
        size = F.pow(F.lit(2.0), e["halvings"]).cast("decimal(20,0)")
        whole = m.cast("decimal(38,0)") + e["added"]
        halved = ((whole - F.pmod(whole, size)) / size).cast("long")
        return F.when(m.isNull(), e["first"]).when(e["halvings"].isNotNull(), halved).otherwise(F.when(m >= e["step"], e["high"]).otherwise(e["low"]))

    return each.select("artifact_id", "metric", F.aggregate("e", F.lit(None).cast("long"), then).alias("cents"))


def _merged(effects: list[tuple]) -> tuple:
    """The effect of runs that follow each other."""
    out = effects[0]
    for first, halvings, added, low, high, step in effects[1:]:
        if out is None:
            out = (first, halvings, added, low, high, step)
            continue

        def then(m: int) -> int:
            return (m + added) >> halvings if halvings is not None else high if m >= step else low

        was_first, was_halvings, was_added, was_low, was_high, was_step = out
        if was_halvings is None:
            out = (then(was_first), None, None, then(was_low), then(was_high), was_step)
        elif halvings is not None and was_halvings + halvings <= EXACT:
            out = (then(was_first), was_halvings + halvings, was_added + (added << was_halvings), None, None, None)
        else:
            # the lowest average the range allows, and the one from which the first run's result is higher
            lowest = (was_added - (1 << EXACT - 1)) >> was_halvings
            values = [then(x) for x in (lowest, (was_added + (1 << EXACT - 1) - 1) >> was_halvings)]
            if values[0] == values[1]:
                out = (then(was_first), None, None, values[0], values[0], 0)
            else:
                at, end = lowest, (was_added + (1 << EXACT - 1) - 1) >> was_halvings
                while end - at > 1:  # where the second run's result rises
                    mid = (at + end) // 2
                    at, end = (mid, end) if then(mid) == values[0] else (at, mid)
                out = (then(was_first), None, None, values[0], values[1], (end << was_halvings) - was_added)
    return out


def fold_stream(events: DataFrame) -> DataFrame:
    """The same fold with state per (artifact, metric); each batch emits the keys it changed."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        m = state.get[0] if state.exists else None
        for cents in rows["cents"]:
            m = int(cents) if m is None else (m + int(cents) + 1) // 2
        state.update((m,))
        yield pd.DataFrame({"artifact_id": [key[0]], "metric": [key[1]], "cents": [m]})

    return events.groupBy("artifact_id", "metric").applyInPandasWithState(run, "artifact_id long, metric string, cents long", "m long", "update", GroupStateTimeout.NoTimeout)


def raw_source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Events as a stream of files."""
    reader = spark.readStream.schema(EVENTS)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """What an append stream yields of all that is there now, through files in the shared folder: its tasks write them, and the plan reads them back."""
    path = store.folder(stream.sparkSession, "drained")
    started = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress")
    started.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def latest(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last value of each key of an update stream, through files.

    Each micro-batch writes its changed keys under its number and replaces what an earlier try of that batch wrote, so a
    repeated batch counts once.
    """
    path = store.folder(stream.sparkSession, "changes")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top):  # no batch ran
        return spark.createDataFrame([], stream.schema)
    changes = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{path}/rows")
    return changes.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def source(spark: SparkSession, path: str) -> DataFrame:
    """Events mapped to metrics in cents."""
    raw = raw_source(spark, path)
    rows = raw.select("event_id", "ts", F.col("user_id").alias("artifact_id"), metric_of(F.col("event_type")).alias("metric"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return mapped_with_time(rows)


def run_stream(spark: SparkSession, path: str) -> DataFrame:
    """Drain what is at path through the stream and return the metrics."""
    return latest(fold_stream(source(spark, path)), ["artifact_id", "metric"], "cents")


def closed_windows(events: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, event_type, n of windows that the watermark has closed: each event_id once, events behind the watermark not at all."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def in_deliveries(events: DataFrame, delivery: Column, path: str) -> None:
    """Write events as files under path in the order of `delivery` (0, 1, ..): a stream takes one delivery per micro-batch."""
    events = store.kept(events.withColumn("_delivery", delivery), "deliveries")
    for k in range((events.agg(F.max("_delivery")).first()[0] or 0) + 1):
        events.filter(F.col("_delivery") == k).drop("_delivery").coalesce(1).write.mode("append").parquet(path)  # one file: one micro-batch


def windowed(events: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per event-time window and type, closed by a watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
