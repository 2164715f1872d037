"""WARC archives: a writer, and a reader that verifies the chain of boundaries.

Writing: one record per page; equal payloads (by SHA-1 and size) of at least
min_bytes are stored once, as the response of the smallest id, and the others
become revisits that refer to it.  Spark's text writer with the record end as
line separator writes the archives, so they may live in any store it knows.

Reading: the archives are split anywhere.  Every task cuts its block at each
"WARC/1.0" it sees, also at those inside payloads, and emits a candidate for
each: its offset and the offset its Content-Length says the next record has.
Pointer jumping from offset 0 of each file, first inside blocks and then by
doubling between blocks, retains only reachable records.  Payloads that hold the
magic are put together again from the pieces that their record covers.

Defined results: a null payload is empty; a null id gives a record without an
id, and null on reading; null urls have no target line; repeated rows (same id)
are records of their own, the first of a group by (id, row) is the response; an
empty table gives no archives and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, small_batches, text_or_empty

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: 40 hex digits are four groups of eight base-32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), HEX32, BASE32)


def plan_records(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(_copy id, _digest, _bytes) of pages that revisit, and _refers: digests alone shuffle, combined on the map side.

    Where the referred id itself has several such rows, _tied is set: all but one of them revisit.
    """
    payload = text_or_empty(payload_col).cast("binary")
    rows = cut(pages.select(F.col(id_col).alias("_id"), base32_sha1(payload).alias("_digest"), F.length(payload).cast("long").alias("_bytes")), "payloads")
    first = F.struct(F.col("_id").isNull().alias("_none"), "_id")
    groups = cut(rows.filter(F.col("_bytes") >= min_bytes).groupBy("_digest", "_bytes").agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "copies")
    # rows without any id in their group have nothing to refer to and stay responses
    met = rows.join(groups, ["_digest", "_bytes"]).select(F.col("_id").alias("_copy"), "_digest", "_bytes", F.col("_first._id").alias("_refers")).filter("_refers is not null")
    counted = met.groupBy("_copy", "_digest", "_bytes", "_refers").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_tied", F.col("_copy").eqNullSafe(F.col("_refers")))
    return cut(counted.filter("not _tied or _rows > 1").drop("_rows"), "revisits")


def _line(name: str, value: Column) -> Column:
    """One header line; none for null.  Line breaks in a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit("\r\n")), F.lit(""))


def _urn(value: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), value.cast("string"), F.lit(">"))


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives under path, one file per input partition; and those of rows that share id and payload."""
    copies = plan_records(pages, id_col=id_col, payload_col=payload_col, min_bytes=min_bytes)
    own = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), text_or_empty(payload_col).alias("_payload"))
    own = own.withColumn("_digest", base32_sha1(F.col("_payload").cast("binary"))).withColumn("_bytes", F.octet_length("_payload").cast("long"))
    # revisits are few or many: Spark broadcasts them below its size limit and else sorts both sides
    rows = own.join(copies.withColumnRenamed("_digest", "_d").withColumnRenamed("_bytes", "_n"), F.col("_id").eqNullSafe(F.col("_copy")) & (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_n")), "left")
    if not copies.filter("_tied").isEmpty():
        # only rows alike in id and payload need their place to tell them apart: these are kept with it, so that it holds
        tied = cut(rows.filter("_tied"), "tied")
        least = cut(tied.groupBy("_id", "_digest", "_bytes").agg(F.min("_row").alias("_least")).select("_least"), "firsts")
        tied = tied.join(least, F.col("_row") == F.col("_least"), "left").withColumn("_refers", F.when(F.col("_least").isNull(), F.col("_refers"))).drop("_least")
        rows = rows.filter("_tied is null or not _tied").unionByName(tied)
    again = F.col("_refers").isNotNull()
    body = F.when(again, F.lit("")).otherwise(F.col("_payload"))
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("_url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        F.when(again, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), _line("WARC-Refers-To", _urn(F.col("_refers"))))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


# reading

_HEAD = re.compile(rb"((?:[A-Za-z0-9-]+:[^\r\n]*\r\n)*)\r\n")
_CANDIDATE = "file string, block long, at long, size long, head long, content long, type string, record string, refers string, digest string, own_sha1 string"


def _header(text: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    m = _HEAD.match(text)
    if not m:
        return None
    return m.end(), {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in m[1].split(b"\r\n") if x)}


def _pieces(spark: SparkSession, path: str, emit, schema: str) -> DataFrame:
    """emit(file, block, at, text) for what lies between magics; at: bytes of earlier pieces of that block.

    A block's rows come in file order within one task, so offsets inside it are running sums.
    """
    small_batches(spark, 256)
    raw = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[str, int], int] = {}
        for batch in batches:
            out = []
            for text, file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                here = at.get((file, block), 0)
                out.append(emit(file, block, here, text))
                at[file, block] = here + len(text) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out), fields)] if out else [pa.array([], t) for _, t in fields], [n for n, _ in fields])

    return raw.mapInArrow(run, schema)


def _candidate(file: str, block: int, at: int, text: bytes) -> tuple:
    head = _header(text)
    length = head and head[1].get(b"content-length", b"")
    if not head or not length.isdigit():
        return file, block, at, len(text), -1, -1, None, None, None, None, None
    size, found = head[0], {k: v.decode("utf-8", "replace") for k, v in head[1].items()}
    whole = size + int(length) <= len(text)
    sha1 = base64.b32encode(hashlib.sha1(text[size : size + int(length)]).digest()).decode() if whole else None
    return file, block, at, len(text), size, int(length), found.get(b"warc-type"), found.get(b"warc-record-id"), found.get(b"warc-refers-to"), found.get(b"warc-payload-digest"), sha1


def _with_offsets(rows: DataFrame, base: DataFrame) -> DataFrame:
    return rows.join(base, ["file", "block"]).withColumn("start", F.col("base") + F.col("at"))


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per candidate of one block: where its chain leaves the block (numpy pointer jumping)."""
    pdf = pdf.sort_values("offset", ignore_index=True)
    offset, to = pdf["offset"].to_numpy(), pdf["next"].to_numpy()
    n = offset.size
    k = np.searchsorted(offset, to)
    inside = (k < n) & (offset[np.minimum(k, n - 1)] == to)
    jump = np.append(np.where(inside, k, n), n)  # n: has left
    last = np.arange(n)
    while (jump[last] < n).any():
        last = np.where(jump[last] < n, jump[last], last)
        jump = jump[jump]
    return pd.DataFrame({"file": pdf["file"], "offset": offset, "exit": to[last]})


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The records of one block that its reachable entries lead to."""
    pdf = pdf.sort_values("offset", ignore_index=True)
    index = {int(o): i for i, o in enumerate(pdf["offset"])}
    keep = np.zeros(len(pdf), bool)
    to = pdf["next"].to_numpy()
    for i in np.flatnonzero(pdf["entry"].to_numpy()):
        while i is not None and not keep[i]:
            keep[i] = True
            i = index.get(int(to[i]))
    return pdf.loc[keep, ["file", "offset"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, offset) of candidates on the chain from offset 0.  candidates: file, block, offset, next."""
    jump = cut(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, offset long, exit long"), "exits")
    reach = cut(candidates.filter("offset = 0").select("file", "offset"), "reach")
    known, edges = reach.count(), jump
    while True:
        step = edges.select("file", "offset", F.col("exit").alias("_to"))
        met = reach.join(step, ["file", "offset"]).select("file", F.col("_to").alias("offset")).join(jump.select("file", "offset"), ["file", "offset"], "left_semi")
        reach = cut(reach.unionByName(met).distinct(), "reach")
        now = reach.count()
        if now == known:
            break
        known = now
        double = edges.select("file", "offset", F.col("exit").alias("_mid")).join(edges.select("file", F.col("offset").alias("_mid"), "exit"), ["file", "_mid"])
        edges = cut(double.select("file", "offset", "exit"), "edges")
    marked = candidates.join(reach.withColumn("entry", F.lit(True)), ["file", "offset"], "left").na.fill({"entry": False})
    return marked.select("file", "block", "offset", "next", "entry").groupBy("file", "block").applyInPandas(_walk, "file string, offset long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per reachable record: file, offset, type, record, refers, digest (as declared), content (bytes), sha1 (of the payload read)."""
    found = cut(_pieces(spark, path, _candidate, _CANDIDATE), "candidates")
    totals = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("_sum"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # blocks of one file
    base = cut(totals.select("file", "block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("base")), "bases")
    placed = cut(_with_offsets(found, base).withColumn("offset", F.col("start") - len(MAGIC)), "placed")
    valid = placed.filter("head >= 0 and offset >= 0").withColumn("next", F.col("start") + F.col("head") + F.col("content") + len(END))
    chain = cut(reachable(valid.select("file", "block", "offset", "next")), "chain")
    records = cut(valid.join(chain, ["file", "offset"]), "records")
    broken = records.filter("own_sha1 is null")
    if broken.isEmpty():
        sha1 = records.withColumn("sha1", F.col("own_sha1"))
    else:
        sha1 = records.join(_rejoined(spark, path, placed, base, broken), ["file", "offset"], "left").withColumn("sha1", F.coalesce("own_sha1", "_sha1"))
    return sha1.select("file", "offset", "type", "record", "refers", "digest", "content", "sha1")


def _rejoined(spark: SparkSession, path: str, placed: DataFrame, base: DataFrame, broken: DataFrame) -> DataFrame:
    """SHA-1 of payloads that hold the magic, from the pieces that lie in their records."""
    starts = placed.select("file", "block", "at", "start").join(
        broken.select("file", F.col("start"), F.struct("offset", "start", "head", "content").alias("_of")), ["file", "start"], "left"
    )
    # the last broken record before a piece: within its block, else the last of the blocks before, one row a block
    in_order = Window.partitionBy("file", "block").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    ends = starts.groupBy("file", "block").agg(F.max_by("_of", F.when(F.col("_of").isNotNull(), F.col("start"))).alias("_end"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "block", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    covered = starts.withColumn("_own", F.last("_of", ignorenulls=True).over(in_order)).join(carried, ["file", "block"]).select("file", "block", "at", "start", F.coalesce("_own", "_carried").alias("_of"))
    covered = covered.filter(f"_of is not null and start - {len(MAGIC)} < _of.start + _of.head + _of.content")  # a payload may end in the magic
    need = cut(covered.select("file", "block", "at", "start", "_of"), "covered")
    texts = _pieces(spark, path, lambda file, block, at, text: (file, block, at, text), "file string, block long, at long, text binary")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        first = pdf.iloc[0]
        data = MAGIC.encode().join(pdf["text"])[first["head"] : first["head"] + first["content"]]
        return pd.DataFrame({"file": [first["file"]], "offset": [first["offset"]], "_sha1": [base64.b32encode(hashlib.sha1(data).digest()).decode()]})

    rows = texts.join(need, ["file", "block", "at"]).select("file", F.col("_of.offset").alias("offset"), F.col("_of.head").alias("head"), F.col("_of.content").alias("content"), "start", "text")
    return rows.groupBy("file", "offset").applyInPandas(join, "file string, offset long, _sha1 string")  # one record's payload


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder, read them back: id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    path = f"{shared_dir(spark)}/strataq/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, id_col=id_col, url_col=url_col, payload_col=payload_col, min_bytes=min_bytes)
    key = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1).cast(kind)
    records = cut(read_warc(spark, path), "read")
    full = records.filter("type = 'response'").select(key("record").alias("_of"), F.col("content").alias("_bytes"), F.concat(F.lit("sha1:"), F.col("sha1")).alias("_read")).distinct()
    revisits = records.filter("type = 'revisit'").withColumn("_refers", key("refers"))
    # a revisit's payload is the one it refers to, found by id and digest
    again = revisits.join(full, (F.col("_refers") == F.col("_of")) & (F.col("digest") == F.col("_read")), "left")
    bare = lambda c: F.regexp_replace(c, "^sha1:", "")
    return (
        records.filter("type = 'response'").select(key("record").alias(id_col), F.col("content").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
        .unionAll(again.select(key("record"), "_bytes", bare(F.col("digest")), "type", "_refers"))
    )
