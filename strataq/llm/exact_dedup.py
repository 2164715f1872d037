"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Pass one counts, per slot of a Bloom filter with k hash functions, whether two
or more rows fall on it: of each row only k slot numbers move (never its text),
combined on the map side.  The twice-hit slots become 4 KB bitmaps, broadcast
under a fixed bound.  Pass two tests every row: a row with any once-hit slot has
no equal anywhere and passes straight through; only the remaining rows shuffle
by digest.  Digests are dealt into as many ranges as keep one range's filter
within max_bits, and each range is written and tested by itself, so the filter's
false positives stay as few at any number of rows.

Defined results: a null text counts as empty; empty texts equal each other.  A
null doc_id sorts after all others.  Rows repeated in full form one group, of
which exactly one row is kept.  Any length of text is hashed whole.  An empty
table gives an empty result.  Extra columns are ignored; every working name is
private to this module's own narrow copy of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import SPACE, cut, text_or_empty


def normalised(text: Column) -> Column:
    """The text without any character of SPACE."""
    return F.translate(text, SPACE, "")


def possibly_repeated(rows: DataFrame, digest: str, *, n_rows: int, k: int = 2, bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """rows plus a boolean `_maybe`: false only where no other row has the digest."""
    bits = bloom.filter_bits(n_rows, bits_per_row, max_bits)
    slots = F.array_distinct(F.array(*bloom.slots(F.col(digest), k, bits)))
    hit_twice = rows.select(F.explode(slots).alias("_slot")).groupBy("_slot").agg(F.count(F.lit(1)).alias("_hits")).filter("_hits > 1")
    return bloom.test(rows, F.col(digest), bloom.bitmaps(hit_twice, "_slot"), k, bits)


def _tested(digests: DataFrame, n_rows: int, k: int, bits_per_row: int, max_bits: int) -> DataFrame:
    """digests plus `_maybe`, range by range: one filter of at most max_bits bits at a time."""
    ranges = max(1, -(-n_rows * bits_per_row // max_bits))
    how = {"n_rows": -(-n_rows // ranges), "k": k, "bits_per_row": bits_per_row, "max_bits": max_bits}
    if ranges == 1:
        return cut(possibly_repeated(digests, "_d", **how), "tested")
    dealt = cut(digests.withColumn("_range", F.pmod(F.xxhash64("_d", F.lit(-1)), F.lit(ranges))), "ranges", "_range")  # a range is a folder: each is read once
    return reduce(DataFrame.unionAll, (cut(possibly_repeated(dealt.filter(F.col("_range") == r).drop("_range"), "_d", **how), "tested") for r in range(ranges)))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 2, bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    The row with the longest original text (code points), then the smallest id, stays.
    """
    text = text_or_empty(text_col)
    digests = cut(
        docs.select(F.col(id_col).alias("_id"), F.sha2(normalised(text), 256).alias("_d"), (-F.length(text)).alias("_len"), F.monotonically_increasing_id().alias("_row")),
        "digests",
    )  # written once: from here on a row number names the same row in every task
    tested = _tested(digests, digests.count(), k, bits_per_row, max_bits)
    maybe = tested.filter("_maybe")
    best = F.struct("_len", F.col("_id").isNull().alias("_none"), "_id", "_row")
    groups = cut(maybe.groupBy("_d").agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("_size")), "groups")
    met = maybe.join(groups, "_d").select("_id", F.col("_best._id").alias("_keep"), F.col("_size"), (F.col("_row") == F.col("_best._row")).alias("_kept"), "_d")
    alone = tested.filter("not _maybe").select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"), "_d")
    return met.unionAll(alone).toDF(id_col, "keep_id", "group_size", "kept", "text_sha256")
