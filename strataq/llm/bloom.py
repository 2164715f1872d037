"""A Bloom filter as Spark bitmaps: built and tested by DataFrame functions.

Bits live in 4 KB bitmaps, one per bucket of slots, broadcast as arrays of 512
longs under a fixed bound of max_bits / 8 bytes: a test reads one long where it
lies, no bitmap is copied per row.  A key that was put in always tests true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One bitmap bucket of Spark's bitmap functions holds so many bits.
BUCKET_BITS = 32768


def filter_bits(keys: int, bits_per_key: int = 16, max_bits: int = 1 << 30) -> int:
    """A power of two near keys * bits_per_key, at most max_bits."""
    want = max(BUCKET_BITS, keys * bits_per_key)
    return min(1 << (want - 1).bit_length(), max_bits)


def slots(key: Column, k: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(k)]


def bitmaps(slot_rows: DataFrame, slot: str) -> DataFrame:
    """_bucket, _bitmap with a bit for each slot in slot_rows."""
    return slot_rows.groupBy(F.expr(f"{slot} div {BUCKET_BITS}").alias("_bucket")).agg(F.bitmap_construct_agg(F.pmod(F.col(slot), F.lit(BUCKET_BITS))).alias("_bitmap"))


def test(rows: DataFrame, key: Column, maps: DataFrame, k: int, bits: int) -> DataFrame:
    """rows plus boolean `_maybe`: all k slots of the key are set."""
    out, maybe = rows, F.lit(True)
    longs = F.expr(f"transform(sequence(0, {BUCKET_BITS // 64 - 1}), i -> cast(conv(hex(substring(_bitmap, 8 * i + 1, 8)), 16, -10) as long))")  # big-endian
    for i, slot in enumerate(slots(key, k, bits)):
        one = F.broadcast(maps.select(F.col("_bucket").alias(f"_b{i}"), longs.alias(f"_m{i}")))  # bits / 8 bytes
        out = out.withColumn(f"_s{i}", slot).withColumn(f"_b{i}", F.expr(f"_s{i} div {BUCKET_BITS}")).join(one, f"_b{i}", "left")
        held = F.get(f"_m{i}", F.expr(f"cast(pmod(_s{i}, {BUCKET_BITS}) div 64 as int)"))
        place = F.expr(f"cast((7 - pmod(_s{i} div 8, 8)) * 8 + pmod(_s{i}, 8) as int)")  # bits of a byte from its least
        maybe = maybe & (F.coalesce(F.getbit(held, place).cast("int"), F.lit(0)) == 1)
    return out.withColumn("_maybe", maybe).drop(*(f"_{c}{i}" for i in range(k) for c in "sbm"))


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, *, k: int = 2, max_bits: int = 1 << 30) -> DataFrame:
    """rows plus `_maybe`: false only where the key is surely not in keys (one long column, written out)."""
    bits = filter_bits(keys.count(), max_bits=max_bits)
    put = keys.select(F.explode(F.array(*slots(F.col(keys.columns[0]), k, bits))).alias("_slot"))
    return test(rows, key, bitmaps(put, "_slot"), k, bits)
