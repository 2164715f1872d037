"""Order MinHash: fingerprints whose agreement follows edit distance, in DataFrame functions only.

A text is a sequence of units (runs of up to 16 characters without white space, by
default), its k-mers are k units in a row (all units, where there are fewer), and each
k-mer carries its occurrence number, so that repeats count.  Every numbered k-mer has
one hash on a ring; sketch j takes the `pick` numbered k-mers that follow the j-th of
`sketches` even points of the ring, which are the least under that rotation of the
hash.  It puts them back in text order and hashes the tuple of k-mers.  Two texts agree
in a sketch where they share the chosen k-mers and their order, so moved passages lower
the likeness as edits do; it is the share of sketches that agree.

All of it happens in the row: hashes and positions share one long (33 + 31 bits), so
k-mers are numbered and ringed by two sorts of arrays of longs, and the ring's points
are sorted in among them.  The work is linear in the text but for these sorts, and no
k-mer leaves its row.

Defined results: a null text counts as empty; texts without units have one common
fingerprint; texts of any length are used whole.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

UNIT = r"[^\x20\x09-\x0D]{1,16}"
_LOW = (1 << 31) - 1  # the bits of a position
#: Copies of one row leave a task in blocks of so many.
COPIES = 1 << 16


def _high(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_LOW))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def with_fingerprint(df: DataFrame, text: str, out: str, *, k: int = 3, pick: int = 2, sketches: int = 64, unit: str = UNIT) -> DataFrame:
    """df plus array<int> `out` of the text column `text`; working columns are named by `out` and gone afterwards.

    Each step is a column of its own and is used twice or more in the next ones, so that no step is
    written out inside another's lambda, where it would be worked out for every element.
    """
    names = {x: f"{out}__{x}" for x in ("unit", "mer", "sorted", "later", "run", "ring", "point", "around")}
    unit_, mer, sorted_, later, run, ring, point, around = (F.col(f"`{n}`") for n in names.values())
    none = F.array().cast("array<bigint>")
    same = lambda a: lambda v, i: (i > 0) & (_high(v) == _high(F.get(a, i - 1)))
    points = F.array(*(F.lit(-(1 << 63) + (j << 64) // sketches | _LOW) for j in range(sketches)))
    one = lambda i: _high(F.xxhash64(*(F.get(unit_, i + j) for j in range(k)))).bitwiseOR(i.cast("long"))
    df = df.withColumn(names["unit"], F.regexp_extract_all(F.col(f"`{text}`"), F.lit(unit), F.lit(0)))
    df = df.withColumn(names["mer"], F.when(F.size(unit_) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(unit_) - k, F.lit(0))), one)).otherwise(none))
    df = df.withColumn(names["sorted"], F.sort_array(mer))
    df = df.withColumn(names["later"], F.filter(sorted_, same(sorted_)))  # second and later occurrences, k-mer by k-mer
    df = df.withColumn(names["run"], F.when(F.size(later) > 0, F.filter(F.sequence(F.lit(0), F.size(later) - 1), lambda i: (i == 0) | (_high(F.get(later, i)) != _high(F.get(later, i - 1))))).otherwise(F.array().cast("array<int>")))
    number = F.flatten(F.transform(run, lambda x, i: F.sequence(F.lit(2), F.coalesce(F.get(run, i + 1), F.size(later)) - x + 1)))
    numbered = F.zip_with(later, number, lambda v, o: F.coalesce(_high(F.xxhash64(_high(v), o)).bitwiseOR(_low(v)), F.lit(0).cast("long")))
    first = F.filter(sorted_, lambda v, i: (i == 0) | (_high(v) != _high(F.get(sorted_, i - 1))))
    df = df.withColumn(names["ring"], F.sort_array(F.concat(first, numbered, points)))
    df = df.withColumn(names["point"], F.filter(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: _low(F.get(ring, i)) == _LOW))
    only = F.filter(ring, lambda v: _low(v) != _LOW)
    df = df.withColumn(names["around"], only).withColumn(names["around"], F.concat(around, F.slice(around, 1, pick)))  # the ring closes
    take = F.least(F.lit(pick), (F.size(around) / 2).cast("int"))  # all, where there are fewer
    in_text = lambda x, j: F.sort_array(F.transform(F.slice(around, x - j + 1, take), _low))
    tuple_ = lambda x, j: F.xxhash64(F.transform(in_text(x, j), lambda p: _high(F.get(mer, p.cast("int")))))
    df = df.withColumn(out, F.transform(point, lambda x, j: F.shiftright(tuple_(x, j), 32).cast("int")))
    return df.drop(*names.values())


def likeness(a: Column, b: Column) -> Column:
    """Share of sketches that agree, 0 to 1."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return agree.cast("double") / F.size(a)


def as_hex(fingerprint: Column) -> Column:
    digits = lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.array_join(F.transform(fingerprint, digits), "")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: id, n_chars, fingerprint (array<int>)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(f"`{text_col}`").alias("_text"))
    rows = with_fingerprint(rows, "_text", "_fp", **how)
    return rows.select(F.col("_id").alias(id_col), F.length("_text").cast("long").alias("n_chars"), F.col("_fp").alias("fingerprint"))


def _successors(rows: DataFrame) -> DataFrame:
    """Distinct (_i, _h) of rows with _chars and _copies, and the _i, _h of the next one by descending _id (then _h); the first follows the last.

    Only ids, hashes and lengths move.  Classes are sorted by range and numbered by place (partition, then place in
    it), so the next one's number is known but at partition ends; those (a row per partition) go through the driver.
    """
    classes = rows.groupBy("_i", "_h").agg(F.first("_id").alias("_id"), F.first("_chars").alias("_chars"), F.count(F.lit(1)).alias("_copies"))
    order = [F.col("_id").desc_nulls_last(), F.col("_h"), F.col("_i")]
    placed = cut(classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_o", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_o", 33)
    ends = sorted(tuple(r) for r in placed.groupBy(part.alias("_p")).agg(F.min("_o"), F.max("_o")).collect())
    turns = [(p, last, ends[(k + 1) % len(ends)][1]) for k, (p, _, last) in enumerate(ends)]
    turns = F.broadcast(rows.sparkSession.createDataFrame(turns, "_p long, _last long, _first long"))  # a row per partition
    at = placed.withColumn("_p", part).join(turns, "_p").withColumn("_next", F.when(F.col("_o") == F.col("_last"), F.col("_first")).otherwise(F.col("_o") + 1))
    following = placed.select(F.col("_o").alias("_next"), F.col("_i").alias("_ni"), F.col("_h").alias("_nh"))
    return at.join(following, "_next").select("_i", "_h", "_chars", "_copies", "_ni", "_nh")


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.

    The edited text has its last third of code points (rounded down) replaced by as many first code points of the
    next row's text (all, where it has fewer), by descending id; null ids come last, equal ids go by the text's hash,
    equal rows follow each other, and the first row follows the last.

    Each distinct row is fingerprinted where it is read, moves once with its fingerprint, and meets what its
    predecessor needs of it: a third of the predecessor's length, cut off before it moves again.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(f"`{text_col}`").alias("_text"))
    rows = rows.select("_id", F.xxhash64(F.lit(1), "_id").alias("_i"), F.xxhash64("_text").alias("_h"), "_text", F.length("_text").cast("long").alias("_chars"))
    after = _successors(rows.drop("_text"))
    whole = F.first(F.struct("_id", "_text", "_chars", "_fp")).alias("_row")  # one column: both uses below read the same exchange
    classes = with_fingerprint(rows, "_text", "_fp", **how).groupBy("_i", "_h").agg(whole)
    third = lambda n: F.floor(n / 3).cast("int")

    lent = after.select(F.col("_i").alias("_pi"), F.col("_h").alias("_ph"), F.col("_chars").alias("_need"), F.col("_ni").alias("_i"), F.col("_nh").alias("_h")).join(classes, ["_i", "_h"])
    lent = lent.select(F.col("_pi").alias("_i"), F.col("_ph").alias("_h"), F.substring("_row._text", F.lit(1), third(F.col("_need"))).alias("_head"), F.col("_row._fp").alias("_next_fp"))
    own = classes.join(lent, ["_i", "_h"]).withColumn("_more", F.lit(1).cast("long"))
    # copies of a row: all but the last are followed by an equal one
    copied = classes.join(after.filter("_copies > 1").select("_i", "_h", "_copies"), ["_i", "_h"])
    copied = copied.select("_i", "_h", "_row", F.substring("_row._text", F.lit(1), third(F.col("_row._chars"))).alias("_head"), F.col("_row._fp").alias("_next_fp"), (F.col("_copies") - 1).alias("_more"))

    def finished(met: DataFrame) -> DataFrame:
        met = met.withColumn("_edited", F.concat(F.substring("_row._text", F.lit(1), (F.col("_row._chars") - third(F.col("_row._chars"))).cast("int")), F.col("_head")))
        met = with_fingerprint(met.select("_i", "_h", "_more", "_edited", "_next_fp", F.col("_row._id").alias("_id"), F.col("_row._chars").alias("_chars"), F.col("_row._fp").alias("_fp")), "_edited", "_efp", **how)
        return met.select(
            "_i", "_h", "_more", "_id", "_chars", F.sha2("_edited", 256).alias("_sha"), as_hex(F.col("_fp")).alias("_hex"), as_hex(F.col("_efp")).alias("_ehex"),
            likeness(F.col("_fp"), F.col("_efp")).alias("_near"), likeness(F.col("_fp"), F.col("_next_fp")).alias("_near_next"),
        )

    blocks = F.expr(f"sequence(0L, (_more - 1) div {COPIES})")
    dealt = finished(copied).withColumn("_block", F.explode(blocks)).repartition("_i", "_h", "_block")
    each = F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("_more") - F.col("_block") * COPIES).cast("int")))
    out = finished(own).select("_id", "_chars", "_sha", "_hex", "_ehex", "_near", "_near_next")
    out = out.unionAll(dealt.withColumn("_copy", each).select(*out.columns))
    return out.toDF(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
