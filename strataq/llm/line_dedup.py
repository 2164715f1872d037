"""Boilerplate lines by site-relative frequency, in DataFrame functions only.

Group by host, divide the pages that contain a line by the host's pages, drop
the line where the ratio exceeds a limit.  Line counts combine on the map side
under a 128-bit line key, so neither a hot host nor a hot line meets in one
task; only lines past the limit (at most lines-per-page / ratio per host) come
back, as one array per host, to the rows that carry the texts.

Defined results: a null text stays null and has no lines; lines of white space
only are never dropped and count nowhere; a line that repeats within one page
counts once for it and is dropped at every place.  A null host is a host of its
own.  The ratio alone decides at every size of host; only a line that stands on
one page alone has nothing to be boilerplate of.  Whole texts of any length are split.  Repeated rows are pages of
their own.  Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, whole_row

_NO_HOST = "\x00null"


def _key(line: Column) -> Column:
    """128 bits that name a line."""
    return F.concat(F.hex(F.xxhash64(line)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), line)))


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, SPACE, "")) > 0


def boilerplate_lines(docs: DataFrame, *, text_col: str, host_col: str, max_ratio: float) -> DataFrame:
    """(_host, _line key, _pages, _ratio) of every line past the limit."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(_NO_HOST)).alias("_host")
    rows = docs.select(host, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("_lines"))
    totals = docs.select(host).groupBy("_host").agg(F.count(F.lit(1)).alias("_total"))
    keys = F.array_distinct(F.transform(F.filter("_lines", _has_word), _key))
    counted = (
        rows.select("_host", F.explode(keys).alias("_line"))
        .groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_pages")).filter("_pages > 1")
    )
    return counted.join(totals, "_host").withColumn("_ratio", F.col("_pages") / F.col("_total")).filter(F.col("_ratio") > max_ratio)


def line_dedup(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_ratio: float = 0.05, counts: bool = False) -> DataFrame:
    """docs with text_col rebuilt from the lines that stay; with counts also n_lines and n_dropped (in place of columns so named)."""
    host_lines = cut(
        boilerplate_lines(docs, text_col=text_col, host_col=host_col, max_ratio=max_ratio)
        .groupBy("_host").agg(F.collect_set("_line").alias("_drop")),
        "boilerplate",
    )
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(_NO_HOST))
    # one array per host: broadcast by Spark below its size limit, else both sides are sorted and hot hosts split
    rows = docs.select(whole_row(docs).alias("_r"), host.alias("_host")).join(host_lines, "_host", "left")
    text = F.col(f"_r.`{text_col}`")
    lines = F.split(text, "\n", -1)
    stay = F.when(F.col("_drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~_has_word(x) | ~F.array_contains(F.col("_drop"), _key(x))))
    rows = rows.select("_r", "_drop", stay.alias("_stay"))
    kept = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join("_stay", "\n"))
    extra = {"n_lines": F.size(lines), "n_dropped": F.size(lines) - F.size("_stay")} if counts else {}
    own = [(kept if c == text_col else F.col(f"_r.`{c}`")).alias(c) for c in docs.columns if c not in extra]
    return rows.select(*own, *(F.coalesce(n, F.lit(0)).cast("long").alias(c) for c, n in extra.items()))
