"""Ingestion: splitting, ranges, upserts, budgets and stage decisions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def write_files(rows: DataFrame, path: str) -> None:
    """A file of its own for each row (name, content: binary) under path, in any store that Arrow reaches; a retried task puts the same files in place again."""
    path = path if "://" in path else f"file://{path}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pa.fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = f"{top}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, f"{top}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.select("name", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()


def scan_files(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, text, error of every file below path: one bad file is a row with an error, never a failed job.

    error: 'empty' (nothing but white space), 'bad bytes' (no UTF-8) or 'unreadable' (listed, but gone or not to be read);
    the text is null with the last two.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store, todo, listed = where.getFileSystem(spark._jsc.hadoopConfiguration()), [where], []
    while todo:
        for status in store.listStatus(todo.pop()):  # plain statuses: located ones have a local store start a process per file
            if status.isDirectory():
                todo.append(status.getPath())
            elif fnmatchcase(status.getPath().getName(), glob):
                listed.append((status.getPath().toString(), status.getLen()))
    files = spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup="true", ignoreMissingFiles="true", ignoreCorruptFiles="true").load(path)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    names = spark.createDataFrame(listed, "path string, size long").select(plain("path").alias("path"), "size")
    read = files.select(plain("path").alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("_text"), F.lit(True).alias("_read"))
    text = F.when(F.col("size") == 0, "").otherwise(F.col("_text"))  # files without bytes are in no split
    error = F.when(F.col("size") == 0, "empty").when(F.col("_read").isNull(), "unreadable").when(F.col("_text").isNull(), "bad bytes").when(F.col("_text").rlike(r"^\s*$"), "empty")
    return names.join(read, "path", "left").select("path", text.alias("text"), error.alias("error"))


def numbered_lines(text: Column) -> Column:
    """array<struct<line_no, line>>, from 1."""
    return F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))


def headings(text: Column) -> Column:
    """The H1-H3 lines with their numbers."""
    return F.filter(numbered_lines(text), lambda x: x["line"].rlike(r"^#{1,3}\s+"))


def split_books(docs: DataFrame, *, min_lines: int = 50, back: int = 300) -> DataFrame:
    """doc_id, line_start, line_end, title of each logical document of a file.

    An ISBN line starts a book at the nearest separator line before it, within
    `back` lines; shorter spans than min_lines go.
    """
    lines = docs.select("doc_id", F.inline(numbered_lines(F.col("text"))))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-back, -1)
    whole = Window.partitionBy("doc_id").orderBy("line_no")
    sep = F.last(F.when(F.col("line").rlike(r"^\s*[-=_]{3,}\s*$"), F.col("line_no")), ignorenulls=True).over(before)
    marks = lines.withColumn("_start", F.when(F.col("line").rlike("ISBN"), F.coalesce(sep + 1, F.lit(1)))).withColumn("_last", F.max("line_no").over(Window.partitionBy("doc_id")))
    starts = marks.filter("_start is not null").groupBy("doc_id", "_start").agg(F.max("_last").alias("_last"))
    spans = starts.select("doc_id", F.col("_start").alias("line_start"), F.coalesce(F.lead("_start").over(Window.partitionBy("doc_id").orderBy("_start")) - 2, F.col("_last")).alias("line_end"))
    spans = spans.filter(F.col("line_end") - F.col("line_start") + 1 >= min_lines)
    heads = lines.filter(F.col("line").rlike(r"^#\s")).select("doc_id", F.col("line_no").alias("_at"), F.regexp_replace("line", r"^#\s+", "").alias("_head"))
    named = spans.join(heads, "doc_id", "left").filter("_at is null or _at between line_start and least(line_end, line_start + 99)")
    return named.groupBy("doc_id", "line_start", "line_end").agg(F.min_by("_head", "_at").alias("title"))


def merge_ranges(rules: DataFrame, model: DataFrame, key: str = "id") -> DataFrame:
    """Ranges (s, e) by rule, and those of the model that overlap none of them."""
    r = rules.select(F.col(key).alias("_id"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    own = model.join(r, (F.col(key) == F.col("_id")) & (F.col("s") <= F.col("_e")) & (F.col("_s") <= F.col("e")), "left_anti")
    return rules.withColumn("origin", F.lit("rule")).unionByName(own.withColumn("origin", F.lit("model")))


def unique_ids(ids: Column) -> Column:
    """An ordered array of ids with later repetitions as id_2, id_3, ..: the first number that no id before has taken; an empty id counts as doc."""

    def step(out: Column, x: Column) -> Column:
        base = F.when(x == "", "doc").otherwise(x)
        free = F.filter(F.transform(F.sequence(F.lit(2), F.size(out) + 2), lambda n: F.concat_ws("_", base, n)), lambda c: ~F.array_contains(out, c))
        return F.concat(out, F.array(F.when(F.array_contains(out, x), free[0]).otherwise(x)))

    return F.aggregate(ids, F.array().cast("array<string>"), step)


def image_references(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, image of markdown and HTML images."""
    lines = docs.select("doc_id", F.inline(numbered_lines(F.col("text"))))
    return lines.select("doc_id", "line_no", F.explode(F.concat(X.markdown_images(F.col("line")), X.html_images(F.col("line")))).alias("image"))


def upsert(old: DataFrame, new: DataFrame, *, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest order."""
    rows = old.unionByName(new)
    rest = F.struct(order, *(c for c in rows.columns if c not in keys and c != order))
    return rows.groupBy(*keys).agg(F.max(rest).alias("_r")).select(*keys, "_r.*")


def insert_or_ignore(old: DataFrame, new: DataFrame, *, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def replace_by_key(old: DataFrame, new: DataFrame, *, keys: list[str]) -> DataFrame:
    """Delete what new has, then insert it."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def _numbered(starts: Column, n: Column) -> Column:
    """Group number of each of n items whose groups start at the given places, the first at 0."""
    return F.flatten(F.transform(starts, lambda at, g: F.array_repeat(g.cast("long"), (F.coalesce(F.get(starts, g + 1), n) - at).cast("int"))))


def packed(items: Column, budget: int) -> Column:
    """Group number of each item of an ordered array<long> of sizes: greedy, a new group where the sum would pass budget.

    The walk keeps the places where groups start, so what it copies grows with the groups and not with the items.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"), F.array(F.lit(0)).alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["sum"] > 0) & (acc["sum"] + x > budget)
        starts = F.when(new, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"])
        return F.struct((acc["at"] + 1).alias("at"), F.when(new, x).otherwise(acc["sum"] + x).alias("sum"), starts.alias("starts"))

    starts = F.aggregate(items, start, step, lambda acc: acc["starts"])
    return F.when(F.size(items) > 0, F.transform(F.array(starts), lambda s: _numbered(s, F.size(items)))[0]).otherwise(F.array().cast("array<bigint>"))


def greedy_groups(rows: DataFrame, *, key: str, order: str, size: str, budget: int) -> DataFrame:
    """rows with `group`: consecutive rows of a key packed under a budget (one key's rows are one array)."""
    each = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, size))).alias("_rows"))
    numbered = each.withColumn("_group", packed(F.transform("_rows", lambda r: r[size].cast("long")), budget))
    return numbered.select(key, F.inline(F.arrays_zip("_rows", "_group"))).select(key, f"_rows.{order}", f"_rows.{size}", F.col("_group").alias("group"))


def islands(rows: DataFrame, *, key: str, order: str, value: str) -> DataFrame:
    """rows with `island`: the number of changes of value so far within the key."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("long"), F.lit(0))
    return rows.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(w)).drop("_changed")


def island_groups(chunks: DataFrame, *, most: int = 30_000) -> DataFrame:
    """chunks (doc_id, chapter_id, n) with `grp`: the chapter where it has more than `most` tokens, -1 for all others of the document."""
    w = Window.partitionBy("doc_id", "chapter_id")
    return chunks.withColumn("grp", F.when(F.sum("n").over(w) > most, F.col("chapter_id")).otherwise(-1))


def proposition_batches(chunks: DataFrame, *, most: int = 30_000, budget: int = 1500) -> DataFrame:
    """doc_id, grp, batch, chunks, tokens: island groups packed in order under the token budget of one call."""
    rows = island_groups(chunks, most=most).withColumn("_key", F.struct("doc_id", "grp"))
    packed_ = greedy_groups(rows, key="_key", order="chunk_index", size="n", budget=budget)
    return packed_.groupBy("_key", F.col("group").alias("batch")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("tokens")).select("_key.*", "batch", "chunks", "tokens")


def flat_index(docs: DataFrame) -> DataFrame:
    """doc_id, pos, chapter: chapters of an index of parts, or of a flat one where there are no parts; an id that comes again gets a number.

    docs: doc_id, index (JSON text).
    """
    chapter = "array<struct<id: string>>"
    index = F.from_json("index", f"parts array<struct<chapters: {chapter}>>, chapters {chapter}")
    chapters = F.coalesce(F.flatten(F.transform(index["parts"], lambda p: p["chapters"])), index["chapters"])
    rows = docs.select("doc_id", F.posexplode(chapters).alias("pos", "c")).select("doc_id", "pos", F.col("c.id").alias("id"))
    k = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("pos"))
    return rows.withColumn("k", k).select("doc_id", "pos", F.when(F.col("k") > 1, F.concat_ws("-", "id", "k")).otherwise(F.col("id")).alias("chapter"))


def figures(chunks: DataFrame) -> DataFrame:
    """doc_id, figure (number in order), image, caption, chunk_id of markdown images; documents without any give no rows."""
    found = F.regexp_extract_all("content", F.lit(r"!\[[^\]]*\]\([^)]*\)"), F.lit(0))
    each = chunks.filter(F.contains("content", F.lit("!["))).select("doc_id", "chunk_id", "chunk_index", F.posexplode(found).alias("at", "mark"))
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "at")
    image, caption = F.regexp_extract("mark", r"\]\(([^)\s]+)", 1), F.regexp_extract("mark", r"!\[([^\]]*)\]", 1)
    return each.select("doc_id", F.row_number().over(w).alias("figure"), image.alias("image"), caption.alias("caption"), "chunk_id")


def resume_stage(done: Column, stages: list[str]) -> Column:
    """The stage after the last completed one; the first if none; null after the last."""
    names = F.array(*map(F.lit, stages))
    return F.get(names, F.coalesce(F.array_position(names, done), F.lit(0)).cast("int"))


def after_table_head(page: Column, row: Column) -> Column:
    """page with row after the first table's head; at its end where there is no table."""
    lines = F.split(page, "\n", -1)
    rules = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^\|[-|: ]+\|$"), i + 1)), lambda i: i.isNotNull())
    at = F.coalesce(F.get(rules, F.lit(0)), F.size(lines))
    return F.array_join(F.concat(F.slice(lines, F.lit(1), at), F.array(row), F.slice(lines, at + 1, F.size(lines))), "\n")


def stages_to_clean(done: Column, stages: list[str]) -> Column:
    """What a resumed run has to remove: all stages after the last completed one."""
    names = F.array(*map(F.lit, stages))
    return F.slice(names, F.coalesce(F.array_position(names, done), F.lit(0)).cast("int") + 1, len(stages))


def segment_shift(sims: Column, least: float) -> Column:
    """Segment number per sentence: a new one where similarity to the one before is under least."""
    shifts = F.filter(F.transform(sims, lambda x, i: F.when(x < least, i)), lambda i: i.isNotNull())
    first = F.when(F.get(sims, F.lit(0)) < least, F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    # a shift at the first sentence makes its segment number 1
    number = F.transform(F.array(F.concat(first, shifts)), lambda s: _numbered(s, F.size(sims)))[0]
    base = F.when(F.get(sims, F.lit(0)) < least, 1).otherwise(0)
    return F.when(F.size(sims) > 0, F.transform(number, lambda g: (g + base).cast("int"))).otherwise(F.array().cast("array<int>"))
