"""The tables, and views derived from them, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph
from . import store


def letters(texts: list[str]) -> np.ndarray:
    """The embedding hook without a model: how often a text has each letter from a to z."""
    low = [t.lower().encode() for t in texts]
    row, letter = np.repeat(np.arange(len(low)), [len(t) for t in low]), np.frombuffer(b"".join(low), np.uint8).astype(np.int64) - 97
    plain = (letter >= 0) & (letter < 26)
    return np.bincount(26 * row[plain] + letter[plain], minlength=26 * len(low)).reshape(-1, 26).astype(float)


def letters_sql(text: str) -> str:
    return f"list_transform(range(26), lambda i: (length({text}) - length(replace(lower({text}), chr(97 + i::INT), '')))::DOUBLE)"


#: The same views in SQL, for the oracles.
SQL_VIEWS = {
    "v_document": """SELECT doc_id AS id, 'docs/' || doc_id || '.md' AS doc_path, sha256(text) AS content_hash, length(text) // 4 AS token_estimate,
        CASE WHEN n_chars < 100 THEN 'failed' ELSE 'ready' END AS status, text, source, lang FROM documents""",
    "v_line": """SELECT doc_id, k AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE trim(line) <> ''""",
    "v_chunk": """SELECT *, chunk_index // 10 AS chapter_id FROM (SELECT doc_id * 100000 + line_no AS chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS chunk_index, line AS content FROM v_line)""",
    "v_posting": """SELECT doc_id, chunk_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, chunk_id, regexp_extract_all(lower(content), '[a-záéíóúüñçàèìòùâêîôû0-9]+') AS w FROM v_chunk)""",
    "v_ready_chunk": """SELECT * FROM v_chunk WHERE doc_id IN (SELECT id FROM v_document WHERE status = 'ready')""",
    "v_words": """SELECT doc_id, chunk_id AS id, regexp_extract_all(lower(content), '[a-záéíóúüñçàèìòùâêîôû0-9]+') AS words FROM v_chunk""",
    "v_ready_words": """SELECT doc_id, chunk_id AS id, regexp_extract_all(lower(content), '[a-záéíóúüñçàèìòùâêîôû0-9]+') AS words FROM v_ready_chunk""",
    "v_paraphrase": """SELECT doc_id, id, list_filter(words, lambda x, i: i % 2 = 1) AS words FROM v_words""",
    "v_vec": """SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings""",
    "v_entity": """SELECT s_suppkey AS entity_id, s_name AS name, lower(s_name) AS name_norm, 'supplier' AS kind FROM supplier UNION ALL SELECT p_partkey + 1000000, p_name, lower(p_name), 'part' FROM part""",
    "v_relation": """SELECT l_orderkey * 10 + l_linenumber AS relation_id, l_suppkey AS src, l_partkey + 1000000 AS dst, l_orderkey AS chunk_id, l_shipmode_ AS verb FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem)""",
    "v_query": """SELECT doc_id AS query_id, list_distinct(w)[1] AS a_, w FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-záéíóúüñçàèìòùâêîôû0-9]+'), lambda x: length(x) >= 3)[1:2] AS w FROM documents WHERE doc_id % 50 = 0) WHERE len(w) = 2 AND w[1] <> w[2]""",
    "v_brief": """SELECT o_orderkey AS brief_id, r_name AS brand, c_mktsegment AS bucket, o_orderpriority AS artifact_type, o_orderstatus AS channel, o_totalprice AS price, o_orderdate AS created,
        CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 250000 THEN 'medium' ELSE 'high' END AS risk
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_version": """SELECT o_custkey AS project_id, o_orderkey AS order_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_totalprice AS payload, o_orderdate AS created FROM orders""",
    "v_stage": """SELECT l_orderkey AS order_id, l_linenumber AS step, max(l_linestatus) AS stage, min(o_orderdate) AS entered, min(l_shipdate) AS exited, l_linenumber - 1 AS rework FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY l_orderkey, l_linenumber""",
    "v_telemetry": """SELECT event_id, ts, user_id AS artifact_id, CASE event_type WHEN 'view' THEN 'retention_24h' WHEN 'purchase' THEN 'conversion_30d' END AS metric, CAST(round(value * 100) AS BIGINT) AS cents FROM events""",
    "v_proposition_vec": f"""SELECT prop_id, chunk_id, doc_id, {letters_sql("statement")} AS v FROM v_proposition""",
    "v_query_vec": f"""SELECT query_id, {letters_sql("w[1] || ' ' || w[2]")} AS qv FROM v_query""",
    "v_proposition": """SELECT chunk_id * 1000 + k AS prop_id, chunk_id, doc_id, s AS statement FROM (SELECT chunk_id, doc_id, unnest(string_split(content, '. ')) AS s, generate_subscripts(string_split(content, '. '), 1) AS k FROM v_chunk) WHERE length(s) > 0""",
}


class Views:
    """Lazy plans; nothing is read before a query runs."""

    def __init__(self, spark: SparkSession, sf_dir: str, only: str | None = None, whole: Views | None = None):
        self.spark, self.dir, self.only, self.whole = spark, sf_dir, only, whole
        store.importable(spark)

    def within(self, only: str) -> Views:
        """The views of those documents alone that meet the condition; queries stay those of all documents."""
        return Views(self.spark, self.dir, only, whole=self)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """The table with the long texts, in as many pieces as there are cores at least."""
        rows = store.spread(self.table("documents"))
        return rows if self.only is None else rows.filter(self.only)

    def literal(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def document(self) -> DataFrame:
        d, text = self.documents, F.col("text")
        return d.select(
            F.col("doc_id").alias("id"), F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".md")).alias("doc_path"), X.content_hash(text).alias("content_hash"), X.token_estimate(text).alias("token_estimate"),
            F.when(F.col("n_chars") < 100, "failed").otherwise("ready").alias("status"), "text", "source", "lang",
        )

    @cached_property
    def line(self) -> DataFrame:
        rows = self.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
        return rows.filter(F.trim("line") != "").select("doc_id", (F.col("k") + 1).alias("line_no"), "line")

    @cached_property
    def chunk(self) -> DataFrame:
        return self._chunks(self.documents)

    @cached_property
    def chunk_lists(self) -> DataFrame:
        """doc_id, chunks: a document's chunks (chunk_index, content) in order, in its row."""
        lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
        return self.documents.select("doc_id", F.transform(lines, lambda x, i: F.struct(i.cast("long").alias("chunk_index"), x.alias("content"))).alias("chunks"))

    @staticmethod
    def _chunks(documents: DataFrame) -> DataFrame:
        lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")
        rows = documents.select("doc_id", F.posexplode(lines).alias("chunk_index", "x"))  # numbered inside the row: no shuffle
        return rows.select((F.col("doc_id") * 100000 + F.col("x.line_no")).alias("chunk_id"), "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("x.line").alias("content"), F.expr("chunk_index div 10").alias("chapter_id"))

    @cached_property
    def ready(self) -> DataFrame:
        """doc_id of documents that may be answered from."""
        return self.document.filter("status = 'ready'").select(F.col("id").alias("doc_id"))

    @cached_property
    def ready_chunk(self) -> DataFrame:
        """Chunks of ready documents, by the one scan of these."""
        return self._chunks(self.documents.filter("n_chars >= 100"))

    @cached_property
    def words(self) -> DataFrame:
        """A chunk's words in order, in its row."""
        return self._words(self.chunk)

    @staticmethod
    def _words(chunks: DataFrame) -> DataFrame:
        return chunks.select("doc_id", F.col("chunk_id").alias("id"), X.words(F.col("content"), X.QUERY_WORD).alias("words"))

    @cached_property
    def ready_words(self) -> DataFrame:
        return self._words(self.ready_chunk)

    @cached_property
    def paraphrase(self) -> DataFrame:
        """A second, shorter wording of every chunk, of any document: each other word."""
        return self.words.withColumn("words", F.filter("words", lambda x, i: i % 2 == 0))

    @cached_property
    def posting(self) -> DataFrame:
        return self.chunk.select("doc_id", "chunk_id", F.posexplode(X.words(F.col("content"), X.QUERY_WORD)).alias("p", "token")).select("doc_id", "chunk_id", "token", (F.col("p") + 1).alias("pos"))

    @cached_property
    def illustrated(self) -> DataFrame:
        """Chunks with an image line in one of ten of every third document, as the documents have none."""
        image = F.concat(F.lit("![plate "), F.col("chunk_index"), F.lit("](img/"), F.col("chunk_id"), F.lit(".png) "), F.col("content"))
        return self.chunk.withColumn("content", F.when((F.col("doc_id") % 3 == 0) & (F.col("chunk_index") % 10 == 4), image).otherwise(F.col("content")))

    @cached_property
    def vec(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")

    @cached_property
    def entity(self) -> DataFrame:
        name = lambda c: X.normalise_name(F.col(c))
        s = self.table("supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), name("s_name").alias("name_norm"), F.lit("supplier").alias("kind"))
        return s.unionAll(self.table("part").select(F.col("p_partkey") + 1000000, "p_name", name("p_name"), F.lit("part")))

    @cached_property
    def relation(self) -> DataFrame:
        return self.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"), F.col("l_orderkey").alias("chunk_id"), F.col("l_returnflag").alias("verb"))

    @cached_property
    def query(self) -> DataFrame:
        """Two words each, of every document whose id is divisible by 50; a table, as every channel reads it.

        Other documents' texts are null before their words are taken: a filter works its words out for all rows.
        """
        if self.whole is not None:
            return self.whole.query
        text = F.when(F.col("doc_id") % 50 == 0, F.col("text"))
        w = F.slice(F.filter(X.words(text, X.QUERY_WORD), lambda x: F.length(x) >= 3), 1, 2)
        rows = self.table("documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), w.alias("w")).filter("size(w) = 2 and w[0] <> w[1]")
        return store.kept(rows, "queries")

    @cached_property
    def brief(self) -> DataFrame:
        o, c, n, r = (self.table(t) for t in ("orders", "customer", "nation", "region"))
        rows = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
        risk = F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 250000, "medium").otherwise("high")
        return rows.select(F.col("o_orderkey").alias("brief_id"), F.col("r_name").alias("brand"), F.col("c_mktsegment").alias("bucket"), F.col("o_orderpriority").alias("artifact_type"), F.col("o_orderstatus").alias("channel"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created"), risk.alias("risk"))

    @cached_property
    def version(self) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self.table("orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("order_id"), F.row_number().over(w).alias("version"), F.col("o_totalprice").alias("payload"), F.col("o_orderdate").alias("created"))

    @cached_property
    def stage(self) -> DataFrame:
        """Steps of orders.  Both tables are dealt by order, into pieces of one size: joined and grouped by it, nothing moves again."""
        li, o = self.table("lineitem"), self.table("orders")
        n = li.count()
        li, o = (store.dealt(t.select(*columns), n, columns[0]) for t, columns in ((li, ("l_orderkey", "l_linenumber", "l_linestatus", "l_shipdate")), (o, ("o_orderkey", "o_orderdate"))))
        rows = li.join(o, li.l_orderkey == o.o_orderkey).filter("l_shipdate >= o_orderdate")
        each = rows.groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("step")).agg(F.max("l_linestatus").alias("stage"), F.min("o_orderdate").alias("entered"), F.min("l_shipdate").alias("exited"))
        return each.withColumn("rework", F.col("step") - 1)

    @cached_property
    def telemetry(self) -> DataFrame:
        metric = F.when(F.col("event_type") == "view", "retention_24h").when(F.col("event_type") == "purchase", "conversion_30d")
        return self.table("events").select("event_id", "ts", F.col("user_id").alias("artifact_id"), metric.alias("metric"), F.round(F.col("value") * 100).cast("long").alias("cents"))

    @cached_property
    def proposition_vec(self) -> DataFrame:
        """prop_id, chunk_id, doc_id, v: every proposition's vector, from the embedding hook once, as a table."""
        return store.kept(graph.embed(self.proposition, letters, "statement", batch=1024).drop("statement"), "proposition-vectors")

    @cached_property
    def query_vec(self) -> DataFrame:
        """query_id, qv: the vectors of the word queries, from the same hook."""
        asked = self.query.select("query_id", F.array_join("w", " ").alias("text"))
        return graph.embed(asked, letters, "text").select("query_id", F.col("v").alias("qv"))

    @cached_property
    def proposition(self) -> DataFrame:
        rows = self.chunk.select("chunk_id", "doc_id", F.posexplode(F.split("content", r"\. ", -1)).alias("k", "statement")).filter("length(statement) > 0")
        return rows.select((F.col("chunk_id") * 1000 + F.col("k") + 1).alias("prop_id"), "chunk_id", "doc_id", "statement")
