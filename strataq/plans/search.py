"""Retrieval (R) and graph (G) queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph, ingest, ranking, retrieval
from ..sources import store
from ..sources.views import letters, letters_sql
from .registry import query

_READY = " AND b.vec_id IN (SELECT id FROM v_document WHERE status = 'ready')"


def _knn_sql(k: int, name: str = "dense", where: str = _READY) -> str:
    return f"""all_{name} AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM v_vec a, v_vec b WHERE a.vec_id % 50 = 0{where}),
  {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM all_{name} QUALIFY rank <= {k})"""


def _cover_sql(rows: str = "v_ready_words", name: str = "lex", k: int = 20) -> str:
    """Cover density of two-word queries over rows (id, words): {name} all, {name}r the best k."""
    return f"""hits_{name} AS (SELECT query_id, id, pos, words[pos] = w[1] AS first_ FROM (SELECT query_id, id, w, words, unnest(range(1, len(words) + 1)) AS pos FROM v_query JOIN {rows} ON list_contains(words, w[1]) AND list_contains(words, w[2])) WHERE words[pos] = w[1] OR words[pos] = w[2]),
  runs_{name} AS (SELECT *, max(CASE WHEN first_ THEN pos END) OVER o AS p1, max(CASE WHEN NOT first_ THEN pos END) OVER o AS p2 FROM hits_{name} WINDOW o AS (PARTITION BY query_id, id ORDER BY pos)),
  covers_{name} AS (SELECT query_id, id, least(p1, p2) AS s, min(pos) AS e FROM runs_{name} WHERE p1 IS NOT NULL AND p2 IS NOT NULL GROUP BY ALL),
  {name} AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (1 + e - s - 1)), 9) AS score FROM covers_{name} GROUP BY ALL),
  {name}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name} QUALIFY rank <= {k})"""


_KNEE = """c AS (SELECT query_id, id, score, row_number() OVER o - 1 AS i, count(*) OVER p AS n, max(score) OVER p AS hi, min(score) OVER p AS lo FROM lists WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, id), p AS (PARTITION BY query_id)),
  d1 AS (SELECT *, CASE WHEN n >= 3 AND hi - lo >= 1e-12 THEN 1 - i::DOUBLE / (n - 1) - (score - lo) / (hi - lo) END AS d FROM c),
  d2 AS (SELECT *, max(d) OVER p AS top, avg(d) OVER p AS mean, lag(d) OVER o AS a, lead(d) OVER o AS b FROM d1 WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, id), p AS (PARTITION BY query_id)),
  k AS (SELECT query_id, arg_min(score, i) AS knee, min(i) AS knee_index FROM d2 WHERE top >= 0.01 AND d >= a AND d >= b AND d >= top - mean GROUP BY query_id)"""


def _dense(v, k):
    """Vectors of documents that are ready, nearest first."""
    q = v.vec.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    allowed = v.ready.select(F.col("doc_id").alias("id"))
    return retrieval.nearest(q, v.vec.select(F.col("vec_id").alias("id"), "v").join(allowed, "id", "left_semi"), k)


def _lexical(v, k=20, rows=None):
    return retrieval.cover_density(v.query, (v.ready_words if rows is None else rows).select("id", "words"), k)


@query("r01_dense_search", "WITH " + _knn_sql(8) + " SELECT query_id, id, rank FROM dense")
def r01(v):
    return _dense(v, 8).select("query_id", "id", "rank")


@query("r02_lexical_search", "WITH " + _cover_sql() + " SELECT query_id, id, round(score, 6) AS score, rank FROM lexr")
def r02(v):
    return _lexical(v).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("r02s_cover_density", "WITH " + _cover_sql("v_words") + " SELECT query_id, id, round(score, 6) AS score FROM lex")
def r02s(v):
    return retrieval.cover_density(v.query, v.words.select("id", "words")).select("query_id", "id", F.round("score", 6).alias("score"))


_BRIEFS = """brief_lists AS (SELECT brand_id AS query_id, o_custkey AS id, row_number() OVER (PARTITION BY brand_id, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM (SELECT *, o_orderkey % 20 AS brand_id FROM orders) QUALIFY rank <= 40)"""


def _ranked_orders(v):
    o = v.table("orders").withColumn("query_id", F.col("o_orderkey") % 20)
    w = Window.partitionBy("query_id", "o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).filter("rank <= 40").select("query_id", F.col("o_custkey").alias("id"), "rank")


@query("r03_rrf_merge", "WITH " + _BRIEFS + " SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM brief_lists GROUP BY ALL")
def r03(v):
    return ranking.fuse(_ranked_orders(v))


@query("r04_paraphrase_search", "WITH " + _cover_sql("v_paraphrase", "par") + " SELECT query_id, id, rank FROM parr")
def r04(v):
    """Over the second wording of every chunk, whatever its document's status."""
    return _lexical(v, rows=v.paraphrase).select("query_id", "id", "rank")


def _proposition_sql(k: int, where: str = "") -> str:
    return f"""prop_all AS (SELECT query_id, prop_id, chunk_id, round(list_cosine_similarity(qv, v), 9) AS score FROM v_query_vec, v_proposition_vec WHERE list_sum(v) > 0 AND list_sum(qv) > 0{where}),
  prop AS (SELECT query_id, chunk_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prop_id) AS rank FROM prop_all QUALIFY rank <= {k})"""


def _propositions(v, k):
    """The k nearest propositions, as their chunks: a chunk with two of them stands twice, with both ranks."""
    hits = retrieval.nearest(v.query_vec, v.proposition_vec.select(F.col("prop_id").alias("id"), "v"), k)
    return hits.select("query_id", F.expr("id div 1000").alias("id"), "rank")


@query("r05_proposition_search", "WITH " + _proposition_sql(12) + " SELECT query_id, id AS chunk, rank FROM prop")
def r05(v):
    return _propositions(v, 12).withColumnRenamed("id", "chunk")


def _hybrid_sql(only: str = "") -> str:
    """only: a condition on a document's id, pushed into every channel."""
    where = lambda c: f" AND {c} IN (SELECT doc_id FROM documents WHERE {only})" if only else ""
    rows = lambda view: f"(SELECT * FROM {view} WHERE true{where('doc_id')})"
    return "WITH " + ", ".join((_knn_sql(20, where=_READY + where("b.vec_id")), _cover_sql(rows("v_ready_words")), _cover_sql(rows("v_paraphrase"), "par"), _proposition_sql(20, where("doc_id")))) + """,
  channels AS (SELECT query_id, id * 100000 + 1 AS id, rank FROM dense UNION ALL SELECT query_id, id, rank FROM lexr UNION ALL SELECT query_id, id, rank FROM parr UNION ALL SELECT query_id, id, rank FROM prop),
  lists AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM channels GROUP BY ALL),
  fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lists QUALIFY rank <= 20)"""


_HYBRID = _hybrid_sql()


def _hybrid(v, use=("dense", "lexical", "paraphrase", "proposition")):
    """The four channels that are switched on, fused; each searches the documents of v alone."""
    channels = {
        "dense": lambda: _dense(v, 20).withColumn("id", F.col("id") * 100000 + 1),  # a document's vector stands for its first chunk
        "lexical": lambda: _lexical(v),
        "paraphrase": lambda: _lexical(v, rows=v.paraphrase),
        "proposition": lambda: _propositions(v, 20),
    }
    return retrieval.hybrid({name: channels[name] for name in use}, 20)


@query("r06_hybrid_search", _HYBRID + " SELECT query_id, id, score, rank FROM fused")
def r06(v):
    return _hybrid(v)


@query("r07_summary_search", "WITH " + _knn_sql(10, where="") + ", " + _cover_sql("(SELECT id, words FROM v_words WHERE id IN (SELECT min(chunk_id) FROM v_chunk GROUP BY doc_id, chapter_id))", "sec", 10) + ", " + _cover_sql("(SELECT doc_id AS id, words FROM v_words WHERE id IN (SELECT min(chunk_id) FROM v_chunk GROUP BY doc_id))", "doc", 10) + """,
  l AS (SELECT query_id, 'document' AS level, 'dense' AS source, id, score, rank FROM dense UNION ALL SELECT query_id, 'document', 'lexical', id, score, rank FROM docr UNION ALL SELECT query_id, 'section', 'lexical', id, score, rank FROM secr),
  n AS (SELECT query_id, level, count(DISTINCT source) AS n FROM l GROUP BY ALL), f AS (SELECT query_id, level, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(score) AS raw FROM l GROUP BY ALL)
  SELECT query_id, level, id, row_number() OVER (PARTITION BY query_id, level ORDER BY CASE WHEN n > 1 THEN rrf ELSE raw END DESC, id) AS rank FROM f JOIN n USING (query_id, level)""")
def r07(v):
    """Documents by vector and by words of their first line, sections by words of theirs; a lone list keeps its scores."""
    q = v.vec.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    dense = retrieval.nearest(q, v.vec.select(F.col("vec_id").alias("id"), "v"), 10)
    heads = lambda *keys: v.words.join(v.chunk.groupBy(*keys).agg(F.min("chunk_id").alias("id")).select("id"), "id", "left_semi")
    tag = lambda df, level, source: df.select("query_id", F.lit(level).alias("level"), F.lit(source).alias("source"), "id", "score", "rank")
    docs = _lexical(v, 10, heads("doc_id").select(F.col("doc_id").alias("id"), "words"))
    lists = tag(dense, "document", "dense").unionAll(tag(docs, "document", "lexical")).unionAll(tag(_lexical(v, 10, heads("doc_id", "chapter_id")), "section", "lexical"))
    return ranking.rank(retrieval.layered_scores(lists), ["query_id", "level"]).select("query_id", "level", "id", "rank")


_EXACT = """ex AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM (SELECT query_id, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[1]]) AS p FROM v_query)
  JOIN (SELECT id, ' ' || array_to_string(words, ' ') || ' ' AS t FROM v_words) ON contains(t, ' ' || p || ' ') GROUP BY ALL)"""


def _exact(v):
    q = v.query.select("query_id", F.array(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))), F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(0)))).alias("phrases"))
    return retrieval.phrases(q, v.words.select("id", "words"))


@query("r08_phrase_search", "WITH " + _EXACT + " SELECT query_id, id, score FROM ex")
def r08(v):
    return _exact(v)


@query("r09_relevance_threshold", "WITH " + _BRIEFS + ", lists AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM brief_lists GROUP BY ALL), " + _KNEE + " SELECT c.query_id, c.id FROM c LEFT JOIN k USING (query_id) WHERE hi > 0 AND score >= coalesce(knee, greatest(0.001, 0.15::DOUBLE * hi))")
def r09(v):
    return ranking.relevant(ranking.fuse(_ranked_orders(v))).select("query_id", "id")


@query("f14_relevance_filter", "WITH lists AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice AS score FROM orders), " + _KNEE + " SELECT c.query_id, c.id FROM c LEFT JOIN k USING (query_id) WHERE hi > 0 AND score >= coalesce(knee, greatest(0.001, 0.15::DOUBLE * hi))")
def f14(v):
    lists = v.table("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return ranking.relevant(lists).select("query_id", "id")


@query("r10_knee", "WITH lists AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice AS score FROM orders), " + _KNEE + " SELECT query_id, knee_index, knee FROM (SELECT DISTINCT query_id FROM c) LEFT JOIN k USING (query_id)")
def r10(v):
    lists = v.table("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return ranking.knee(lists, "query_id").select("query_id", F.col("knee_index").cast("long").alias("knee_index"), "knee").distinct()


@query("r11_filtered_search", _hybrid_sql("lang = 'en'") + " SELECT query_id, id, rank FROM fused")
def r11(v):
    """The condition is met where the documents are read, so each channel is made of those that meet it alone."""
    return _hybrid(v.within("lang = 'en'")).select("query_id", "id", "rank")


@query("r12_subqueries", "WITH " + _knn_sql(8) + """, s AS (SELECT query_id // 200 AS question, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM dense GROUP BY ALL),
  e AS (SELECT query_id // 200 AS question, list_sort(list(DISTINCT label)) AS entities FROM dense JOIN v_vec ON vec_id = id GROUP BY 1)
  SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank, entities FROM s JOIN e USING (question)""")
def r12(v):
    """Four subqueries a question in one job; labels stand for the entities that each finds, united by question."""
    hits = _dense(v, 8).withColumn("question", F.expr("query_id div 200"))
    found = hits.join(v.vec.select(F.col("vec_id").alias("id"), "label"), "id").groupBy("question").agg(F.sort_array(F.collect_set("label")).alias("entities"))
    return ranking.rank(ranking.fuse(hits, key="question"), ["question"]).join(found, "question").select("question", "id", "rank", "entities")


_GRAPH_LIST = "gl AS (SELECT src AS query_id, chunk_id AS id, count(*)::DOUBLE AS score FROM v_relation WHERE src % 50 = 0 GROUP BY ALL), glr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM gl QUALIFY rank <= 20)"


@query("r13_final_merge", _HYBRID + ", " + _EXACT + ", " + _GRAPH_LIST + """, exr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ex QUALIFY rank <= 20),
  g AS (SELECT query_id, id, rank FROM fused UNION ALL SELECT query_id, id, rank FROM exr UNION ALL SELECT query_id, id, rank FROM glr) SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM g GROUP BY ALL""")
def r13(v):
    """Hybrid, exact and graph lists; the graph's are the chunks that name the query's entity most."""
    named = v.relation.filter("src % 50 = 0").groupBy(F.col("src").alias("query_id"), F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    lists = [_hybrid(v), ranking.rank(_exact(v), ["query_id"], 20), ranking.rank(named, ["query_id"], 20)]
    one = lists[0].select("query_id", "id", "rank")
    for more in lists[1:]:
        one = one.unionAll(more.select("query_id", "id", "rank"))
    return ranking.fuse(one)


_LEX40 = "WITH " + _cover_sql(k=40) + ", t AS (SELECT query_id, id, rank, content FROM lexr JOIN v_chunk ON chunk_id = id)"


def _first_forty(v):
    """The best forty of each query with their texts: the hits, as a table, are the side that is broadcast where they are small."""
    hits = store.kept(_lexical(v, 40).select("query_id", "id", "rank"), "hits")
    return v.chunk.select(F.col("chunk_id").alias("id"), "content").join(retrieval.small(hits), "id")


def _short_first(texts):
    """A reranker without a model: the shorter the better."""
    return [-float(len(t)) for t in texts]


@query("r14_rerank", _LEX40 + " SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (rank > 30)::INT, CASE WHEN rank <= 30 THEN length(content) END, rank) AS rank FROM t")
def r14(v):
    """The first thirty by the reranker, the others after them."""
    return retrieval.reranked(_first_forty(v), _short_first, text="content").select("query_id", "id", "rank")


def _not_all(texts):
    """Fails on a long text: its query keeps its order."""
    if any(len(t) > 1200 for t in texts):
        raise RuntimeError("too long")
    return _short_first(texts)


@query("r14_rerank_fallback", _LEX40 + ", f AS (SELECT query_id, bool_or(length(content) > 1200) FILTER (WHERE rank <= 30) AS failed FROM t GROUP BY 1) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (rank > 30)::INT, CASE WHEN rank <= 30 AND NOT failed THEN length(content) END, rank) AS rank FROM t JOIN f USING (query_id)")
def r14b(v):
    return retrieval.reranked(_first_forty(v), _not_all, text="content", batch=1).select("query_id", "id", "rank")


_CONTEXT = _HYBRID + """, a AS (SELECT query_id, rank AS ar, c.doc_id, c.chunk_index FROM fused JOIN v_chunk c ON c.chunk_id = id WHERE rank <= 8),
  n AS (SELECT query_id, b.chunk_id, b.chunk_index, min(ar) AS ar FROM a JOIN v_chunk b ON a.doc_id = b.doc_id AND abs(b.chunk_index - a.chunk_index) <= 5 GROUP BY ALL),
  ctx AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ar, chunk_index, chunk_id) AS pos, chunk_id FROM n QUALIFY pos <= 24)"""


@query("r15_context_window", _CONTEXT + " SELECT query_id, pos, chunk_id FROM ctx")
def r15(v):
    return retrieval.context(_hybrid(v).filter("rank <= 8"), v.chunk)


@query("q_answer_context", _CONTEXT + " SELECT query_id, pos, chunk_id, content FROM ctx JOIN v_chunk USING (chunk_id)")
def flagship(v):
    """Question batch to context rows: dense and lexical search, fusion, relevance by rank, windows, texts."""
    return retrieval.context(_hybrid(v).filter("rank <= 8"), v.chunk).join(v.chunk.select("chunk_id", "content"), "chunk_id").select("query_id", "pos", "chunk_id", "content")


@query("r16_evidence", _CONTEXT + """, pr AS (SELECT * FROM (SELECT query_id, prop_id, p.chunk_id, statement FROM (SELECT DISTINCT query_id, chunk_id FROM ctx) JOIN v_proposition p USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY prop_id) <= 6) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id, prop_id) <= 120),
  dc AS (SELECT DISTINCT query_id, doc_id FROM ctx JOIN v_chunk USING (chunk_id))
  SELECT query_id, 'proposition' AS kind, prop_id::VARCHAR AS id, statement AS text FROM pr UNION ALL SELECT query_id, 'summary', 'docs/' || doc_id || '.md', content FROM dc JOIN v_chunk USING (doc_id) WHERE chunk_index = 0
  UNION ALL SELECT query_id, 'figure', 'img/' || chunk_id || '.png', 'plate ' || chunk_index FROM ctx JOIN v_chunk USING (chunk_id) WHERE doc_id % 3 = 0 AND chunk_index % 10 = 4""")
def r16(v):
    """Figures of the context's chunks, summaries of their documents (their first lines), and their first propositions."""
    ctx = store.kept(retrieval.context(_hybrid(v).filter("rank <= 8"), v.chunk), "context")
    found = retrieval.propositions_for(ctx, v.proposition).select("query_id", F.lit("proposition").alias("kind"), F.col("prop_id").cast("string").alias("id"), F.col("statement").alias("text"))
    documents = ctx.join(v.chunk.select("chunk_id", "doc_id"), "chunk_id").select("query_id", "doc_id").distinct()
    heads = v.chunk.filter("chunk_index = 0").select("doc_id", "content")
    summaries = documents.join(heads, "doc_id").select("query_id", F.lit("summary").alias("kind"), F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("id"), F.col("content").alias("text"))
    figures = ctx.join(ingest.figures(v.illustrated), "chunk_id").select("query_id", F.lit("figure").alias("kind"), F.col("image").alias("id"), F.col("caption").alias("text"))
    return found.unionByName(summaries).unionByName(figures)


_GROUNDING = """WITH f AS (SELECT prop_id AS fact_id, CASE WHEN prop_id % 3 = 0 THEN NULL ELSE prop_id END AS prop_id, chunk_id, statement AS s, prop_id % 50 = 2 AND length(statement) BETWEEN 20 AND 200 AS cited, CASE WHEN prop_id % 50 = 2 AND length(statement) BETWEEN 20 AND 200 THEN left(statement, 5) || '~' || substr(statement, 7) WHEN prop_id % 2 = 0 THEN left(statement, 20) ELSE 'zz' || left(statement, 20) END AS quote FROM v_proposition),
  g AS (SELECT fact_id, cited, length(s) AS n, CASE WHEN contains(p.statement, quote) THEN 'proposition' WHEN contains(c.content, quote) THEN 'chunk' END AS source, p.prop_id IS NOT NULL AS own FROM f LEFT JOIN v_proposition p ON f.prop_id = p.prop_id LEFT JOIN v_chunk c ON f.chunk_id = c.chunk_id)"""


@query("r17_grounding", _GROUNDING + """
  SELECT fact_id, coalesce(source, CASE WHEN own THEN 'proposition' ELSE 'chunk' END) AS source FROM g WHERE source IS NOT NULL OR (cited AND n >= 20)""")
def r17(v):
    return _grounded(v).select("fact_id", "source")


def _grounded(v):
    """Quotes by substring; those of cited facts, here with one letter changed, also by likeness."""
    p = v.proposition
    cited = (F.col("prop_id") % 50 == 2) & F.length("statement").between(20, 200)
    quote = F.when(cited, F.concat(F.left("statement", F.lit(5)), F.lit("~"), F.expr("substr(statement, 7)"))).when(F.col("prop_id") % 2 == 0, F.left("statement", F.lit(20))).otherwise(F.concat(F.lit("zz"), F.left("statement", F.lit(20))))
    facts = p.select(F.col("prop_id").alias("fact_id"), F.when(F.col("prop_id") % 3 == 0, None).otherwise(F.col("prop_id")).alias("prop_id"), "chunk_id", quote.alias("quote"), cited.alias("cited"))
    return retrieval.grounded(facts, p, v.chunk)


_FACT = "CASE prop_id % 3 WHEN 0 THEN statement WHEN 1 THEN left(statement, 30) ELSE substr(statement, 3, 12) END"


@query("r18_fact_anchor", f"""WITH f AS (SELECT prop_id AS fact_id, chunk_id, {_FACT} AS fact FROM v_proposition), m AS (SELECT fact_id, p.prop_id, CASE WHEN statement = fact THEN 1 WHEN left(statement, 30) = fact THEN 2 WHEN contains(left(statement, 30), fact) THEN 3 END AS tier FROM f JOIN v_proposition p USING (chunk_id))
  SELECT fact_id, tier, prop_id FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY tier, prop_id) AS r FROM m WHERE tier IS NOT NULL) WHERE r = 1""")
def r18(v):
    p = v.proposition.withColumn("span", F.left("statement", F.lit(30)))
    return retrieval.anchored(p.select(F.col("prop_id").alias("fact_id"), "chunk_id", F.expr(_FACT).alias("fact")), p).select("fact_id", "tier", "prop_id")


_LEVEL = "CASE {id} % 16 WHEN 0 THEN 'direct_answer' WHEN 5 THEN 'supporting_evidence' ELSE 'background' END"


@query("r19_sufficiency", _GROUNDING + ", gr AS (SELECT fact_id FROM g WHERE source IS NOT NULL OR (cited AND n >= 20)), f2 AS (SELECT doc_id, prop_id IN (SELECT fact_id FROM gr) AND " + _LEVEL.format(id="prop_id") + """ <> 'background' AS ok FROM v_proposition)
  SELECT doc_id, CASE WHEN bool_or(ok) THEN 'SUFFICIENT_FOR_SYNTHESIS' ELSE 'INSUFFICIENT_TRIGGER_BRANCH_B' END AS verdict, 0.5::DOUBLE AS confidence FROM f2 GROUP BY doc_id""")
def r19(v):
    """Of every document's facts, whether a grounded one answers or supports."""
    grounded = _grounded(v).select("fact_id", F.lit(True).alias("grounded"))
    facts = v.proposition.select("doc_id", F.col("prop_id").alias("fact_id"), F.expr(_LEVEL.format(id="prop_id")).alias("level")).join(grounded, "fact_id", "left")
    return retrieval.sufficiency(facts.withColumn("grounded", F.col("grounded").isNotNull()), "doc_id")


def _round_sql(k: int) -> str:
    """One round of the expansion: new frontier, new terms, new statements, and the queries that go on."""
    before = lambda name: " UNION ALL ".join(f"SELECT * FROM {name}{j}" for j in range(1, k))
    unasked = f" EXCEPT ({before('t')})" if k > 1 else ""
    unfound = f" AND NOT EXISTS (SELECT 1 FROM ({before('n')}) o WHERE o.query_id = t.query_id AND o.prop_id = s.prop_id)" if k > 1 else ""
    own = "SELECT query_id, unnest(w) AS token FROM v_query UNION " if k == 1 else ""
    return f"""m{k} AS (SELECT DISTINCT query_id, b AS id FROM f{k - 1} JOIN adj ON f{k - 1}.id = a WHERE NOT EXISTS (SELECT 1 FROM ({" UNION ALL ".join(["SELECT * FROM f0", *(f"SELECT * FROM l{j}" for j in range(1, k))])}) o WHERE o.query_id = f{k - 1}.query_id AND o.id = b)),
  l{k} AS (SELECT query_id, id FROM m{k} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id DESC) <= 10),
  t{k} AS (({own}SELECT query_id, token FROM l{k} JOIN nm USING (id)){unasked}),
  h{k} AS (SELECT t.query_id, t.token, prop_id FROM t{k} t JOIN s USING (token) WHERE NOT EXISTS (SELECT 1 FROM lexr WHERE lexr.query_id = t.query_id AND lexr.id = s.chunk_id){unfound}),
  n{k} AS (SELECT DISTINCT query_id, prop_id FROM (SELECT * FROM h{k} QUALIFY row_number() OVER (PARTITION BY query_id, token ORDER BY prop_id) <= 5)),
  f{k} AS (SELECT * FROM l{k} WHERE query_id IN (SELECT query_id FROM n{k}))"""


@query("r20_expansion", "WITH " + _cover_sql() + """, adj AS (SELECT DISTINCT src AS a, dst AS b FROM v_relation UNION SELECT DISTINCT dst, src FROM v_relation),
  nm AS (SELECT entity_id AS id, lower(split_part(name, ' ', 1)) AS token FROM v_entity), s AS MATERIALIZED (SELECT prop_id, chunk_id, unnest(list_distinct(regexp_extract_all(lower(statement), '[a-záéíóúüñçàèìòùâêîôû0-9]+'))) AS token FROM v_proposition),
  f0 AS (SELECT query_id, s_suppkey AS id FROM v_query JOIN supplier ON s_suppkey = query_id), """ + ", ".join(_round_sql(k) for k in (1, 2, 3)) + """
  SELECT query_id, prop_id, 1 AS round FROM n1 UNION ALL SELECT query_id, prop_id, 2 FROM n2 UNION ALL SELECT query_id, prop_id, 3 FROM n3""")
def r20(v):
    """Three rounds from the query's words and its entity, the supplier of the same number."""
    seed = v.table("supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    queries = v.query.join(seed, F.col("query_id") == F.col("id"), "left").select("query_id", "id", F.col("w").alias("tokens"))
    both = v.relation.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
    edges = store.kept(both.union(both.select("b", "a")).distinct(), "edges")
    names = v.entity.select(F.col("entity_id").cast("long").alias("id"), F.lower(F.split_part("name", F.lit(" "), F.lit(1))).alias("token"))
    statements = v.proposition.select("prop_id", "chunk_id", X.words(F.col("statement"), X.QUERY_WORD).alias("tokens"))
    return retrieval.expanded(queries, edges, names, statements, _lexical(v).select("query_id", F.col("id").alias("chunk_id")), rounds=3)


@query("r21_documents_consulted", _CONTEXT + " SELECT query_id, doc_id, min(pos) AS pos FROM ctx JOIN v_chunk USING (chunk_id) GROUP BY ALL")
def r21(v):
    return retrieval.context(_hybrid(v).filter("rank <= 8"), v.chunk).join(v.chunk.select("chunk_id", "doc_id"), "chunk_id").groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos"))


@query("r22_novelty", "WITH " + _knn_sql(2, where="") + ", n AS (SELECT query_id, max(score) AS s FROM dense WHERE id <> query_id GROUP BY 1) SELECT query_id, CASE WHEN s >= 0.86 THEN 'duplicate' WHEN s >= 0.70 THEN 'grey' ELSE 'new' END AS band FROM n")
def r22(v):
    q = v.vec.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    best = retrieval.nearest(q, v.vec.select(F.col("vec_id").alias("id"), "v"), 2).filter("id <> query_id").groupBy("query_id").agg(F.max("score").alias("s"))
    return best.select("query_id", retrieval.bands(F.col("s")).alias("band"))


# graph

_EDGES = "adj AS (SELECT a, b, count(*) AS weight FROM (SELECT src AS a, dst AS b FROM v_relation UNION ALL SELECT dst, src FROM v_relation) GROUP BY a, b)"
_EGO = _EDGES + """, seeds AS (SELECT s_suppkey AS query_id, s_suppkey AS id FROM supplier WHERE s_suppkey % 50 = 0),
  h1 AS (SELECT query_id, id FROM seeds UNION SELECT query_id, b FROM seeds JOIN adj ON id = a), h2 AS (SELECT query_id, id FROM h1 UNION SELECT query_id, b FROM h1 JOIN adj ON id = a),
  net AS (SELECT DISTINCT x.query_id, a, b, weight FROM h2 x JOIN adj ON x.id = a JOIN h2 y ON y.query_id = x.query_id AND y.id = b)"""


def _edges(v):
    """The adjacency as a table, as walks read it often."""
    return store.kept(graph.adjacency(v.relation), "adjacency")


def _seeds(v):
    return v.table("supplier").filter("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("id"))


@query("g01_adjacency", "WITH " + _EDGES + " SELECT a, b, weight FROM adj")
def g01(v):
    return graph.adjacency(v.relation)


@query("g02_layers", """WITH e AS (SELECT 'e' AS a_type, src AS a, 'e' AS b_type, dst AS b, 1::BIGINT AS weight FROM v_relation UNION ALL SELECT DISTINCT 'd', chunk_id, 'e', src, 1 FROM v_relation UNION ALL SELECT DISTINCT 't', s_nationkey, 'e', s_suppkey, 1 FROM supplier),
  s AS (SELECT * FROM e UNION ALL SELECT b_type, b, a_type, a, weight FROM e) SELECT a_type, a, b_type, b, sum(weight)::BIGINT AS weight FROM s GROUP BY ALL""")
def g02(v):
    edge = lambda df, at, a, bt, b: df.select(F.lit(at).alias("a_type"), F.col(a).cast("long").alias("a"), F.lit(bt).alias("b_type"), F.col(b).cast("long").alias("b"), F.lit(1).cast("long").alias("weight"))
    named = store.dealt(v.relation.select("chunk_id", "src"), v.relation.count(), "chunk_id", "src").distinct()
    return graph.layered(edge(v.relation, "e", "src", "e", "dst"), edge(named, "d", "chunk_id", "e", "src"), edge(v.table("supplier"), "t", "s_nationkey", "e", "s_suppkey").distinct())


@query("g03_document_layer", "SELECT DISTINCT chunk_id AS doc, src AS entity FROM v_relation UNION SELECT DISTINCT chunk_id, dst FROM v_relation")
def g03(v):
    return v.relation.select(F.col("chunk_id").alias("doc"), F.explode(F.array("src", "dst")).alias("entity")).distinct()


@query("g04_thesaurus_layer", "SELECT r_name AS broader, n_name AS narrower, 1 AS weight FROM region JOIN nation ON n_regionkey = r_regionkey")
def g04(v):
    return v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("broader"), F.col("n_name").alias("narrower"), F.lit(1).alias("weight"))


@query("g05_ego_network", "WITH " + _EGO + " SELECT query_id, a, b, weight FROM net")
def g05(v):
    return graph.ego(_edges(v), _seeds(v))


_STEP = "p{k} AS (SELECT n.query_id, n.id, 0.85::DOUBLE * (n.id = n.query_id)::INT + 0.15::DOUBLE * coalesce(sum(m.share * p.score), 0) AS score FROM nodes n LEFT JOIN m ON m.query_id = n.query_id AND m.b = n.id LEFT JOIN p{j} p ON p.query_id = m.query_id AND p.id = m.a GROUP BY n.query_id, n.id)"
_PPR = _EGO + """, nodes AS (SELECT DISTINCT query_id, a AS id FROM net), m AS (SELECT query_id, a, b, weight / sum(weight) OVER (PARTITION BY query_id, a) AS share FROM net),
  p0 AS (SELECT query_id, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS score FROM nodes), """ + ", ".join(_STEP.format(k=k, j=k - 1) for k in range(1, 17))


def _ppr(v):
    seeds = _seeds(v)
    return graph.pagerank(graph.ego(_edges(v), seeds), seeds, tolerance=1e-9)


@query("g06_personalised_pagerank", "WITH " + _PPR + " SELECT query_id, id, round(score, 6) AS score FROM p16")
def g06(v):
    return _ppr(v).select("query_id", "id", F.round("score", 6).alias("score"))


@query("g07_selected_nodes", "WITH " + _PPR + ", lists AS (SELECT query_id, id, round(score, 9) AS score FROM p16 WHERE id IN (SELECT entity_id FROM v_entity)), " + _KNEE + """, st AS (SELECT query_id, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS sd FROM lists GROUP BY 1)
  SELECT c.query_id, c.id FROM c JOIN st USING (query_id) LEFT JOIN k USING (query_id) WHERE c.score >= CASE WHEN st.n >= 100 THEN greatest(coalesce(knee, 0.02::DOUBLE * hi), mean + 0.5::DOUBLE * sd) ELSE coalesce(knee, 0.02::DOUBLE * hi) END""")
def g07(v):
    """Entity nodes of the two-hop network, by the knee."""
    entities = v.entity.select(F.col("entity_id").alias("id"))
    return graph.select_ranked(_ppr(v).join(entities, "id", "left_semi").withColumn("score", F.round("score", 9))).select("query_id", "id")


@query("g08_chunks_for_entities", "WITH e AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 8000) SELECT chunk_id, count(*) AS mentions FROM v_relation JOIN e ON src = id GROUP BY 1")
def g08(v):
    e = v.table("supplier").filter("s_acctbal > 8000").select(F.col("s_suppkey").alias("src"))
    return v.relation.join(e, "src", "left_semi").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("mentions"))


@query("g09_triples", "SELECT relation_id, src, dst FROM v_relation WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 5) ORDER BY relation_id, src, dst LIMIT 25")
def g09(v):
    e = v.table("supplier").filter("s_nationkey = 5").select(F.col("s_suppkey").alias("src"))
    return v.relation.join(e, "src", "left_semi").orderBy("relation_id", "src", "dst").limit(25).select("relation_id", "src", "dst")


_MENTIONS = "mentions AS (SELECT DISTINCT lower(p_name) AS mention FROM part UNION SELECT DISTINCT lower(p_brand) FROM part UNION SELECT lower(split_part(p_name, ' ', 1)) FROM part)"
_CAND = _MENTIONS + """, x1 AS (SELECT mention, entity_id AS id, 1 AS tier FROM mentions JOIN v_entity ON mention = name_norm),
  x2 AS (SELECT mention, entity_id AS id, 2 AS tier FROM mentions JOIN v_entity ON contains(name_norm, mention) WHERE mention NOT IN (SELECT mention FROM x1) QUALIFY row_number() OVER (PARTITION BY mention ORDER BY entity_id) <= 5),
  x3 AS (SELECT mention, entity_id AS id, 3 AS tier FROM (SELECT *, round(list_cosine_similarity(mv, ev), 9) AS s FROM (SELECT mention, {mv} AS mv FROM mentions WHERE mention NOT IN (SELECT mention FROM x1) AND mention NOT IN (SELECT mention FROM x2)), (SELECT entity_id, {ev} AS ev FROM v_entity) WHERE list_sum(mv) > 0 AND list_sum(ev) > 0) QUALIFY row_number() OVER (PARTITION BY mention ORDER BY s DESC, entity_id) <= 5),
  cand AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3)""".replace("{mv}", letters_sql("mention")).replace("{ev}", letters_sql("name_norm"))


def _candidates(v):
    p = v.table("part")
    m = p.select(F.lower("p_name").alias("mention")).union(p.select(F.lower("p_brand"))).union(p.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))))).distinct()
    return graph.candidates(m, v.entity, embed_fn=letters)


@query("g10_entity_candidates", "WITH " + _CAND + " SELECT mention, id, tier FROM cand")
def g10(v):
    return _candidates(v)


@query("g11_disambiguation", "WITH " + _EDGES + ", " + _CAND + """, n AS (SELECT mention, count(*) AS n, min(id) AS first_ FROM cand GROUP BY 1),
  ctx AS (SELECT list_distinct(list(b)) AS near FROM cand JOIN n USING (mention) JOIN adj ON id = a WHERE n = 1), own AS (SELECT a AS id, list_distinct(list(b)) AS own FROM adj GROUP BY 1),
  sc AS (SELECT mention, id, coalesce(len(list_intersect(own, coalesce(near, [])))::DOUBLE / greatest(least(len(own), len(coalesce(near, []))), 1), 0) AS score FROM cand JOIN n USING (mention) LEFT JOIN own USING (id) CROSS JOIN ctx WHERE n > 1),
  rk AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) AS r FROM sc), g AS (SELECT mention, max(score) FILTER (WHERE r = 1) - max(score) FILTER (WHERE r = 2) AS gap, max(score) FILTER (WHERE r = 1) AS best, min(id) FILTER (WHERE r = 1) AS top, min(id) AS first_ FROM rk GROUP BY 1),
  lim AS (SELECT CASE WHEN count(*) < 2 THEN 0.05 ELSE greatest(list_sort(list(gap))[floor(0.5 * (count(*) - 1))::INT + 1], 0.05) END AS m FROM g)
  SELECT mention, id FROM cand JOIN n USING (mention) WHERE n = 1 UNION ALL SELECT mention, CASE WHEN gap >= m AND best > 0 THEN top ELSE first_ END FROM g, lim""")
def g11(v):
    return graph.disambiguate(store.kept(_candidates(v), "candidates"), _edges(v))


@query("g12_token_linking", "SELECT brand, count(DISTINCT entity_id) AS entities FROM (SELECT DISTINCT p_brand AS brand, lower(p_type) AS token FROM part) JOIN v_entity ON list_contains(string_split(name_norm, ' '), token) GROUP BY 1")
def g12(v):
    """A brand's types are the words of a question; each links to the entities whose names have it."""
    t = v.table("part").select(F.col("p_brand").alias("brand"), F.explode(F.regexp_extract_all(F.lower("p_type"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    entities = v.entity.select("entity_id", "name_norm")
    dealt = entities.repartition(store.pieces(entities.count(), 1 << 14), "entity_id")  # an entity may meet every brand
    names = dealt.select("entity_id", F.explode(F.array_distinct(F.split("name_norm", " "))).alias("token"))
    linked = names.join(retrieval.small(store.kept(t, "brand-tokens")), "token").select("entity_id", "brand").distinct()
    return linked.groupBy("brand").agg(F.count(F.lit(1)).alias("entities"))


@query("g13_graph_version", "WITH " + _EDGES + " SELECT cast(sum(('0x' || substr(md5(a || '|' || b || '|' || weight), 1, 8))::BIGINT) AS VARCHAR) AS version, count(*) AS edges FROM adj")
def g13(v):
    """The snapshot's version: an order-free fingerprint of its edges."""
    return graph.version_of(graph.adjacency(v.relation))


#: The older snapshot lacks one in 977 orders.
_OLD_EDGES = "old AS (SELECT a, b, count(*) AS weight FROM (SELECT src AS a, dst AS b FROM v_relation WHERE chunk_id % 977 <> 0 UNION ALL SELECT dst, src FROM v_relation WHERE chunk_id % 977 <> 0) GROUP BY a, b)"


def _two_snapshots(v):
    return graph.adjacency(v.relation.filter("chunk_id % 977 <> 0")), graph.adjacency(v.relation)


@query("g13_invalidated_seeds", "WITH " + _EGO.replace("adj", "new") + ", " + _OLD_EDGES + """, ch AS (SELECT coalesce(o.a, n.a) AS a, coalesce(o.b, n.b) AS b FROM old o FULL JOIN new n ON o.a = n.a AND o.b = n.b WHERE o.weight IS DISTINCT FROM n.weight),
  o1 AS (SELECT query_id, id FROM seeds UNION SELECT query_id, b FROM seeds JOIN old ON id = a)
  SELECT DISTINCT query_id FROM o1 JOIN (SELECT a AS id FROM ch UNION SELECT b FROM ch) USING (id)""")
def g13b(v):
    """Cached one-hop networks of the older snapshot that the newer one's changed edges touch."""
    old, new = (store.kept(e, "snapshot") for e in _two_snapshots(v))
    seeds = _seeds(v)
    return graph.invalidated(graph.ego(old, seeds, hops=1), seeds, graph.changed_edges(old, new))


@query("g13_networks_at_version", "WITH " + _EGO + " SELECT query_id, a, b, weight FROM net")
def g13c(v):
    """The newer snapshot's networks, kept from the older one's where these still hold: the same as cut anew."""
    cache, seeds = graph.Snapshots(v.spark), _seeds(v)
    old, new = (cache.put(e) for e in _two_snapshots(v))
    cache.networks(old, seeds)
    return cache.networks(new, seeds, before=old)


@query("g14_canonical_names")
def g14(v):
    """All names as one unit."""
    names = v.vec.select(F.lit(0).cast("long").alias("unit"), F.concat(F.lit("n"), "vec_id").alias("name"), F.col("vec_id").alias("pos"), "v")
    return graph.canonical_groups(names)


@query("g15_cooccurrence", "SELECT x.src AS a, y.src AS b, count(*) AS weight FROM (SELECT DISTINCT chunk_id, src FROM v_relation) x JOIN (SELECT DISTINCT chunk_id, src FROM v_relation) y ON x.chunk_id = y.chunk_id AND x.src < y.src GROUP BY ALL")
def g15(v):
    return graph.cooccurrence(v.relation.select(F.col("chunk_id").alias("unit"), F.col("src").alias("id")))


@query("d01_embedding_hook", f"SELECT item_id, list_transform({letters_sql('text')}, lambda x: x::BIGINT) AS v FROM benchmark")
def d01(v):
    """Vectors of the stand-in for the embedding call."""
    return graph.embed(v.table("benchmark").select("item_id", "text"), letters, "text").select("item_id", F.col("v").cast("array<long>").alias("v"))


def _no_long_texts(texts):
    if any(len(t) > 400 for t in texts):
        raise RuntimeError("too long")
    return letters(texts)


@query("n19_embed_null_on_error", "SELECT item_id, length(text) > 400 AS missing FROM benchmark")
def n19(v):
    """A call that fails leaves its texts without a vector, and the others get theirs."""
    return graph.embed(v.table("benchmark").select("item_id", "text"), _no_long_texts, "text", batch=1).select("item_id", F.col("v").isNull().alias("missing"))
