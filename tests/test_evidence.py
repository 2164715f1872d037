"""Evidence for an answer: reranking, verdicts, context text, unique ids and flags on small cases."""

import random

from pyspark.sql import functions as F

from strataq.functions import fuzzy
from strataq.functions import text as X
from strataq.operators import hooks, ingest, retrieval


def test_reranking_of_the_first_thirty(spark):
    hits = spark.createDataFrame([(q, i, i, "x" * (40 - i)) for q in (1, 2) for i in range(1, 36)] + [(3, 1, 1, "bad"), (3, 2, 2, "y")], "query_id long, id long, rank int, text string")

    def short_first(texts):
        if "bad" in texts:
            raise RuntimeError("no score")
        return [-float(len(t)) for t in texts]

    order = lambda df, q: [r.id for r in df.filter(f"query_id = {q}").orderBy("rank").collect()]
    out = retrieval.reranked(hits, short_first, text="text", batch=1)
    assert order(out, 1) == order(out, 2) == [*range(30, 0, -1), *range(31, 36)]
    assert order(out, 3) == [1, 2]  # it failed on one hit
    assert order(retrieval.reranked(hits, hooks.unavailable, text="text"), 1) == list(range(1, 36))


def test_reranked_hits_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return "x" * (40 - i)

    hits = spark.range(1, 36).select(F.lit(1).alias("query_id"), "id", F.col("id").alias("rank")).withColumn("text", text("id"))
    assert retrieval.reranked(hits, lambda texts: [-float(len(t)) for t in texts], text="text").count() == 35
    assert made.value == 35


def test_sufficiency(spark):
    facts = [(1, "direct_answer", True), (1, "background", True), (2, "supporting_evidence", False), (2, "background", True), (3, None, None)]
    got = retrieval.sufficiency(spark.createDataFrame(facts, "q long, level string, grounded boolean"), "q")
    assert {r.q: r.verdict for r in got.collect()} == {1: "SUFFICIENT_FOR_SYNTHESIS", 2: "INSUFFICIENT_TRIGGER_BRANCH_B", 3: "INSUFFICIENT_TRIGGER_BRANCH_B"}


def test_open_facts_of_a_chunk_meet_its_text_once(spark, monkeypatch):
    """A text goes to Python once for all facts that are still open, not beside each of them."""
    seen, alike = [], fuzzy.passages_like
    monkeypatch.setattr(fuzzy, "passages_like", lambda text, parts, least: seen.append(text) or alike(text, parts, least))
    body = "the old harbour wall was built of grey stone and lime " * 3
    facts = [(k, None, 1, f"the old harbour wall wa{k} built of grey stone", True) for k in range(9)] + [(20, 5, 1, "zz", True), (21, 5, 1, "grey", False), (22, 5, 1, "gr~y stone and limes galore", False), (23, 5, 1, "short statement of fac7s here", True), (24, None, None, "grey", True)]
    got = retrieval.grounded(
        spark.createDataFrame(facts, "fact_id long, prop_id long, chunk_id long, quote string, cited boolean"),
        spark.createDataFrame([(5, "short statement of facts here")], "prop_id long, statement string"),
        spark.createDataFrame([(1, body)], "chunk_id long, content string"),
    )
    assert {r.fact_id: r.source for r in got.collect()} == {k: "chunk" for k in range(9)} | {21: "chunk", 23: "proposition"}
    assert len(seen) == 1 and "collect_list" in got._jdf.queryExecution().optimizedPlan().toString()


def test_context_text(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, "query_id long, " + schema)
    given = {
        "summaries": make([(1, 7, "section", 2, "second"), (1, 7, "document", None, "whole")], "doc_id long, level string, chapter_id long, text string"),
        "chunks": make([(1, 1, True, "a.md", 7, "One", 2, 4, 0.25, "body")], "pos int, is_anchor boolean, doc_path string, doc_id long, chapter string, chapter_id long, chunk_index long, score double, content string"),
        "propositions": make([(1, 1, 99, "Title", "said", "sa"), (1, 2, 98, "Title", "more", None)], "pos int, prop_id long, doc_title string, statement string, span string"),
        "history": make([(1, k, "user", f"t{k}") for k in range(8)], "turn long, role string, text string"),
        "triples": make([(1, "b", "r", "c", "z"), (1, "x", "r", "y", "a")], "source string, type string, target string, doc string"),
        "documents": make([(1, "b.md", "sb"), (1, "a.md", "sa")], "doc_path string, summary string"),
        "figures": make([(1, 1, "i.png", "a map")], "figure int, image string, description string"),
    }
    got = dict(map(tuple, retrieval.context_text(spark.createDataFrame([(1,), (2,)], "query_id long"), **given).collect()))
    assert got[1] == "\n".join([
        "--- MARCO TEMÁTICO (resúmenes de documento/sección) ---", "[doc_id: 7 | nivel: document] whole", "[doc_id: 7 | nivel: section | capítulo: 2] second", "",
        "--- EVIDENCIA TEXTUAL (chunks con cita) ---", "[1] RESULTADO | doc: a.md | doc_id: 7 | capítulo: One | chapter_id: 2 | chunk 4 | score: 0.2500", "body", "",
        "--- CAPA ATÓMICA (proposiciones) ---", "[1] doc: Title | sección: (sin sección) | chunk_id: 99 | said (cita: sa)", "", "[2] doc: Title | sección: (sin sección) | chunk_id: 98 | more", "",
        "--- HISTORIAL DE CONVERSACIÓN (referencia) ---", *(f"[USER] t{k}" for k in range(2, 8)), "",
        "--- SUBGRAFO DE ENTIDADES ---", "(x) -[r]-> (y) [doc: a]", "(b) -[r]-> (c) [doc: z]", "",
        "--- RESUMENES DE DOCUMENTO (referencia secundaria) ---", "[a.md] sa", "[b.md] sb", "",
        "--- FIGURAS ---", "[i.png] a map",
    ])
    assert got[2].count("(sin ") == 6 and "HISTORIAL" not in got[2] and got[2].endswith("(sin figuras)")


def test_unique_ids(spark):
    df = spark.createDataFrame([(["a", "a", "a_2", "a", "", ""],), ([],)], "ids array<string>")
    assert [r[0] for r in df.select(ingest.unique_ids(F.col("ids"))).collect()] == [["a", "a_2", "a_2_2", "a_3", "", "doc_2"], []]


def test_flags_noise_and_counts(spark):
    df = spark.createDataFrame([(" Yes ",), ("HIGH",), ("12",), ("1.5",), ("éèà",), ("__ 12",), ("ab",)], "v string")
    got = [tuple(r) for r in df.select(X.to_flag(F.col("v")), X.to_enum(F.col("v"), ["high"]), X.to_int(F.col("v")), X.is_noise(F.col("v"))).collect()]
    assert got == [(True, None, None, False), (None, "high", None, False), (None, None, 12, True), (None, None, None, True), (None, None, None, False), (None, None, None, True), (None, None, None, True)]
    counts = spark.createDataFrame([(["b", "a", "b"],), ([],)], "w array<string>").select(X.word_counts(F.col("w"))).collect()
    assert [r[0] for r in counts] == [{"a": 1, "b": 2}, {}]


def test_packing_and_shifts_in_one_row(spark):
    rng = random.Random(5)
    rows = [([rng.choice([0, 1, 3, 5, 12]) for _ in range(n)], [rng.random() for _ in range(n)]) for n in (0, 1, 2, 7, 50, 400)]
    got = spark.createDataFrame(rows, "sizes array<long>, sims array<double>").select(ingest.packed(F.col("sizes"), 10).alias("g"), ingest.segment_shift(F.col("sims"), 0.4).alias("s")).collect()
    for (sizes, sims), r in zip(rows, got):
        g, total, groups = 0, 0, []
        for x in sizes:
            g, total = (g + 1, x) if total > 0 and total + x > 10 else (g, total + x)
            groups.append(g)
        shifts, k = [], 0
        for x in sims:
            k += x < 0.4
            shifts.append(k)
        assert (r.g, r.s) == (groups, shifts)
