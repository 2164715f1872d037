"""Literal cases of single operators."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strataq.functions import fuzzy
from strataq.functions import text as X
from strataq.operators import graph, hooks, ingest, ranking, retrieval, rules, segment
from strataq.streaming import telemetry


def lists(spark, scores):
    return spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)] or [], "query_id long, id long, score double")


# Score curves and the places of their knees.
@pytest.mark.parametrize(
    "scores, index",
    [([1, 0.5, 0.25, 0.125, 0.0625], 2), ([0.9, 0.5, 0.3, 0.1, 0.05, 0.01], 3), ([0.5] * 5, None), ([1.0, 0.75, 0.5, 0.25, 0.0], None), ([0.9, 0.1], None), ([], None)],
)
def test_knee(spark, scores, index):
    got = ranking.knee(lists(spark, scores), "query_id").select("knee_index").distinct().collect()
    assert [r[0] for r in got] == ([index] if scores else [])


def test_relevance_floor(spark):
    assert ranking.relevant(lists(spark, [0.0, 0.0, 0.0])).count() == 0
    assert ranking.relevant(lists(spark, [1.0, 0.1])).count() == 1


def test_rrf(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 2, 1), (1, 1, 2), (1, 3, 1)], "query_id long, id long, rank long")
    got = {r.id: r.score for r in ranking.fuse(ranked).collect()}
    assert got[1] == got[2] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8) and got[3] == pytest.approx(1 / 63 + 1 / 61, abs=1e-8)


def test_ego_and_pagerank(spark):
    relations = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(7, 1), (8, 99)], "query_id long, id long")
    net = graph.ego(graph.adjacency(relations), seeds)
    assert sorted((r.a, r.b) for r in net.collect()) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    rank = {r.id: r.score for r in graph.pagerank(net, seeds).collect()}
    assert sum(rank.values()) == pytest.approx(1, abs=1e-6) and max(rank, key=rank.get) == 1


def test_self_loop_counts_twice(spark):
    assert graph.adjacency(spark.createDataFrame([(1, 1)], "src long, dst long")).collect()[0].weight == 2


def test_cover_density(spark):
    chunks = spark.createDataFrame([(1, ["a", "x", "b", "a"]), (2, ["a"]), (3, []), (4, None)], "id long, words array<string>")
    q = spark.createDataFrame([(5, ["a", "b"])], "query_id long, w array<string>")
    got = retrieval.cover_density(q, chunks).collect()
    assert [(r.query_id, r.id) for r in got] == [(5, 1)] and got[0].score == pytest.approx(1 / 2 + 1 / 1)


def test_zero_and_null_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, qv array<double>")
    assert [(r.id, r.rank) for r in retrieval.nearest(q, vectors, 5).collect()] == [(1, 1)]


def test_fusion_of_verdicts(spark):
    df = spark.createDataFrame([("pass", "fail"), ("fail", "pass"), ("human_review", "pass"), ("pass", "pass")], "a string, b string")
    assert [r[0] for r in df.select(rules.fuse_verdicts(F.col("a"), F.col("b"))).collect()] == ["human_review", "fail", "human_review", "pass"]


def test_stage_resume(spark):
    df = spark.createDataFrame([(None,), ("analysis",), ("ready",)], "s string")
    assert [r[0] for r in df.select(ingest.resume_stage(F.col("s"), list(rules.STAGES))).collect()] == ["analysis", "segmented", None]


def test_text(spark):
    df = spark.createDataFrame([("The Quick and the %_ a​b “q”",)], "t string")
    row = df.select(X.detect_language(F.col("t")).alias("l"), X.clean_text(F.col("t")).alias("c"), X.strip_article(F.lit("the cat")).alias("s")).collect()[0]
    assert row.l == "en" and row.c == 'The Quick and the %_ ab "q"' and row.s == "cat"


def test_stream_window_watermark(spark, sf, tmp_path):
    rows = spark.readStream.schema(telemetry.EVENTS).parquet(f"{sf}/events.parquet*")
    q = telemetry.windowed(rows).writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() > 0


def test_candidates_are_literal(spark):
    entities = spark.createDataFrame([(1, "100%"), (2, "100x"), (3, "a_b")], "entity_id long, name_norm string")
    mentions = spark.createDataFrame([("0%",), ("a_b",)], "mention string")
    assert sorted((r.mention, r.id, r.tier) for r in graph.candidates(mentions, entities).collect()) == [("0%", 1, 2), ("a_b", 3, 1)]


def test_candidates_by_nearest_names(spark):
    """A mention in no name gets the nearest five by vector; one with an earlier tier, or a failing model, gets none."""
    entities = spark.createDataFrame([(i, "n" * i) for i in range(1, 9)], "entity_id long, name_norm string")
    mentions = spark.createDataFrame([("zz",), ("nnn",), ("nnnnnnn",)], "mention string")

    def vectors(texts):
        return [[1.0, float(len(t))] for t in texts]

    def broken(texts):
        raise RuntimeError("no model")

    def rows(**more):
        return sorted((r.mention, r.id, r.tier) for r in graph.candidates(mentions, entities, **more).collect())

    assert rows() == rows(embed_fn=broken) == [("nnn", 3, 1), ("nnnnnnn", 7, 1)]
    assert rows(embed_fn=vectors) == [("nnn", 3, 1), ("nnnnnnn", 7, 1)] + [("zz", i, 3) for i in sorted(sorted(range(1, 9), key=lambda n: abs(math.atan(n) - math.atan(2)))[:5])]


def test_selected_nodes_two_hops(spark, tmp_path):
    """g07 on a small table against a brute force over two hops; within one hop both parts would be alike and selected."""
    from strataq import plans

    lines = [(50, 1), (50, 2), (7, 1), (8, 1), (7, 3), (9, 3), (8, 4)]
    spark.createDataFrame([(50, "a"), (7, "b"), (8, "c"), (9, "d")], "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, s, p, 1, "N") for i, (s, p) in enumerate(lines)], "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"part {p}") for p in (1, 2, 3, 4)], "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    weight: dict = {}
    for s, p in lines:
        for a, b in ((s, p + 1000000), (p + 1000000, s)):
            weight[a, b] = weight.get((a, b), 0) + 1
    inside = {50}
    for _ in range(2):
        inside |= {b for a, b in weight if a in inside}
    assert inside == {50, 7, 8, 1000001, 1000002}
    edges = {e: w for e, w in weight.items() if set(e) <= inside}
    score = dict.fromkeys(inside, 1 / len(inside))
    for _ in range(50):
        score = {n: 0.85 * (n == 50) + 0.15 * sum(w / sum(x for (c, _), x in edges.items() if c == a) * score[a] for (a, b), w in edges.items() if b == n) for n in inside}
    want = graph.select_ranked(spark.createDataFrame([(50, n, round(x, 9)) for n, x in score.items()], "query_id long, id long, score double"))
    got = plans.queries()["g07_selected_nodes"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.id) for r in got) == sorted((r.query_id, r.id) for r in want.collect())
    assert sorted(r.id for r in got) == [50, 1000001]


def merged_step_by_step(text, most):
    """Neighbours merge one by one at the lowest boundary."""
    parts = [p for p in text.split(". ") if p]
    want = len(text) // 4 // most + 1
    if len(text) // 4 <= most or len(parts) <= want:
        return parts if len(text) // 4 > most else [text]
    words = [set(re.findall(r"\w+", p.lower())) for p in parts]
    boundary = [1 - len(a & b) / max(1, len(a | b)) for a, b in zip(words, words[1:])]
    while len(parts) > want:
        at = boundary.index(min(boundary))
        parts[at : at + 2] = [". ".join(parts[at : at + 2])]
        del boundary[at]
    return parts


def test_overflow_pieces(spark):
    rng = random.Random(4)
    texts = ["alpha beta gamma. alpha beta delta. other words here. other words there. " * 3, "short. text", "x" * 100, "a b c. a b c. " + "d " * 40, ". . . " * 40, "", None]
    texts += [". ".join(" ".join(rng.choice(["a", "bé", "c1", "d_d", ""]) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 25))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", segment.overflow_pieces(F.coalesce("t", F.lit("")), 20).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == [merged_step_by_step(t or "", 20) for t in texts]
    assert got[3][0] == "a b c. a b c"  # the lowest boundary goes first


def test_retry_then_second_model():
    calls = []

    def first(texts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return ["first"] * len(texts)

    assert hooks.with_retry(first)(["a"]) == ["first"] and len(calls) == 3
    assert hooks.with_retry(hooks.unavailable, lambda texts: ["second"] * len(texts), attempts=2)(["a", "b"]) == ["second"] * 2
    with pytest.raises(RuntimeError):
        hooks.with_retry(hooks.unavailable)(["a"])


def test_windows_past_a_threshold():
    rng = random.Random(6)
    for _ in range(60):
        short = "".join(rng.choice("abcd ") for _ in range(rng.choice([5, 19, 20, 45, 80])))
        near = "".join(c for c in short if rng.random() > 0.02)
        long = "".join(rng.choice("abcd ") for _ in range(50)) + near + "".join(rng.choice("abcd ") for _ in range(40))
        plain = fuzzy._window_ratio(short, long)
        assert fuzzy._window_ratio(short, long, 95) == (plain if plain >= 95 else 0)


@pytest.mark.parametrize("text", ["As As As As As As As As", "The The The The The The The The The", "a" * 20])
def test_likeness_of_repeated_words(text):
    """One letter changed is one letter apart, also where the text repeats itself."""
    changed = text[:5] + "~" + text[6:]
    want = 100 * (len(text) - 1) / len(text)
    assert fuzzy._window_ratio(changed, text) == fuzzy._window_ratio(changed, text, 95) == want
    assert fuzzy._window_ratio(changed, f"{text[:9]} {text} {text[3:]}", 95) == want


def test_contained(spark):
    parts = spark.createDataFrame([("a",), ("red w",), ("get",), ("gear box",), ("%",)], "part string")
    wholes = spark.createDataFrame([(1, "red widget"), (2, "gear"), (3, "100%"), (4, ""), (5, None)], "id long, whole string")
    got = {(r.part, r.id) for r in graph.contained(parts, "part", wholes, "whole").collect()}
    assert got == {("a", 2), ("red w", 1), ("get", 1), ("%", 3)}


def test_layered_scores(spark):
    rows = [(1, "d", "x", 7, 0.5, 1), (1, "d", "y", 7, 9.0, 2), (1, "s", "x", 8, 0.25, 1)]
    got = {(r.level, r.id): r.score for r in retrieval.layered_scores(spark.createDataFrame(rows, "query_id long, level string, source string, id long, score double, rank int")).collect()}
    assert got[("d", 7)] == pytest.approx(1 / 61 + 1 / 62) and got[("s", 8)] == 0.25


def test_text_helpers_on_single_cases(spark):
    """Cases that no table has: spans over broken lines, cut-off JSON, overlaps of repeated letters, sections without headings."""
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    at = lambda content, span: one(fuzzy.collapsed_span(F.lit(content), F.lit(span)))
    assert (at("ab  cd \n ef", "cd ef").s, at("ab  cd \n ef", "cd ef").e) == (4, 11) and at("xyz", "xyz").e == 3 and at("abc", "q").s is None
    assert [one(fuzzy.partial_ratio(F.lit(a), F.lit(b))) for a, b in (("abc", "xxabcxx"), ("abcd", "zzabxdzz"), ("q", "abc"))] == [100.0, 75.0, 0.0]
    repaired = lambda t: one(F.get_json_object(X.repaired_json(F.lit(t)), "$.a"))
    assert [repaired(t) for t in ('text ```json\n{"a": 1,}\n``` end', '{"a": 2, "b": [1, 2,]}', '{"a": 3')] == ["1", "2", None]
    assert [one(fuzzy.merge_fragments(F.lit(a), F.lit(b))) for a, b in (("abcd", "cdef"), ("ab", "xy"), ("aaa", "aab"))] == ["abcdef", "abxy", "aaab"]
    assert one(fuzzy.deep_merge(F.lit('{"a":{"x":1,"y":2},"b":[1]}'), F.lit('{"a":{"y":3},"b":[2],"c":4}'))) == '{"a":{"x":1,"y":3},"b":[2],"c":4}'
    book = "# First book\nintro\n## One\nISBN 978-1\n### Deep\nbody\n---\n# Second\nISBN 978-2\ntext ![cap](img/a.png) and <img src=\"b.jpg\" alt=\"B\">\n"
    docs = spark.createDataFrame([(1, book)], "doc_id int, text string")
    assert sorted((r.line_start, r.line_end, r.title) for r in ingest.split_books(docs, min_lines=2).collect()) == [(1, 6, "First book"), (8, 11, "Second")]
    assert sorted((r.line_no, r.image) for r in ingest.image_references(docs).collect()) == [(10, "b.jpg"), (10, "img/a.png")]


def test_collapsed_spans_of_a_text(spark):
    """All spans of a text at once, each where it stands in the text as it is."""
    texts = ["  a  b\tc a b ", "plain words here", " \n", "x\u00a0y z", ""]
    spans = ["a b", "b c a", "c a b", "words  here", "x y", "", " ", "zz", "a"]
    got = spark.createDataFrame([(t, spans) for t in texts], "t string, p array<string>").select("t", fuzzy.collapsed_spans(F.col("t"), F.col("p")).alias("at")).collect()
    for r in got:
        for p, at in zip(spans, r["at"]):
            found = re.search(r"\s+".join(map(re.escape, p.split())), r["t"]) if p.split() else None
            assert (at["s"], at["e"]) == (found.span() if found else (None, None)), (r["t"], p)
