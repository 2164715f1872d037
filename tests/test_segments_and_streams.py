"""Segmenters against the plain way, chains with a hook that marks them, file scans and streams through files."""

import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from strataq.operators import ingest, segment
from strataq.streaming import telemetry

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


def plain_merges(v):
    """Every cost anew after every merge."""
    groups, out = [(i, i + 1) for i in range(len(v))], []
    while len(groups) > 1:
        cost = []
        for (s, m), (_, e) in zip(groups, groups[1:]):
            d = v[s:m].mean(0) - v[m:e].mean(0)
            cost.append((m - s) * (e - m) / (e - s) * float(d @ d))
        at = int(np.argmin(cost))
        out.append((cost[at], groups[at][1]))
        groups[at : at + 2] = [(groups[at][0], groups[at + 1][1])]
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 40, 150])
def test_ward_merges(n):
    v = np.random.default_rng(n).normal(size=(n, 8))
    got, want = segment.ward_merges(v), plain_merges(v)
    assert [b for _, b in got] == [b for _, b in want] and np.allclose([c for c, _ in got], [c for c, _ in want])


def test_ward_is_fast():
    v = np.random.default_rng(0).normal(size=(10_000, 16))
    assert len(segment.ward_merges(v)) == 9_999
    assert segment.hierarchical(v, longest=20_000)[-1] > 0


def marked(windows):
    """Chains that the texts mark themselves: [name:word]."""
    out = []
    for window in windows:
        chains = {}
        for k, text in enumerate(window):
            for m in re.finditer(r"\[(\w+):(\w+)\]", text):
                chains.setdefault(m.group(1), []).append((k, m.start(), m.group(2)))
        out.append([c for c in chains.values() if len(c) > 1])
    return out


def marked_roots(tails):
    return [re.findall(r"!(\w+)", t) for t in tails]


def brute_segments(texts):
    """Chains as components of marks at most two segments apart, then the walk."""
    marks = [(i, m.start(), m.group(1), m.group(2)) for i, t in enumerate(texts) for m in re.finditer(r"\[(\w+):(\w+)\]", t)]
    label = {m: k for k, m in enumerate(marks)}
    for _ in marks:
        for a in marks:
            for b in marks:
                if a[2] == b[2] and abs(a[0] - b[0]) <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    out, first, group = [], 0, -1
    for i in range(len(texts)):
        roots = set(re.findall(r"!(\w+)", "\n".join(texts[first:i])[-500:]))
        now = {label[m] for m in marks if m[0] == i}
        if not (i and any(first <= m[0] < i and label[m] in now and m[3].lower() in {r.lower() for r in roots} for m in marks)):
            first, group = i, group + 1
        out.append(group)
    return out


def test_chains_by_a_hook_that_marks_them(spark):
    rng = random.Random(3)
    docs = {0: ["[a:Ann] !ann", "[a:she] came", "[a:her] dog", "[a:it] ran !ann", "nobody", "[a:Ann] is back"], 1: ["alone"], 2: ["!x [q:x]", "", "", "[q:x]"]}
    for d in range(3, 30):
        docs[d] = [" ".join(rng.choice(["[a:ann]", "[a:she]", "[b:bob]", "[b:he]", "!ann", "!bob", "word"]) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 14))]
    rows = [(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)]
    got = segment.merge_by_chains(spark.createDataFrame(rows, "doc_id long, chunk_index long, content string").repartition(3), marked, marked_roots).collect()
    assert {(r.doc_id, r.chunk_index): r.segment for r in got} == {(d, i): g for d, texts in docs.items() for i, g in enumerate(brute_segments(texts))}
    assert brute_segments(docs[0])[:4] == [0, 0, 0, 0]  # ann is the subject still, through she and her


def test_documents_are_cut_without_a_shuffle(spark, monkeypatch):
    """Documents stay where they are: no exchange and no group for each; slices of a task hold whole documents, and empty ones vanish."""
    monkeypatch.setattr(segment, "TEXTS", 5)
    rng = random.Random(5)
    texts = {d: [" ".join(rng.choice(["harbour", "granite", "weather", "a", "Ñu", "x_1"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 12))] for d in range(20)}
    rows = [(d, list(enumerate(t))) for d, t in texts.items()] + [(98, []), (99, None)]
    documents = spark.createDataFrame(rows, "doc_id long, chunks array<struct<chunk_index:long,content:string>>").coalesce(1)
    for method, one in (("linear", segment.linear), ("hierarchical", segment.hierarchical)):
        got = segment.segments_of(documents, method)
        assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r.doc_id, r.chunk_index): r.segment for r in got.collect()} == {(d, i): g for d, t in texts.items() for i, g in enumerate(one(segment.sentence_vectors(t)))}
        flat = spark.createDataFrame([(d, i, t) for d, every in texts.items() for i, t in enumerate(every)], "doc_id long, chunk_index long, content string")
        assert sorted(got.collect()) == sorted(segment.segments(flat.repartition(3), method).collect())
    got = segment.merge_by_chains_of(documents).collect()
    assert {(r.doc_id, r.chunk_index): r.segment for r in got} == {(d, i): g for d, t in texts.items() for i, g in enumerate(segment.chain_segments(t, segment.word_chains, segment.first_long_words))}


def test_a_long_chain_is_not_walked_for_every_segment():
    """Work grows with the text, though a word runs through it all."""
    import time

    texts = ["another harbour " * 4] * 6000
    start = time.process_time()
    assert segment.chain_segments(texts, segment.word_chains, lambda tails: [["nothing"] for _ in tails]) == list(range(6000))
    assert segment.chain_segments(texts, segment.word_chains, segment.first_long_words) == [0] * 6000
    assert time.process_time() - start < 20


def test_chains_without_a_model(spark):
    def broken(windows):
        raise RuntimeError("no model")

    assert segment.chain_segments(["same subject here"] * 3, broken, marked_roots) == [0, 1, 2]
    assert segment.chain_segments(["subject one", "subject two", "another"], segment.word_chains, segment.first_long_words) == [0, 0, 1]


def test_united_chains():
    assert sorted(map(len, segment.united([[(0, 1, "a"), (1, 2, "b")], [(1, 2, "b"), (3, 0, "c")], [(7, 7, "z")]]))) == [1, 3]


def test_scan_of_a_folder_with_broken_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.md": b"# A\n\xc3\xa9", "sub/b.md": b"\xff\xfe bad", "c.md": b"", "gone.md": b"gone", "d.txt": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    scanned = ingest.scan_files(spark, str(tmp_path))
    os.remove(tmp_path / "gone.md")  # between listing and reading
    got = {r.path.split("/")[-1]: (r.text, r.error) for r in scanned.collect()}
    assert got == {"a.md": ("# A\né", None), "b.md": (None, "bad bytes"), "c.md": ("", "empty"), "gone.md": (None, "unreadable")}


def test_files_are_written_side_by_side(spark, tmp_path):
    """One folder and one file a row, whatever its bytes; written again, the same files."""
    rows = spark.createDataFrame([(f"{k}.md", bytes([65 + k % 20]) * k) for k in range(300)] + [("bad.md", b"\xff")], "name string, content binary").repartition(5)
    for _ in range(2):
        ingest.write_files(rows, f"file://{tmp_path}/out")
    assert len(os.listdir(tmp_path / "out")) == 301
    got = {r.path.split("/")[-1]: (r.text, r.error) for r in ingest.scan_files(spark, f"file://{tmp_path}/out").collect()}
    assert got == {f"{k}.md": (chr(65 + k % 20) * k, None if k else "empty") for k in range(300)} | {"bad.md": (None, "bad bytes")}


def test_streams_in_deliveries_equal_the_batch(spark, sf, tmp_path):
    """State is carried over deliveries, and what a batch wrote before a retry counts once."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    telemetry.in_deliveries(events, ((events.event_id > 400).cast("int") + (events.event_id > 800).cast("int")), str(tmp_path / "in"))
    stream = telemetry.fold_stream(telemetry.mapped_with_time(telemetry.raw_source(spark, str(tmp_path / "in"), files_per_batch=1).selectExpr(
        "event_id", "ts", "user_id as artifact_id", "case event_type when 'view' then 'retention_24h' when 'purchase' then 'conversion_30d' end as metric", "cast(round(value * 100) as long) as cents")))
    got = {(r.artifact_id, r.metric): r.cents for r in telemetry.latest(stream, ["artifact_id", "metric"], "cents").collect()}
    metric = {"view": "retention_24h", "purchase": "conversion_30d"}
    want = {}
    for r in sorted(events.collect(), key=lambda r: ((r.event_id > 400) + (r.event_id > 800), r.ts, r.event_id)):
        if r.event_type in metric and r.value is not None:
            key, cents = (r.user_id, metric[r.event_type]), int(np.floor(abs(r.value) * 100 + 0.5) * np.sign(r.value))
            want[key] = cents if key not in want else (want[key] + cents + 1) // 2
    assert got.keys() == want.keys() and sum(abs(got[k] - want[k]) > 1 for k in want) == 0


def fold_all(m, cents):
    for v in cents:
        m = v if m is None else (m + v + 1) // 2
    return m


def applied(effect, m):
    first, halvings, added, low, high, step = effect
    return first if m is None else (m + added) >> halvings if halvings is not None else high if m >= step else low


@pytest.mark.parametrize("seed", range(6))
def test_effects_of_runs(seed):
    """A run's effect on any average before it, and that of runs joined, is that of its events one by one."""
    rng = random.Random(seed)
    for _ in range(150):
        runs = [[rng.choice([0, 1, -5, rng.randrange(-(10**6), 10**12)]) for _ in range(rng.choice([1, 2, 30, 61, 62, 63, 200]))] for _ in range(rng.randint(1, 4))]
        whole = [v for r in runs for v in r]
        joined = telemetry._merged([telemetry._run_effect(r) for r in runs])
        for m in (None, 0, 1, -1, 10**12, rng.randrange(-(10**15), 10**15), joined[5] if joined[5] is not None else 7, (joined[5] or 0) - 1):
            if m is None or abs(m) < 1 << 60:
                assert applied(joined, m) == fold_all(m, whole)
                assert applied(telemetry._run_effect(whole), m) == fold_all(m, whole)


def test_fold_of_one_hot_key(spark):
    rng = random.Random(1)
    rows = [(k, k // 7, rng.choice([4, 4, 4, 4, 9]), "m", rng.randrange(10**9)) for k in range(3000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "event_id long, ts long, artifact_id long, metric string, cents long").repartition(7)
        got = {r.artifact_id: r.cents for r in telemetry.folded(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {a: fold_all(None, [r[4] for r in sorted(rows, key=lambda r: (r[1], r[0])) if r[2] == a]) for a in (4, 9)}
    assert telemetry.folded(df.limit(0)).count() == 0


def test_candidate_ngrams_take_words_once_a_row(spark, sf):
    """No transform over a row's words: it would take them again for every word."""
    from strataq import plans

    assert "transform(regexp_extract_all" not in plans.queries()["n09_candidate_ngrams"](spark, sf)._jdf.queryExecution().executedPlan().toString()
