"""The ten operators against brute force, exact round trips and held-out labels; and the odd rows each must bear."""

import base64
import hashlib
import json
import random
import re
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strataq.llm import bpe, classifier, exact_dedup, line_dedup, ngram_join, oracles, packing, queries, rules, suffix_dedup, url_filter, warc
from strataq.llm import bytesops as B
from strataq.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empties, white space alone, repeated rows, an id that comes twice, odd characters, one very long word.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (4, "a b c"), (4, "another text"), (None, "lost id"), (None, None), (5, "é😀 'tis ñ\x00x"), (6, "z" * 30_000), (7, "one\ntwo\none\n\n")]
CLASH = ["_id", "_text", "_h", "_a", "_b", "_row", "_c", "_k", "_d", "_len", "_maybe", "_host", "_drop", "_size", "spans", "kept", "component", "_quality_score"]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéfg") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(60) for _ in range(4)]
    texts = ["a" * 1000, "ab" * 400, "x", "A b C d", "a B c D"]
    for _ in range(70):
        t = words(rng.choice([3, 8, 14, 22, 60, 150, 300]))
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(t))
            t[k:k] = rng.choice(passages)[rng.randint(0, 20) : rng.randint(30, 60)]
        texts.append(" ".join(t))
        for _ in range(rng.choice([0, 0, 1, 4])):
            c = list(t)
            for _ in range(rng.randint(0, max(1, len(c) // 40))):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c))
    base = words(200)
    for _ in range(50):
        c = list(base)
        for _ in range(rng.randint(1, 5)):
            c[rng.randrange(len(c))] = rng.choice(vocabulary)
        texts.append(" ".join(c))
    rng.shuffle(texts)
    return texts


# 1 url filter


def test_url_rules_and_reputation(spark):
    urls = ["http://A.Example.ORG/en/1x?q#f", "x://example.org", "no scheme", None, "http://example.org/es/", "https://m.de.com/de/a", "http://bad.net/x", "http://good.net/y", "http://www.bad.net/"]
    pages = frame(spark, [*((i, u) for i, u in enumerate(urls)), (50, "http://good.net/")] + [(100 + i, "http://bad.net/p") for i in range(40)] + [(200 + i, "http://good.net/p") for i in range(40)], "page_id long, url string")
    labels = frame(spark, [("bad.net", 0)] * 40 + [("good.net", 1)] * 40 + [("good.net", None), (None, 1), ("never.seen", 0)], "host string, good int")
    got = {r.page_id: r for r in url_filter.url_filter(clashing(pages), labels, queries.URL_RULES).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.org", "/en/1x", "example.org/en/1", "block")
    assert (got[1].host, got[1].path, got[1].rule) == ("example.org", "", None)
    assert (got[2].host, got[2].path, got[3].host) == ("", "", "")
    assert got[4].rule == "example.org/es/" and got[5].rule == "com/de/" and got[5].verdict == "block"
    assert got[6].verdict == "block" and got[7].verdict == "allow"
    assert got[6].post_upper < got[8].post_upper < got[7].post_upper  # a subdomain without labels leans on its domain
    assert url_filter.url_filter(pages.limit(0), labels.limit(0), queries.URL_RULES).count() == 0
    assert url_filter.url_filter(pages, labels.limit(0), queries.URL_RULES).filter("rule is null and verdict <> 'allow'").count() == 0


def test_repeated_pages_count_by_row(spark, tmp_path):
    """Rows of one page id on two hosts: each host gets the outcomes of its own rows, in the operator as in the SQL."""
    pages = [(1, "http://a.net/9"), (1, "http://b.net/8"), (1, "http://a.net/9"), (3, "http://c.net/8"), (None, "http://c.net/7")]
    frame(spark, pages, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    frame(spark, [(9, 1), (8, 0), (7, 1)], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    outcomes = [("a.net", 1), ("a.net", 1), ("b.net", 0), ("c.net", 0), ("c.net", 1)]
    counts = {r.host: (r.n, r.good) for r in url_filter.host_reputation(frame(spark, outcomes, "host string, good int")).collect()}
    assert counts == {"a.net": (2, 2), "b.net": (1, 0), "c.net": (2, 1)}
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(oracles.oracle_sql()["op1_url_reputation"])
    got = queries.op1_url_reputation(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())) and len(got) == 5


# 2 suffix-array dedup


def covered(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        yield len(b), sum(mark), sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length, hot", [(200, 20_000), (200, 5), (30, 20_000)])
def test_suffix_dedup(spark, corpus, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    rows = [*enumerate(corpus), *((1000 + (i or 0), t) for i, t in ODD)]
    got = suffix_dedup.removal_digests(frame(spark, rows).repartition(3), length=length).collect()
    want = [(i, *x) for (i, _), x in zip(rows, covered([t for _, t in rows], length))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_columns_of_any_name(spark):
    """Names with blanks and dots pass through every operator that takes column names."""
    rows = [(1, "x " * 150 + "one"), (2, "y " + "x " * 150 + "two"), (None, None)]
    docs = spark.createDataFrame(rows, "`the id` long, `a.text` string")
    how = {"id_col": "the id", "text_col": "a.text"}
    assert suffix_dedup.remove_repeats(docs, length=200, **how).columns == docs.columns
    assert suffix_dedup.removal_digests(docs, length=200, **how).columns[0] == "the id"
    spelt = {"vocabulary": queries.BYTE_BPE, "pattern": public_tokenizers.PATTERN}
    assert bpe.roundtrip_digests(docs, **how, **spelt).count() == bpe.decode(bpe.encode(docs, **how, **spelt), vocabulary=queries.BYTE_BPE, pattern=public_tokenizers.PATTERN, id_col="the id").count() == 3


def test_suffix_dedup_keeps_characters(spark):
    shared = "é" * 150
    rows = [(1, "x" + shared + "1"), (2, "yy" + shared + "2"), (None, None)]
    out = suffix_dedup.remove_repeats(clashing(frame(spark, rows)), length=200)
    assert out.columns[:2] == ["doc_id", "text"] and {r.doc_id: r.text for r in out.collect()} == {1: "x1", 2: "yy2", None: ""}
    assert suffix_dedup.remove_repeats(frame(spark, []), length=200).count() == 0


# 3 exact dedup


def test_exact_dedup(spark):
    rows = [*ODD, (10, "ab c"), (11, "a bc"), (12, "a b  c"), (13, "abc\n")]
    got = exact_dedup.exact_dedup(clashing(frame(spark, rows)).repartition(3)).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    abc = [r for r in got if r.text_sha256 == hashlib.sha256(b"abc").hexdigest()]
    assert len(abc) == 6 and {r.keep_id for r in abc} == {12} and {r.group_size for r in abc} == {6}
    empty = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {3} and len(empty) == 4
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_with_a_full_filter(spark):
    rows = [(i, f"t{i % 900}") for i in range(1000)]
    got = exact_dedup.exact_dedup(frame(spark, rows), bits_per_row=1, max_bits=32768, k=1).collect()
    assert sum(r.kept for r in got) == 900 and all(r.keep_id == r.doc_id % 900 for r in got)


def test_exact_dedup_in_ranges(spark):
    """More rows than one filter may hold: each range of digests has its own, and none is full."""
    rows = [(i, f"t{i % 9000}") for i in range(10_000)]
    got = exact_dedup.exact_dedup(frame(spark, rows), bits_per_row=16, max_bits=65536).collect()
    assert len(got) == 10_000 and sum(r.kept for r in got) == 9000 and all(r.keep_id == r.doc_id % 9000 and r.group_size == 1 + (r.keep_id < 1000) for r in got)


# 4 quality rules


def test_statistics(spark, corpus):
    texts = corpus + [t for _, t in ODD] + ["a a a a a a a a a a a\na\n a\na\n$$%"]
    got = {r[0]: r for r in rules.statistics(clashing(frame(spark, list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many, inside, seen, dup = Counter(grams), set(), set(), 0
        for k, g in enumerate(grams):
            if many[g] > 1:
                inside.update(range(k, k + 8))
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(inside))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_decision_list(spark):
    rng = np.random.default_rng(1)
    n = 3000
    stats = {k: rng.integers(0, 100, n) for k in rules.STATS}
    stats["word_chars"] = np.full(n, 100)
    bad = (stats["n_symbols"] > 70) & (stats["n_words"] > 20)
    found = rules.learn(stats, 1 - bad.astype(int))
    x = rules.feature_values(stats)
    caught = np.zeros(n, bool)
    for r in found:
        caught |= rules._covers(r, x)
    assert found and (caught & bad).sum() / bad.sum() > 0.5 and (caught & ~bad).sum() / max(1, caught.sum()) < 0.15
    assert rules.learn(stats, np.ones(n, int)) == []
    out = rules.quality_rules(clashing(frame(spark, ODD)), frame(spark, [], "doc_id long, quality int")).collect()
    assert len(out) == len(ODD) and not any(r.kept for r in out)
    assert rules.quality_rules(frame(spark, []), frame(spark, [(1, 1)], "doc_id long, quality int")).count() == 0


def test_decision_list_keeps_good_documents(spark):
    got = queries.op4_quality_rules(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = got.filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) / n[1, True] < 0.02 and n.get((0, False), 0) > 2 * n.get((0, True), 0)


def test_kept_by_the_learnt_list(spark, corpus):
    """The list's decisions row by row: the first rule that _covers the row's statistics, and the base rules before it."""
    texts = corpus + [" ".join(f"w{k}" for k in range(n)) + " # $ % &" * (n % 7) for n in range(20, 200)]
    docs = frame(spark, list(enumerate(texts)))
    good = [int("#" not in t) for t in texts]
    out = {r.doc_id: r for r in rules.quality_rules(docs, frame(spark, list(enumerate(good)), "doc_id long, quality int")).collect()}
    order = [r.doc_id for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    stats = {k: np.array([out[i][k] for i in order]) for k in rules.STATS}
    learnt = rules.learn(stats, np.array([good[i] for i in order]))
    assert learnt
    x = rules.feature_values(stats)
    covers = [rules._covers(rule, x) for rule in learnt]
    for at, i in enumerate(order):
        first = next((k for k, c in enumerate(covers, 1) if c[at]), None)
        failed = out[i].n_words < 20 or 100 * out[i].n_repeat_words > 30 * out[i].n_words
        assert (out[i].rule, out[i].base_failed, out[i].kept) == (first, failed, not failed and first is None)
    assert 0 < sum(r.kept for r in out.values()) < len(out)


# 5 WARC


def test_warc_round_trip(spark):
    evil = "x WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n é"
    rows = [(1, "u", "p"), (2, None, None), (3, "http://a\r\nb", ""), (4, "u", evil), (5, "u", evil), (6, "u", "WARC/1.0\r\n"), (7, "u", "\r\n\r\nWARC/1.0\r\n" * 50), (8, "u", "WARC/1.0"), (9, "u", "z" * 70_000 + "WARC/1.0\r\n" + "y" * 90_000), (None, "u", "q"), (11, "u", "p"), (10, "u", "p")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")  # blocks cut records anywhere
    try:
        pages = clashing(frame(spark, rows, "page_id long, url string, html string")).coalesce(2)
        got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(pages).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first: dict[bytes, int] = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert got[i] == (len(data), digest, "revisit" if data in first else "response", first.get(data)), i
        first.setdefault(data, i)
    assert warc.round_trip(frame(spark, [], "page_id long, url string, html string")).count() == 0
    large = {r.page_id: r.record_type for r in warc.round_trip(pages, min_bytes=100).collect()}
    assert large[10] == large[11] == "response" and large[5] == "revisit"


def test_warc_repeated_rows(spark):
    """Of rows alike in id and payload one is the response, the first; all others and further pages refer to it."""
    rows = [(3, "w", "P"), (1, "u", "P"), (1, "v", "P"), (1, "u", "P"), (1, "u", "other"), (2, "x", "once"), (2, "x", "once"), (None, "y", "P"), (None, "y", "lost"), (None, "y", "lost")]
    out = warc.round_trip(frame(spark, rows, "page_id long, url string, html string").coalesce(1)).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, "P", "response", None), (1, "P", "revisit", 1), (1, "P", "revisit", 1), (3, "P", "revisit", 1), (None, "P", "revisit", 1), (1, "other", "response", None)]
    want += [(2, "once", "response", None), (2, "once", "revisit", 2), (None, "lost", "response", None), (None, "lost", "response", None)]
    assert sorted(map(tuple, out), key=str) == sorted([(i, len(t), digest(t), kind, to) for i, t, kind, to in want], key=str)


def test_warc_first_row_is_the_response(spark):
    path = f"{warc.shared_dir(spark)}/first-row"
    warc.write_warc(frame(spark, [(1, "b", "P"), (1, "a", "P"), (1, "c", "P")], "page_id long, url string, html string").coalesce(1), path)
    records = [r.value for r in spark.read.option("lineSep", warc.END).text(path).collect()]
    heads = [r for r in records if "WARC-Type: response" in r]
    assert len(heads) == 1 and "WARC-Target-URI: b" in heads[0]


# 6 line dedup


def test_line_dedup(spark):
    rows = [(i, "a", f"head\nbody {i}\n\n \nhead" if i < 30 else f"own {i}") for i in range(60)] + [(100 + i, "b", f"head\nx{i // 2}") for i in range(41)] + [(200, None, None), (201, "a", ""), (300, "c", "alone\nalone"), (400, "d", "twice"), (400, "d", "twice")]
    docs = clashing(frame(spark, rows, "doc_id long, source string, text string"))
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs, counts=True).collect()}
    assert out[0].text == "body 0\n\n " and out[0].n_dropped == 2 and out[40].text == "own 40"
    assert out[100].text == "x0" and out[140].text == "x20" and out[200].text is None and out[201].text == ""
    assert out[300].text == "alone\nalone" and out[400].text == ""  # repeated rows are two pages of two
    assert out[0]._host == "x" and line_dedup.line_dedup(docs.limit(0)).count() == 0


# 7 n-gram Jaccard join


def linked(texts, n, num, den):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n, num, den, scan", [(3, 9, 10, 256), (5, 4, 5, 256), (3, 9, 10, 2), (2, 1, 2, 3)])
def test_jaccard_components(spark, corpus, monkeypatch, n, num, den, scan):
    monkeypatch.setattr(ngram_join, "SCAN", scan)
    texts = corpus + [t for _, t in ODD]
    got = {r._id: (r.n_shingles, r.component) for r in ngram_join.jaccard_components(frame(spark, list(enumerate(texts))).repartition(3), n=n, num=num, den=den).collect()}
    assert [got[i] for i in range(len(texts))] == linked(texts, n, num, den)


def test_jaccard_rows_with_repeated_and_null_ids(spark):
    """Every row has its own; a component's id is the least of its ids, null where it has none."""
    rows = [*ODD, (4, "d e f"), (9, "D e F"), (8, "lost id"), (None, "A b C")]
    got = sorted(((r._id, r.n_shingles, r.component) for r in ngram_join.jaccard_components(frame(spark, rows).repartition(3), n=3, num=9, den=10).collect()), key=str)
    want = []
    for (i, t), (n, root) in zip(rows, linked([t for _, t in rows], 3, 9, 10)):
        mates = [rows[k][0] for k, (_, r) in enumerate(linked([t for _, t in rows], 3, 9, 10)) if r == root]
        want.append((i, n, min((m for m in mates if m is not None), default=None)))
    assert got == sorted(want, key=str)


def test_keep_first(spark, corpus):
    rows = [*enumerate(corpus[:60]), *((1000 + (i or 0) if i is not None else None, t) for i, t in ODD)]
    out = ngram_join.keep_first(clashing(frame(spark, rows)).repartition(3))
    assert out.columns[:2] == ["doc_id", "text"]
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(set(got)) and (1004, "a b c") in got and (None, None) in got and (1001, None) in got
    assert len(got) == len({r for _, r in linked([t for _, t in dict.fromkeys(rows)], 5, 4, 5)})
    assert ngram_join.keep_first(frame(spark, [])).count() == 0


def test_sketches_never_part_linked_sets():
    rng, limit = np.random.default_rng(3), ngram_join.Threshold(9, 10)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64)
    sets = [np.sort(np.unique(np.concatenate([base[: m - k], rng.integers(0, 1 << 63, k, dtype=np.int64).astype(np.uint64)]))) for m in (12, 90, 100, 400, 2900) for k in (0, 1, 3, 5, 9)]
    doc = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    size = np.array([s.size for s in sets])
    sketch = ngram_join.parity_sketches(doc, np.concatenate(sets), size, limit)
    words, start = np.frombuffer(b"".join(sketch), np.uint64), np.concatenate([[0], np.cumsum([len(k) // 8 for k in sketch])])
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = ngram_join.within(i, j, size, words, start, limit) >= 0
    linked = np.array([10 * np.intersect1d(sets[a], sets[b]).size >= 9 * np.union1d(sets[a], sets[b]).size for a, b in zip(i, j)])
    assert got[linked].all() and got.sum() < linked.sum() + 20


def test_boundary_follows_cost():
    """Short lists are scanned; where lists are long, sets of the same sizes enumerate subsets, up to the size where these cost more than any list."""
    limit = ngram_join.Threshold(9, 10)
    assert [limit.subsets(s) for s in (9, 10, 19, 20)] == [1, 11, 20, 211] and limit.most_light() == 29
    short = {s: (100, 100 * limit.entries(s), 50) for s in range(1, 30)}
    long = {s: (100, 100 * limit.entries(s), 100 * limit.entries(s) * 200) for s in range(1, 30)}
    assert limit.boundary(short) <= 10 and limit.boundary(long) == 20
    assert limit.boundary({s: x for s, x in short.items() if s < 15} | {s: x for s, x in long.items() if s >= 15}) == 20
    assert limit.boundary({s: x for s, x in long.items() if s < 15} | {s: x for s, x in short.items() if s >= 15}) == 15
    assert limit.boundary({}) == 1
    assert all(limit.den * i >= limit.num * (i + limit.removable(s)) for s in range(1, 25) for i in [s - limit.removable(s)])


@pytest.fixture(scope="module")
def short_texts():
    """Sets of 8 to 34 n-grams in families that share most of them, and one run of words that all of them begin with."""
    rng = random.Random(21)
    word = lambda: "w" + str(rng.randrange(10**6))
    out = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(10, 36))]
        for _ in range(rng.randint(1, 5)):
            c = list(base)
            if rng.random() < 0.6:
                c[rng.choice([0, -1])] = word()
            if rng.random() < 0.3:
                c.append(word())
            out.append(" ".join(c))
    return out + [" ".join(["one", "two", "three"] + [word() for _ in range(rng.randint(6, 20))]) for _ in range(60)]


@pytest.mark.parametrize("bound", [None, 1, 10, 15, 20, 30])
def test_components_at_any_boundary(spark, short_texts, monkeypatch, bound):
    """Light and heavy ways give the same components wherever the boundary lies."""
    seen = []
    if bound:
        monkeypatch.setattr(ngram_join.Threshold, "boundary", lambda self, scans: seen.append(scans) or bound)
    got = {r._id: (r.n_shingles, r.component) for r in ngram_join.jaccard_components(frame(spark, list(enumerate(short_texts))).repartition(3), n=3, num=9, den=10).collect()}
    assert [got[i] for i in range(len(short_texts))] == linked(short_texts, 3, 9, 10)
    if seen:
        limit, sizes = ngram_join.Threshold(9, 10), Counter(len(s) for s in {frozenset(tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)) for t in short_texts})
        assert {s: v[0] for s, v in seen[0].items()} == {s: n for s, n in sizes.items() if s <= limit.most_light()}


# 8 quality classifier


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_quality_classifier(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.99
    assert np.mean([(r.score - r.quality) ** 2 for r in rows]) < 0.02


def test_classifier_odd_rows(spark):
    docs = clashing(frame(spark, ODD))
    labels = frame(spark, [(4, 1), (5, 0), (5, 1), (6, 0), (7, None), (None, 1), (999, 0)], "id long, y int")
    got = classifier.score(docs, classifier.fit(docs, labels), keep=["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = classifier.fit(docs, labels.limit(0))
    assert {r.score for r in classifier.score(docs, none, keep=["doc_id"]).collect()} == {0.5}
    assert classifier.score(frame(spark, []), none, keep=["doc_id"]).count() == 0


# 9 byte-level BPE


def test_bpe_as_tiktoken(spark, corpus):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = corpus + [t for _, t in ODD] + ["  \n\n x  ", "<|endoftext|>", "ß" * 999 + "x" * 4097]
    docs = clashing(frame(spark, list(enumerate(texts))))
    how = {"vocabulary": queries.BYTE_BPE, "pattern": public_tokenizers.PATTERN}
    digests = {r.doc_id: r for r in bpe.roundtrip_digests(docs, **how).collect()}
    ids = bpe.encode(docs, **how)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, **how).collect()}
    for r in ids.collect():
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text) and back[r.doc_id] == text.encode()
        d = digests[r.doc_id]
        assert d.n_tokens == len(r.ids) and d.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest() and d.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(frame(spark, []), **how).count() == 0


def test_bpe_rows_with_repeated_and_null_ids(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.roundtrip_digests(frame(spark, ODD).repartition(3), vocabulary=queries.BYTE_BPE, pattern=public_tokenizers.PATTERN).collect()
    want = []
    for i, t in ODD:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_packing_rows_with_repeated_and_null_ids(spark):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(queries.WORD_BPE)
    got = packing.best_fit_packing(frame(spark, ODD).repartition(3), tokenizer=queries.WORD_BPE).collect()
    want = []
    for i, t in ODD:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(o == (places[k - 1][1] + places[k - 1][2] if k and places[k - 1][0] == s else 0) for k, (s, o, _) in enumerate(places)) and max(o + n for _, o, n in places) <= 4096


def test_long_pieces_merge_as_the_library_does():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    coder, rng = bpe.ByteBpe(ranks), random.Random(8)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("ab", 3000), ("a", 5001), ("éüß the of", 4000), ("tion", 6000)):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert coder.encode_pieces([text.encode()])[0].tolist() == library.encode_ordinary(text)
    odd = {bytes([b]): 1000 + b for b in range(256)} | {b"ab": 5, b"abc": 3, b"bab": 4, b"abab": 9, b"ca": 7, b"abca": 1}  # later tokens of lower rank
    library, coder = tiktoken.Encoding("odd", pat_str=r"(?s).+", mergeable_ranks=odd, special_tokens={}), bpe.ByteBpe(odd)
    for _ in range(50):
        text = "".join(rng.choice("abc") for _ in range(600))
        assert coder.encode_pieces([text.encode()])[0].tolist() == library.encode_ordinary(text)


def test_pair_table():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    table = bpe.PairTable(keys, np.arange(keys.size, dtype=np.int32))
    assert (table.get((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)) == np.arange(keys.size)).all()
    assert (table.get(np.array([-1, 1 << 20]), np.array([3, 1])) == bpe.NONE).all()


# 10 best-fit packing


def fewest(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_packing_near_the_optimum():
    rng = random.Random(2)
    more = 0
    for _ in range(300):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        assert packing.least_bins(dict(Counter(lengths)), 20) <= fewest(lengths, 20)
        bins = packing.pack(dict(Counter(lengths)), 20)
        assert sum(t for t, _ in bins) >= fewest(lengths, 20) and all(sum(s * k for s, k in use.items()) <= 20 for _, use in bins)
        used = Counter()
        for t, use in bins:
            used.update({s: t * k for s, k in use.items()})
        assert used == Counter(lengths)
        more += sum(t for t, _ in bins) - fewest(lengths, 20)
    assert more == 0 and packing.pack({}, 20) == []
    assert sum(t for t, _ in packing.pack({3: 1, 2: 5000}, 4096)) == 3  # thousands of parts in one bin


def test_search_is_bounded_and_the_bound_sees_parts():
    """Pieces of over a third of a bin go two to a bin, and the bound knows; a log-normal corpus of thousands of lengths is packed as fast."""
    rng = random.Random(0)
    thirds = Counter(rng.randint(1366, 1999) for _ in range(2000))
    normal = Counter(min(4096, max(1, int(rng.lognormvariate(6.5, 1.2)))) for _ in range(60_000))
    assert packing.least_bins(dict(thirds), 4096) == 1000
    hard = Counter(rng.randint(1000, 1500) for _ in range(900))  # three to a bin as often as not: no bound is met, so it branches
    for histogram in (thirds, normal, hard):
        start = time.perf_counter()
        bins = packing.pack(dict(histogram), 4096)
        assert time.perf_counter() - start < 6  # 2 s on a free core
        used = Counter()
        for times, use in bins:
            assert sum(s * k for s, k in use.items()) <= 4096
            used.update({s: times * k for s, k in use.items()})
        assert used == histogram
        assert sum(t for t, _ in bins) <= 1.01 * packing.least_bins(dict(histogram), 4096) + 1 or histogram is hard


def test_incumbent_improves_on_the_way_down():
    """Where best fit and least waste both fail, the search finds the packing well before it has tried all."""
    rng = random.Random(12)
    better = 0
    for _ in range(40):
        histogram = Counter(rng.randint(26, 50) for _ in range(40))
        start = min(packing._bins(packing._fill(packing._counts(histogram, 150), 150, c)) for c in (packing._best_fit, packing.complete))
        got = packing._bins(packing.pack(dict(histogram), 150))
        assert got == packing.least_bins(dict(histogram), 150)
        better += got < start
    assert better > 0


def test_least_waste_completion():
    rng = random.Random(4)
    for _ in range(200):
        room = rng.randint(1, 40)
        count = np.array([0, *(rng.choice([0, 0, 1, 3]) for _ in range(room))])
        pieces = [s for s in range(1, room + 1) for _ in range(count[s])]
        sums = {0}
        for s in pieces:
            sums |= {t + s for t in sums if t + s <= room}
        fits = packing._fits(count)
        got = packing.complete(count, fits, room)
        assert sum(s * k for s, k in got.items()) == max(sums) and all(k <= count[s] for s, k in got.items())
        assert not packing.dominated({s: k for s, k in got.items() if k}, count, fits, room - max(sums))
        each = list(packing.completions(count, fits, room, 3, packing.Work(10**9)))
        wastes = [room - sum(s * k for s, k in use.items()) for use in each]
        assert wastes == sorted(wastes) and (not each or wastes[0] == room - max(sums)) and len({tuple(sorted(u.items())) for u in each}) == len(each)


def test_packing_keeps_words_in_work(monkeypatch):
    """A store past its limit in a slice whose words fill it: new words beside known ones, and a near copy with one new word."""
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    coder = packing.WordTokens(queries.WORD_BPE)
    first = " ".join(f"w{i}x" for i in range(40))
    for text in (first, first + " " + " ".join(f"{i * 7919}" for i in range(40)), first + " " + " ".join(f"{i * 7919}" for i in range(40)) + " onemore", "few old w1x", first):
        data = text.encode()
        got = coder.ids(np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64))
        assert np.frombuffer(got[0], "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_packing_places(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_BPE)
    texts = corpus + [t for _, t in ODD] + ["don't, it's. a.. b., é, –. 5, x́. 's. <|endoftext|>. 1.2, Été.", "w, " * 300]
    out = packing.best_fit_packing(clashing(frame(spark, list(enumerate(texts)))).repartition(3), tokenizer=queries.WORD_BPE, capacity=128).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, {})[r.piece] = r
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert sorted(by_doc[i]) == list(range(-(-len(ids) // 128)))
        for k, r in by_doc[i].items():
            one = ids[128 * k : 128 * k + 128]
            assert (r.start, r.length, r.ids_crc32) == (128 * k, len(one), zlib.crc32(np.array(one, "<u4").tobytes()))
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= 1.05 * -(-sum(r.length for r in out) // 128)
    assert packing.best_fit_packing(frame(spark, []), tokenizer=queries.WORD_BPE).count() == 0


# shared


def test_words_and_slices():
    import pyarrow as pa

    texts = ["a b", None, "", "c", " d\ne "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    for part, buf, offs in B.slices(batch, "t"):
        start, end, doc = B.words(buf, offs)
        assert [(int(d), bytes(buf[s:e]).decode()) for s, e, d in zip(start, end, doc)] == [(0, "a"), (0, "b"), (3, "c"), (4, "d"), (4, "e")]


@pytest.mark.parametrize("most", [0, 1, 7, 500, 4_999, 5_000, 6_000])
def test_least_hashed_is_the_head_of_the_whole_order(spark, most):
    rows = spark.range(0, 5_000, 1, 40).withColumn("x", F.col("id") * 2)
    want = rows.orderBy(F.xxhash64("id"), "id").limit(most).collect()
    assert common.least_hashed(rows, "id", most).collect() == want
    assert common.least_hashed(rows.limit(0), "id", most).collect() == []


def test_least_hashed_cuts_out_a_range_first(spark):
    rows = spark.range(0, 200_000, 1, 64)
    plan = common.least_hashed(rows, "id", 100)._jdf.queryExecution().optimizedPlan().toString()
    (bound,) = re.findall(r"Filter \(xxhash64\(id#\d+L, 42\) <= (-\d+)\)", plan)
    assert 100 <= rows.filter(F.xxhash64("id") <= int(bound)).count() <= 300


def test_every_operator_has_a_query():
    names = queries.queries()
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in names}) == list(range(1, 14))
    assert set(oracles.oracle_sql()) <= set(names) and json.dumps(oracles.oracle_sql())
