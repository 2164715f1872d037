"""The prefix trie against a plain dictionary of prefixes; the distributed scan; and the odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataq.llm import prefix_trie as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    below, children = defaultdict(lambda: [0, 0]), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, cs in members.items():
        for d in range(len(node) + 1):
            below[node[:d]][0] += not children[node]
            below[node[:d]][1] += (len(cs) - 1) * len(WORD.findall(node[-1][1])) if node else 0
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if rebuilt[c] == node)
        yield min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children[node], *below[node], hashlib.sha256(ends.encode()).hexdigest()


def trie(conversations):
    return T.prefix_trie(*T.share_heads(T.coded_turns(conversations)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["yes", "no no", "", None, " \n", "a longer answer\x00 here é"]))
    out = [(c, k, *say()) for c in range(45) for k in range(rng.choice([1, 1, 2, 3, 5, 9]))]
    out += [(c, k, "user", "all alike") for c in range(60, 90) for k in range(5)]
    out += [(c, k, "user", f"turn {k}" if k < 70 or c < 202 else "other") for c in (200, 201, 202, 203) for k in range(140)]
    out += [(-3, 0, "user", "below zero"), (-25, 1, "user", "b"), (-25, None, "user", "a"), (119, 0, "user", "one"), (None, 0, "user", "lost"), (None, None, None, None)]
    return out + [(300, 1, "user", "twice")] * 6


def test_against_dictionary(spark, rows, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 4)
    conversations = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("_c", "_g", "_n", "_pid", "_end", "preorder")})
    got = trie(conversations).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(brute(rows), key=str)
    order = sorted(got, key=lambda r: r.preorder)
    assert [r.preorder for r in order] == list(range(1, len(got) + 1))
    for k, r in enumerate(order):  # what follows at a greater depth is the subtree, and nothing else
        end = next((j for j in range(k + 1, len(order)) if order[j].depth <= r.depth), len(order))
        assert r.subtree_end == end


def test_nothing_and_turnless(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    alone = [(c, 0, "user", "gone") for c in (21, 22, 23, 24, 25)]  # without conversation 20, heads are lost
    assert sorted((tuple(r)[:8] for r in trie(spark.createDataFrame(alone, SCHEMA)).collect()), key=str) == sorted(brute(alone), key=str)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scan(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([5, 5, 5, 5, 8, 9, -4]), k, rng.randrange(-(1 << 63), 1 << 63)) for k in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g long, k long, v long").repartition(3)
        for group in ("g", None):
            got = {r.k: (r._n, r.v_upto, r.v_before) for r in T.scan(df, group, [F.col("k")], ["v"], "scan").collect()}
            count, total = defaultdict(int), defaultdict(int)
            for g, k, v in rows:
                g = g if group else 0
                count[g] += 1
                was, total[g] = total[g], (total[g] + v) % (1 << 64)
                assert got[k] == (count[g], *(x - (1 << 64) if x >> 63 else x for x in (total[g], was)))
        assert T.scan(df.limit(0), "g", [F.col("k")], ["v"], "scan").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0]), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_ranks_are_lexicographic(spark):
    rng = random.Random(4)
    paths = {c: [rng.choice([1, 2]) for _ in range(rng.choice([1, 2, 7, 8, 9, 64, 65, 70]))] for c in range(80)} | {90 + i: [1] * n for i, n in enumerate([8, 16, 64, 65, 130, 600])}
    turns = spark.createDataFrame([(c, p, x, -x) for c, path in paths.items() for p, x in enumerate(path, 1)], "_c long, _p long, _c1 long, _c2 long")
    got = {r._c: r._rank for r in T.sequence_ranks(turns).collect()}
    order = {p: k for k, p in enumerate(sorted({tuple((x, -x) for x in path) for path in paths.values()}), 1)}
    assert got == {c: order[tuple((x, -x) for x in path)] for c, path in paths.items()}
