"""Order MinHash against its definition with sets and sorts per sketch; neighbours by descending id; and the odd rows."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from strataq.llm import order_minhash

SKETCHES, PICK, K = 64, 2, 3
UNIT = re.compile(r"[^\x20\x09-\x0D]{1,16}")


def spark_hash(*values):
    """Spark's xxhash64 of values in a row: each one's hash seeds the next."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q" if isinstance(v, Long) else "<i", v)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed


class Long(int):
    pass


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text):
    units = UNIT.findall(text)
    mers = [signed(spark_hash(*units[i : i + K])) >> 31 for i in range(max(len(units) - K, 0) + 1)] if units else []
    seen, pairs = {}, []
    for at, m in enumerate(mers):
        n = seen[m] = seen.get(m, 0) + 1
        place = m if n == 1 else signed(spark_hash(Long(m << 31), n)) >> 31
        pairs.append((place, at, m))
    out = []
    for j in range(SKETCHES):
        start = -(1 << 32) + (j << 33) // SKETCHES
        least = sorted(pairs, key=lambda p: ((p[0] - start - 1) % (1 << 33), p[1]))[:PICK]
        value = spark_hash(*(Long(m << 31) for _, _, m in sorted(least, key=lambda p: p[1])))
        out.append(f"{value >> 32:08x}")
    return "".join(out)


def near(a, b):
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / SKETCHES


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(spark_hash(r[1] or ""))))
    for k, (i, text) in enumerate(rows):
        text, other = text or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        a, b = fingerprint(text), fingerprint(edited)
        yield i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), near(a, fingerprint(other))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdé😀") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 9, 30, 200])))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \n\t"), (103, "x" * 700), (104, "a " * 900), (105, "one"), (105, "one two"), (None, "lost id"), (None, None)]
    return out + [(200, "same words here again")] * 5 + [(201, "same words here again"), (-7, "last one of them all")]


def test_against_definition(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("_id", "_text", "_h", "_i", "_fp", "_row", "n_chars")})
    got = order_minhash.edited_likeness(docs)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "COPIES", 4)
    rows = [(1, "many equal rows")] * 23 + [(2, "another text"), (3, None)]
    got = order_minhash.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_one_row_and_none(spark):
    one = order_minhash.edited_likeness(spark.createDataFrame([(1, "a b c d e f")], "`doc_id` long, text string")).collect()
    assert [tuple(r) for r in one] == list(brute([(1, "a b c d e f")]))
    assert order_minhash.edited_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_follows_edits_and_order(spark):
    """Few edits leave texts alike, many do not; moved halves keep most k-mers but lose likeness where tuples span them."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    edit = lambda n: [f"e{rng.randrange(10**6)}" if i in set(rng.sample(range(600), n)) else w for i, w in enumerate(base)]
    texts = [base, edit(6), edit(60), edit(300), [f"o{i}" for i in range(600)], base[300:] + base[:300]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(docs).collect()}
    like = [sum(x == y for x, y in zip(f[0], f[i])) / SKETCHES for i in range(6)]
    assert like[0] == 1 and 0.75 < like[1] < 1 and like[1] > like[2] > like[3] >= like[4] == 0
    assert 0.25 < like[5] < 0.75  # two k-mers of different halves swap their order in half of the sketches
    named = spark.createDataFrame([(1, "a b")], "`an id` long, `a text` string")
    assert order_minhash.fingerprints(named, id_col="an id", text_col="a text", k=2, pick=1, sketches=8).columns == ["an id", "n_chars", "fingerprint"]


def test_no_step_is_written_out_in_a_lambda(spark):
    """A long text takes time in proportion: no array is worked out anew for every element."""
    plan = order_minhash.fingerprints(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("sort_array") <= 3
