"""The pipeline's stages: odd rows, columns, and what each leaves, against brute force."""

import struct
import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from strataq.llm import classifier, queries


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard", "suffix_dedup", "best_fit_packing"]


def test_odd_rows(spark, sf, tables):
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0), (9001, "", "en", "s", 0), (9002, "z" * 50_000, None, None, 1)], tables.schema).withColumn("_key", F.lit(1)).withColumn("_text", F.lit("x"))
    for docs in (odd, odd.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf)
            if name != "best_fit_packing":
                assert out.columns == docs.columns, name
            out.collect()


def without_boilerplate(rows):
    """Lines with a word on more than a twentieth, and on two at least, of the pages of a source go."""
    pages, on = Counter(source for _, source, _ in rows), Counter()
    for _, source, text in rows:
        on.update({(source, line) for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")})
    gone = {k for k, n in on.items() if n > 1 and n / pages[k[0]] > 0.05}
    return {i: "\n".join(line for line in text.split("\n") if (source, line) not in gone) for i, source, text in rows}


def test_run_against_brute_force(spark, sf, tables):
    """run() as a whole: what plain Python leaves after each stage, and the rows of the last one."""
    before = {r.doc_id: r for r in tables.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    model = classifier.fit(tables, labels)
    texts = [(r.text or "").encode() for r in before.values()]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    scores = model.score(classifier.pooled(model.vectors, np.frombuffer(b"".join(texts), np.uint8), offs))
    good = {i for i, s in zip(before, scores) if s >= P.REJECT_BELOW}
    assert len(good) > 0.75 * len(before)
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in before}
    assert sum((i in good) == bool(q) for i, q in known.items()) > 0.9 * len(known)
    kept = {"line_dedup": without_boilerplate([(i, r.source, r.text or "") for i, r in before.items() if i in good])}
    sets = {}
    for i, t in kept["line_dedup"].items():
        w = t.lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b]) if b < a else 0
            if n and 5 * n >= 4 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    kept["ngram_jaccard"] = {i: kept["line_dedup"][i] for i in {root(i) for i in ids}}
    starts = Counter(t.encode()[k : k + 200] for t in kept["ngram_jaccard"].values() for k in range(len(t.encode()) - 199))
    kept["suffix_dedup"] = {}
    for i, t in kept["ngram_jaccard"].items():
        data, mark = t.encode(), bytearray(len(t.encode()))
        for k in range(len(data) - 199):
            if starts[data[k : k + 200]] > 1:
                mark[k : k + 200] = b"\1" * 200
        kept["suffix_dedup"][i] = "".join(c for c, m in zip(t, (all(mark[a:b]) for a, b in _spans(t))) if not m)
    library, want = tokenizers.Tokenizer.from_file(queries.WORD_BPE), []
    for i, t in kept["suffix_dedup"].items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    packed = P.run(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in packed) == sorted(want)
    assert len({r.sequence_id for r in packed}) == -(-sum(r.length for r in packed) // 4096)


def _spans(text):
    at = 0
    for c in text:
        n = len(c.encode())
        yield at, at + n
        at += n
