"""Cross-tokenizer alignment against the definition, written out text by text; and the odd rows it must bear."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataq.llm import alignment, queries

TEXTS = [
    None, "", " ", "a", " lead", "two  spaces", "line\nbreak\ttab \n x", "naïve café Ñandú über", "日本語 text 😀 \x00 end", "ﬁ ① ½", "a▁b", "<s> <|endoftext|> </s>",
    "don't we've  I'm", "x" * 3000, "word " * 500, "1234567 89.01", "trail   ", "é combining", "the the the other",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(queries.ENGLISH_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def spelt(libraries, text):
    """(id, bytes) of each token of both tokenizers; nothing where they do not give the text back."""
    a, b = libraries
    if not text:
        return [], []
    whole = " " + text
    of_a = a.encode(whole, add_special_tokens=False)
    # the library's own byte-level decoder says what each entry spells
    table = {c: i for i, c in enumerate(_characters())}
    one = [(i, bytes(table[c] for c in t)) for i, t in zip(of_a.ids, of_a.tokens)]
    two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    same = all(b"".join(x for _, x in side) == whole.encode() for side in (one, two))
    return (one, two) if same else ([], [])


def _characters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(i) if i in shown else chr(next(extra)) for i in range(256)]


def ends(side):
    at, out = 0, []
    for _, x in side:
        at += len(x)
        out.append(at)
    return out


def brute(libraries, texts):
    rows, links = [], []
    for text in texts:
        one, two = spelt(libraries, text)
        ea, eb = ends(one), ends(two)
        cuts = sorted(set(ea) & set(eb))
        groups, last = [], 0
        for c in cuts:
            groups.append(tuple(",".join(str(side[k][0]) for k, e in enumerate(stop) if last < e <= c) for side, stop in ((one, ea), (two, eb))))
            last = c
        rows.append((len(one), len(two), groups))
        links.append([(one[i][0], two[j][0]) for i, e in enumerate(ea) for j, f in enumerate(eb) if e == f])
    counts = Counter(x for own in links for x in own)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    for (n_a, n_b, groups), own in zip(rows, links):
        joined = ";".join("|".join(g) for g in groups)
        digest = hashlib.sha256(joined.encode()).hexdigest() if n_a else ""
        yield n_a, n_b, len(groups), len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), digest


def test_digests(spark, libraries, sf):
    own = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    rows = [*enumerate(TEXTS + own), (3, "the other"), (3, "the other"), (None, "null id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("_id", "_text", "links", "n_a", "_pair")})
    got = alignment.alignment_digests(docs, path_a=queries.ENGLISH_BPE, path_b=queries.PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *x) for (i, _), x in zip(rows, brute(libraries, [t for _, t in rows]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_alignment_and_overlaps(spark, libraries):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "`the id` long, `a text` string")
    for r in alignment.align(docs, path_a=queries.ENGLISH_BPE, path_b=queries.PIECES, id_col="the id", text_col="a text").collect():
        one, two = spelt(libraries, TEXTS[r["the id"]])
        assert [r.ids_a, r.ids_b] == [[i for i, _ in side] for side in (one, two)]
        spans = [[(e - len(x), e) for (_, x), e in zip(side, ends(side))] for side in (one, two)]
        meet = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)] if len(one) < 500 else None
        assert meet is None or [(x.a, x.b) for x in r.overlaps] == meet
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        assert [r.group_a, r.group_b] == [[sum(c < e for c in cuts) for _, e in side] for side in spans]


def test_no_rows_and_pairs_by_suffix(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_digests(empty, path_a=queries.ENGLISH_BPE, path_b=queries.PIECES).count() == 0
    assert alignment._suffix_pairs([b"", b"ab", b"b"], [b"b", b"xab", b"c"]).tolist() == [1 << 32, 1 << 32 | 1, 2 << 32, 2 << 32 | 1]
