"""Quality classifier on random-indexing word vectors.

Every word hashes to one of `buckets` rows.  A row's index vector is sparse,
ternary and random; its context vector is the sum of the index vectors met
within `window` words over the fitting sample (random indexing), scaled to unit
length and added to the index vector.  A word's ending has a row of its own, so
unseen words still say something.  Documents pool (mean) the vectors of all
their words, with the pooled length and how words repeat; a two-layer numpy
network scores the pooled vector, and one temperature, fitted on documents the
weights never saw, calibrates it.

The fit takes at most `max_labelled` labelled documents (those whose ids hash
lowest), a documented bound; scoring covers every word of every document.

Defined results: a null or empty text pools to zeros and gets the network's
score for that; null labels and ids do not train; repeated label rows of one id
count once, with the highest label; with fewer than two labelled classes every
score is the label mean (0.5 without labels).  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut, least_hashed, small_batches, text_or_empty, unused

U = np.uint64
#: Partitions of the fitting sample, each with one array of context sums.
SAMPLE_PARTS = 16


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(x.shape[0], self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def word_rows(buf: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, row of each word's last two bytes, text of each word)."""
    start, end, doc = B.words(buf, offs)
    h = B.Prefix(buf)
    word = h.of(start, end) % U(buckets)
    tail = B.mix(h.of(np.maximum(end - 2, start), end) + U(77)) % U(buckets)
    return word.astype(np.int32), tail.astype(np.int32), doc


def pool(vectors: np.ndarray, word: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """One document's pooled vector, and what pooling loses of its spread.

    Mean word vector; its length, the logarithm of the word count, and the squared
    length times the count (high where few words make up many); how often a word's
    row is the one before it.  Zeros without words.
    """
    n, dim = word.size, vectors.shape[1]
    out = np.zeros(dim + 4)
    if not n:
        return out
    for k in range(0, n, 1 << 14):
        part = slice(k, k + (1 << 14))
        out[:dim] += vectors[word[part]].sum(0, dtype=np.float64) + vectors[tail[part]].sum(0, dtype=np.float64)
    out[:dim] /= n
    square = float(out[:dim] @ out[:dim])
    out[dim:] = np.sqrt(square), np.log1p(n), square * min(n, 500) / 100, np.count_nonzero(word[1:] == word[:-1]) / n
    return out


def pooled(vectors: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """pool() of each text."""
    word, tail, doc = word_rows(buf, offs, vectors.shape[0])
    at = np.searchsorted(doc, np.arange(offs.size))
    return np.array([pool(vectors, word[i:j], tail[i:j]) for i, j in zip(at, at[1:])]).reshape(offs.size - 1, vectors.shape[1] + 4)


def random_index(buckets: int, dim: int, nonzero: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets, dim), np.float32)
    rows = np.arange(buckets)
    for _ in range(nonzero):
        out[rows, rng.integers(0, dim, buckets)] += rng.choice(np.array([-1, 1], np.float32), buckets)
    return out


def contexts(word: np.ndarray, doc: np.ndarray, index: np.ndarray, window: int, out: np.ndarray) -> None:
    """Add to out the index vectors met within window words of each word of one text (sums of whole numbers)."""
    for gap in range(1, window + 1):
        a, b = word[:-gap], word[gap:]
        same = doc[:-gap] == doc[gap:]
        a, b = a[same], b[same]
        for d in range(index.shape[1]):
            out[:, d] += np.bincount(a, index[b, d], out.shape[0]) + np.bincount(b, index[a, d], out.shape[0])


def word_vectors(index: np.ndarray, context: np.ndarray, nonzero: int) -> np.ndarray:
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return (index / np.sqrt(nonzero) + np.where(length > 0, context / np.maximum(length, 1e-9), 0)).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, *, hidden: int = 48, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Model:
    """Two layers by Adam on four fifths of the rows; the temperature on the rest."""
    model = Model(vectors, x.mean(0) if len(x) else np.zeros(x.shape[1]), (x.std(0) + 1e-6) if len(x) else np.ones(x.shape[1]))
    if len(np.unique(y)) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - model.mean) / model.scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        mixed = rng.permutation(fit)
        for at in range(0, len(mixed), 128):
            k = mixed[at : at + 128]
            h = np.tanh(z[k] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[k]) / len(k)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [z[k].T @ back + decay * p[0], back.sum(0), h.T @ err + decay * p[2], err.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.layers = p
    if len(held):
        logit, want = model.logit(x[held]), y[held]
        loss = lambda t: np.mean(np.logaddexp(0, -(2 * want - 1) * logit / t))
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def _context_sums(sample: DataFrame, buckets: int, dim: int, nonzero: int, window: int, seed: int) -> np.ndarray:
    """Context vectors summed in the workers, then by row: buckets * dim numbers reach the driver, whatever the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, out = random_index(buckets, dim, nonzero, seed), np.zeros((buckets, dim))
        for batch in batches:
            word = [np.frombuffer(w.as_py(), "<i4") for w in batch.column(0)]
            for at in range(0, len(word), 256):
                part = word[at : at + 256]
                contexts(np.concatenate(part), np.repeat(np.arange(len(part)), [w.size for w in part]), index, window, out)
            B.release()
        met = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(out[met, d]) for d in range(dim))], ["_row", *(f"_d{d}" for d in range(dim))])

    parts = sample.select("_word").mapInArrow(run, "_row long, " + ", ".join(f"_d{d} double" for d in range(dim)))
    out = np.zeros((buckets, dim))
    for row in parts.groupBy("_row").agg(*(F.sum(f"_d{d}") for d in range(dim))).collect():
        out[row[0]] = row[1:]
    return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 15, dim: int = 32, max_labelled: int = 12_000, nonzero: int = 4, window: int = 2, seed: int = 7, **network) -> Model:
    """labels: (id, label), only rows to learn from.  At most max_labelled documents are fitted on.

    Their words stay with the workers: the driver gets the summed context vectors and one pooled vector per document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wanted = labels.toDF("_id", "_y").filter("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").cast("int").alias("_y"))
    known = cut(docs.select(F.col(id_col).alias("_id")).distinct().join(wanted, "_id"), "known")
    chosen = cut(least_hashed(known, "_id", max_labelled), "labelled")
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # at most max_labelled rows of two numbers
    # one row per id: of a repeated one the text with the least hash, chosen where the rows lie before any moves
    rows = rows.groupBy("_id", "_y").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), F.length("_text"))).alias("_text")).select("_id", "_text", "_y")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in B.slices(batch, "_text"):
                word, tail, doc = word_rows(buf, offs, buckets)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                pick = lambda a: pa.array([a[i:j].astype("<i4").tobytes() for i, j in zip(at, at[1:])], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pick(word), pick(tail)], ["_id", "_y", "_word", "_tail"])

    kind = rows.schema["_id"].dataType.simpleString()
    coded = rows.mapInArrow(code, f"_id {kind}, _y int, _word binary, _tail binary")
    sample = cut(coded.repartition(SAMPLE_PARTS, F.xxhash64("_id", "_word")), "sample")  # a bounded number of documents, at rest in the shared folder
    index = random_index(buckets, dim, nonzero, seed)
    shared = spark.sparkContext.broadcast(word_vectors(index, _context_sums(sample, buckets, dim, nonzero, window, seed), nonzero))

    def pool_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [pool(shared.value, *(np.frombuffer(c[i].as_py(), "<i4") for c in batch.columns[2:])).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(got, pa.binary())], ["_id", "_y", "_x"])

    got = sample.mapInArrow(pool_words, f"_id {kind}, _y int, _x binary").collect()  # max_labelled rows of dim + 4 numbers
    got.sort(key=lambda r: (r[0], r[2]))
    x = np.frombuffer(b"".join(r[2] for r in got)).reshape(len(got), dim + 4)
    return train(x, np.array([r[1] for r in got], float), shared.value, **network)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str], score_col: str = "score") -> DataFrame:
    """The `keep` columns of docs and the score of each row's whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets * dim * 4 bytes, whatever the corpus
    text = unused(docs, "_scored_text")
    rows = docs.select(*(F.col(c) for c in keep), text_or_empty(text_col).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, buf, offs in B.slices(batch, text):
                got = own.score(pooled(own.vectors, buf, offs))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.float64())], [*keep, score_col])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}{', ' if keep else ''}`{score_col}` double")
