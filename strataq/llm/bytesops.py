"""Whole-batch numpy work on UTF-8 text: words, lines and rolling hashes.

A batch of texts is one flat byte buffer with offsets.  Every substring hash
comes from one prefix sum H over table[byte] * BASE**i (mod 2**64):
hash(i, j) = (H[j] - H[i]) * BASE**-i, so any window costs two gathers.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Texts are worked on in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept for the largest n seen."""
    have = _powers.get(base)
    if have is None or have.size < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        have = np.empty(size, U)
        have[0] = 1
        have[1:] = U(base & ((1 << 64) - 1))
        np.multiply.accumulate(have, out=have)
        _powers.clear() if size > 64 << 20 else None
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser; spreads all input bits over all output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Prefix:
    """Prefix hash of one buffer."""

    def __init__(self, buf: np.ndarray, salt: int = 0):
        n = buf.size
        self.h = np.zeros(n + 1, U)
        t = (mix(_TABLE + U(salt)) if salt else _TABLE)[buf]
        t *= powers(BASE, n)
        np.cumsum(t, out=self.h[1:])
        self.back = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each [start, end); equal bytes give equal values."""
        out = self.h[end] - self.h[start]
        out *= self.back[start]
        return mix(out + (end - start).astype(U))

    def windows(self, w: int) -> np.ndarray:
        """Hash of every w-byte window, unmixed."""
        out = self.h[w:] - self.h[:-w]
        out *= self.back[: out.size]
        return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def release() -> None:
    """Give memory that earlier batches took back to the system; workers share an executor's limit."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in row slices of about SLICE_BYTES of text, each with its flat text."""
    if batch.num_rows == 0:
        return
    column = batch.column(batch.schema.get_field_index(text))
    size = np.cumsum(np.diff(flat(column)[1]))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
        part = batch.slice(at, upto - at)
        yield part, *flat(part.column(part.schema.get_field_index(text)))
        at = upto
    release()


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def owner(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which text each byte position belongs to."""
    return np.searchsorted(offs, at, "right") - 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each maximal run without white space."""
    solid = np.zeros(buf.size + 2, np.int8)
    solid[1:-1] = ~_SPACE[buf]
    step = np.diff(solid)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < buf.size)]
    cuts = np.unique(cuts[(solid[cuts] == 1) & (solid[cuts + 1] == 1)])  # a word that runs into the next text
    if cuts.size:
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return start, end, owner(offs, start)


def ngrams(word: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First-word index and hash of every run of n words within one text."""
    if word.size < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    m = word.size - n + 1
    h = np.zeros(m, U)
    for k in range(n):
        h = (h + word[k : k + m]) * U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return at, mix(h[at])


def repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its text, is not the first there) for each row; rows in text order."""
    n = value.size
    if n == 0:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    many, later = np.zeros(n, bool), np.zeros(n, bool)
    later[order[1:]] = same  # the sort is stable: the first occurrence comes first
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later
