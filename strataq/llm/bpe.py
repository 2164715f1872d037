"""Byte-level BPE in padded numpy matrices.

Pieces (matches of the split pattern) are bucketed by length into padded id
matrices.  Each round, every row merges its leftmost pair of minimum rank: all
pair ranks come from one hashed table lookup, the row closes up over the merged
place, and finished rows leave the matrix.  In a very long piece a round merges
every place of the least rank that the rounds would merge in a row.  A piece that is itself a token is
that token at once, as the rank file's reference encoder does.  Tokens of
pieces met before are kept per worker, up to a bound after which the store
starts afresh; that bounds memory and changes no result.

Defined results: null texts are empty and have no ids; whole texts of any
length; repeated rows each get their result; an empty table gives none; extra
columns are ignored; a null id passes through.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import small_batches, text_or_empty

U = np.uint64
NONE = np.int32(2**31 - 1)
#: Pieces kept per worker before the store starts afresh.
KEPT_PIECES = 300_000
#: Bytes from which a piece is a matrix of its own, and a round merges all that it can.
LONG = 512


class PairTable:
    """Open addressing: key (left id, right id) -> merged id, which is its rank."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * keys.size + 1).bit_length() + 1)
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(U).max, U)
        self.values = np.full(1 << bits, NONE, np.int32)
        self.probes, left = 0, np.arange(keys.size)
        at = self._home(keys)
        while left.size:
            self.probes += 1
            free = self.values[at[left]] == NONE
            slot, first = np.unique(at[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[slot], self.values[slot] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where there is none (or an id is negative)."""
        keys = (left.astype(np.int64).astype(U) << U(32)) | right.astype(np.int64).astype(U)
        flat = keys.ravel()
        at = self._home(flat)
        out = np.full(flat.size, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        for _ in range(self.probes + 1):
            if not todo.size:
                break
            hit = self.keys[at[todo]] == flat[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (self.values[at[todo]] != NONE)]
            at[todo] = (at[todo] + 1) & self.mask
        return out.reshape(keys.shape)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, whole = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(rank)
        self.pairs = PairTable((np.array(left, U) << U(32)) | np.array(right, U), np.array(whole, np.int32))
        spell = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spell[rank] = token
        self.spelling = np.frombuffer(b"".join(spell), np.uint8)
        self.spell_at = np.concatenate([[0], np.cumsum([len(s) for s in spell])]).astype(np.int64)

    def merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """ids: one row per piece, padded with -1 on the right.  Returns each row's tokens."""
        out: list[np.ndarray | None] = [None] * ids.shape[0]
        row = np.arange(ids.shape[0])
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while row.size:
            best = rank.argmin(1) if rank.shape[1] else np.zeros(row.size, np.int64)  # leftmost of the least
            least = rank[np.arange(row.size), best] if rank.shape[1] else np.full(row.size, NONE)
            done = least == NONE
            for k in np.flatnonzero(done):
                out[row[k]] = ids[k][ids[k] >= 0]
            live = ~done
            row, ids, rank, best, least = row[live], ids[live], rank[live], best[live], least[live]
            if not row.size:
                break
            every, width = np.arange(row.size), ids.shape[1] - 1
            cols = np.arange(width)[None, :]
            ids[every, best] = least
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)  # close up over best + 1
            if width > 1:
                cols = cols[:, : width - 1]
                rank = np.take_along_axis(rank, cols + (cols >= best[:, None]), 1)  # drop the merged pair
                for side in (best - 1, best):  # the two pairs that changed
                    ok = (side >= 0) & (side < width - 1)
                    rank[every[ok], side[ok]] = self.pairs.get(ids[every[ok], side[ok]], ids[every[ok], side[ok] + 1])
            else:
                rank = rank[:, :0]
        return out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """merge_rows() of one long row, where a round takes all places of the least rank that come to be merged before anything else.

        From left to right, until a merge makes a pair of still lower rank, which has to go first.
        """
        rank = self.pairs.get(ids[:-1], ids[1:])
        while rank.size and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            new = np.append(True, np.diff(at) > 1)
            at = at[(np.arange(at.size) - np.maximum.accumulate(np.where(new, np.arange(at.size), 0))) % 2 == 0]  # of a run of overlapping pairs every second
            after_merge = np.append(False, np.diff(at) == 2)  # the place to the left has just been merged
            left = np.where(after_merge, least, ids[np.maximum(at - 1, 0)])
            left = np.where(at > 0, left, -1)
            right = np.where(at + 2 < ids.size, ids[np.minimum(at + 2, ids.size - 1)], -1)
            made = np.full(at.size, least, ids.dtype)
            lower = np.flatnonzero(np.minimum(self.pairs.get(left, made), self.pairs.get(made, right)) < least)
            if lower.size:
                at = at[: lower[0] + 1]
            ids[at] = least
            keep = np.ones(ids.size, bool)
            keep[at + 1] = False
            ids = ids[keep]
            keep = np.ones(rank.size, bool)
            keep[at] = False
            rank = rank[keep]
            now = at - np.arange(at.size)
            for side in (now - 1, now):  # the pairs that changed
                side = side[(side >= 0) & (side < rank.size)]
                rank[side] = self.pairs.get(ids[side], ids[side + 1])
        return ids

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None or not piece:
                out[i] = np.array([] if rank is None else [rank], np.int32)
            elif len(piece) > LONG:
                out[i] = self.merge_long(self.byte_id[np.frombuffer(piece, np.uint8)])
            else:
                buckets.setdefault(len(piece) if len(piece) <= 16 else 1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, (1 << 19) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                ids = np.full((len(part), max(len(pieces[i]) for i in part)), -1, np.int32)
                for r, i in enumerate(part):
                    ids[r, : len(pieces[i])] = self.byte_id[np.frombuffer(pieces[i], np.uint8)]
                for i, tokens in zip(part, self.merge_rows(ids)):
                    out[i] = tokens
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids spell."""
        start, size = self.spell_at[ids], self.spell_at[ids.astype(np.int64) + 1] - self.spell_at[ids]
        return self.spelling[_ranges(start, size)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if size.size else 0)


class Encoder:
    """A ByteBpe behind a split pattern, with a store of known pieces."""

    def __init__(self, bpe: ByteBpe, pattern: str):
        self.bpe, self.split = bpe, regex.compile(pattern).findall
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def learn(self, pieces: list[str]) -> None:
        if len(self.known) + len(pieces) > KEPT_PIECES and self.known:
            raise MemoryError
        for piece, got in zip(pieces, self.bpe.encode_pieces([p.encode() for p in pieces])):
            if self.used + got.size > self.tokens.size:
                self.tokens = np.concatenate([self.tokens, np.empty(max(self.tokens.size, got.size), np.int32)])
            code = len(self.known)
            if code == self.start.size:
                self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
            self.known[piece] = code
            self.tokens[self.used : self.used + got.size] = got
            self.start[code], self.size[code] = self.used, got.size
            self.used += got.size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        new = list(set().union(*map(set, split)).difference(self.known)) if split else []
        if new:
            try:
                self.learn(new)
            except MemoryError:
                self.reset()
                self.learn(list(set().union(*map(set, split))))
        out = []
        for pieces in split:
            code = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
            out.append(self.tokens[_ranges(self.start[code], self.size[code])])
        return out


@lru_cache(maxsize=2)
def load_encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary file (local to every machine, like the library that reads it)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return Encoder(ByteBpe(ranks), pattern)


def encode(docs: DataFrame, *, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array<int>)."""
    return _mapped(docs, vocabulary, pattern, id_col, text_col, "ids array<int>", lambda bpe, ids, text: (ids.tolist(),))


def decode(rows: DataFrame, *, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, bytes (binary) that the ids spell; a null array spells nothing."""
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_encoder(vocabulary, pattern).bpe
        for batch in batches:
            got = [bpe.decode(np.array(x.as_py(), np.int64)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], [id_col, "bytes"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, bytes binary")


def roundtrip_digests(docs: DataFrame, *, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (little-endian uint32), decoded_sha256 (the ids decoded again)."""

    def digest(bpe: ByteBpe, ids: np.ndarray, text: str) -> tuple:
        return ids.size, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).tobytes()).hexdigest()

    return _mapped(docs, vocabulary, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _mapped(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, columns: str, make) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(f"`{text_col}`").alias("_text"))
    kind = rows.schema["_id"].dataType
    schema = f"`{id_col}` {kind.simpleString()}, {columns}"
    fields = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    kinds = [(c.split()[0], fields[c.split()[1]]) for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_encoder(vocabulary, pattern)
        for batch in batches:
            for part, _, _ in B.slices(batch, "_text"):
                texts = part.column(1).to_pylist()
                made = [make(coder.bpe, ids, text) for ids, text in zip(coder.encode(texts), texts)]
                arrays = [pa.array(x, t) for x, (_, t) in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], [id_col, *(n for n, _ in kinds)])

    return rows.mapInArrow(run, schema)
