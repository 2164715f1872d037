"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids go together.

Tokenizer A is a byte-level BPE file of the `tokenizers` library, B a `sentencepiece`
model with byte fallback; A reads a space and the text, B the text (it adds the space
itself).  Both spell the same bytes, so each side is a byte-owner array: the token's
index repeated over its bytes.  Where the pair of owners changes from one byte to the
next, a new overlap begins; where both owners change at once, both tokenizers cut, and
the tokens between two such cuts form a group.  The two tokens that end at a cut are
linked.

Linked tokens end alike, so the shorter is a byte suffix of the longer.  The pairs of
ids that can ever be linked follow from the two vocabularies alone (a third of a
million for the files used here), whatever the corpus: a link is a number in that
table, corpus-wide counts are an array of its size, and that array is what tasks get
by broadcast.  Texts are tokenized once; the second pass reads the written links.
Each distinct stretch between spaces goes to the libraries once per worker, as both
cut there whatever stands around it.

Defined results: texts that are null or empty, or whose bytes either tokenizer does
not give back, have no tokens: counts of 0, no groups, and '' for the digest.  Texts
are never cut; strings of special tokens in them are ordinary text.  Repeated rows
and null ids are aligned and counted row by row; an empty table gives an empty
result; other columns are ignored and cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut, small_batches, text_or_empty


def _printable() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else the next one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ragged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat bytes, start and size of each part."""
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if size.size else 0)


class Spelling:
    """The bytes of every id of one vocabulary; an id that spells none has size 0."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.flat, self.start, self.size = _ragged(words)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_ranges(self.start[ids], self.size[ids])]


def _suffix_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Ascending keys (id of a << 32 | id of b) of all pairs of which one is a suffix of the other."""

    def by_word(words: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                out.setdefault(w, []).append(i)
        return out

    in_a, in_b, keys = by_word(a), by_word(b), set()
    for word, ids in in_a.items():
        keys.update(i << 32 | j for k in range(len(word)) for j in in_b.get(word[k:], ()) for i in ids)
    for word, ids in in_b.items():
        keys.update(i << 32 | j for k in range(len(word)) for i in in_a.get(word[k:], ()) for j in ids)
    return np.array(sorted(keys), np.int64)


def _replaced(ids: np.ndarray, n: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids with those of text k replaced by own."""
    at = int(n[:k].sum())
    out = n.copy()
    out[k] = own.size
    return np.concatenate([ids[:at], own, ids[at + n[k] :]]), out


@dataclass
class Aligned:
    """Tokens of a run of texts and how they meet; texts without tokens have none on either side."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    n_a: np.ndarray  # tokens of each text
    n_b: np.ndarray
    overlaps: np.ndarray  # rows (token of A, token of B), one per run of equal owner pairs
    group_a: np.ndarray  # group of each token
    group_b: np.ndarray
    links: np.ndarray  # rows (token of A, token of B) that end at one cut: one per group
    n_groups: np.ndarray  # of each text


class Segments:
    """Tokens of both libraries for stretches that neither tokenizes across, each distinct stretch once.

    A stretch begins at a text's own space, and at a space after anything but a space and before a character that
    is surely not white space.  There A's pattern starts a match, and no piece of B has a space after another character.
    """

    #: Stretches and bytes of them that a worker keeps.
    KEPT, KEPT_BYTES = 400_000, 16 << 20
    #: What may follow the space: ASCII signs, and first bytes of characters of which none is white space.
    FOLLOWS = np.array([0x21 <= b <= 0x7E or 0xC3 <= b <= 0xDF or 0xE4 <= b <= 0xF4 for b in range(256)])

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.spell = spellings(path_a, path_b)
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.weight = 0
        self.tokens = [np.empty(1 << 16, np.int32) for _ in "ab"]
        self.start, self.size = (np.empty((2, 1 << 12), np.int64) for _ in "ss")
        self.used = [0, 0]

    def library(self, spaced: list[str]) -> list[list[np.ndarray]]:
        """Both libraries' ids of texts that begin with their space."""
        a, b = self.a.encode_batch_fast(spaced, add_special_tokens=False), self.b.encode([t[1:] for t in spaced], num_threads=1)
        return [[np.array(e.ids, np.int32) for e in a], [np.array(x, np.int32) for x in b]]

    def _in_lines(self, words: list[bytes], line: int = 250) -> Iterator[tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]]:
        """Stretches and, for A and B, their ids with the number of each one's: many stretches go to the libraries as one text, where both cut between them."""
        joined = [w for w in words if len(w) > 1 and self.FOLLOWS[w[1]] and w[-1] > 0x20]
        rest = list(set(words).difference(joined))
        for group in [joined[i : i + line] for i in range(0, len(joined), line)] + [[w] for w in rest]:
            stop = np.cumsum([len(w) for w in group])
            got = [x[0] for x in self.library([b"".join(group).decode(errors="replace")])]
            ends = [np.cumsum(spelling.size[ids]) for spelling, ids in zip(self.spell, got)]
            at = [np.searchsorted(e, stop) for e in ends]
            if len(group) == 1:
                yield group, [(ids, np.array([ids.size])) for ids in got]
            elif all(e.size and e[-1] == stop[-1] and np.array_equal(e[i], stop) for e, i in zip(ends, at)):
                yield group, [(ids, np.diff(i + 1, prepend=0)) for ids, i in zip(got, at)]
            else:
                for w in group:
                    yield [w], [(x[0], np.array([x[0].size])) for x in self.library([w.decode(errors="replace")])]

    def learn(self, words: list[bytes]) -> None:
        for part, got in self._in_lines(words):
            code = len(self.known)
            while code + len(part) > self.start.shape[1]:
                self.start, self.size = (np.concatenate([x, np.empty_like(x)], 1) for x in (self.start, self.size))
            for side, (ids, size) in enumerate(got):
                while self.used[side] + ids.size > self.tokens[side].size:
                    self.tokens[side] = np.concatenate([self.tokens[side], np.empty_like(self.tokens[side])])
                self.tokens[side][self.used[side] : self.used[side] + ids.size] = ids
                self.start[side, code : code + len(part)] = self.used[side] + np.cumsum(size) - size
                self.size[side, code : code + len(part)] = size
                self.used[side] += ids.size
            self.known.update(zip(part, range(code, code + len(part))))
            self.weight += sum(map(len, part))

    def of(self, buf: np.ndarray, bound: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: ids of the texts [bound[i], bound[i + 1]) of a flat buffer, and how many each text has."""
        inner = np.flatnonzero((buf[1:-1] == 0x20) & (buf[:-2] != 0x20) & self.FOLLOWS[buf[2:]]) + 1
        start = np.union1d(inner, bound[:-1][np.diff(bound) > 0])
        end = np.append(start[1:], buf.size)
        _, first, which = np.unique(B.Prefix(buf).of(start, end), return_index=True, return_inverse=True)
        data = buf.tobytes()
        words = [data[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())]
        new = list({w for w in words if w not in self.known})
        if new:
            if self.known and (len(self.known) + len(new) > self.KEPT or self.weight + sum(map(len, new)) > self.KEPT_BYTES):
                self.reset()
                new = list(set(words))
            self.learn(new)
        code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[which]
        doc = np.searchsorted(bound, start, "right") - 1
        out = []
        for side in (0, 1):
            size = self.size[side, code]
            out.append((self.tokens[side][_ranges(self.start[side, code], size)], np.bincount(doc, size, bound.size - 1).astype(np.int64)))
        return out


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.segments = Segments(path_a, path_b)
        self.spell_a, self.spell_b = spellings(path_a, path_b)
        self.pairs = _suffix_pairs(self.spell_a.words, self.spell_b.words)
        self.digits = _ragged([str(i).encode() for i in range(max(self.spell_a.size.size, self.spell_b.size.size))])

    def align(self, buf: np.ndarray, offs: np.ndarray) -> Aligned:
        """Align the texts of a flat UTF-8 buffer."""
        full = np.diff(offs) > 0
        spaced = np.insert(buf, offs[:-1][full], 0x20)  # a space before each text that is not empty
        bound = np.concatenate([[0], np.cumsum(np.diff(offs) + full)])
        (ids_a, n_a), (ids_b, n_b) = self.segments.of(spaced, bound)
        good = full & self._spelt(self.spell_a, ids_a, n_a, spaced, bound) & self._spelt(self.spell_b, ids_b, n_b, spaced, bound)
        if (full & ~good).any():
            # the libraries have the last word on texts that do not come back from stretches
            for k in np.flatnonzero(full & ~good).tolist():
                text = spaced[bound[k] : bound[k + 1]]
                whole = [x[0] for x in self.segments.library([text.tobytes().decode(errors="replace")])]
                good[k] = all(np.array_equal(s.bytes_of(x), text) for s, x in zip((self.spell_a, self.spell_b), whole))
                if good[k]:
                    (ids_a, n_a), (ids_b, n_b) = (_replaced(ids, n, k, x) for (ids, n), x in zip(((ids_a, n_a), (ids_b, n_b)), whole))
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        return self._owners(ids_a.astype(np.int64), ids_b.astype(np.int64), n_a, n_b)

    @staticmethod
    def _spelt(spelling: Spelling, ids: np.ndarray, n: np.ndarray, want: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether each text's ids spell it."""
        ends = np.concatenate([[0], np.cumsum(spelling.size[ids])])[np.concatenate([[0], np.cumsum(n)])]
        got = spelling.bytes_of(ids)
        if np.array_equal(ends, bound):
            wrong = np.concatenate([[0], np.cumsum(got != want)])
            return np.diff(wrong[bound]) == 0
        return np.array([np.array_equal(got[i:j], want[s:t]) for i, j, s, t in zip(ends[:-1], ends[1:], bound[:-1], bound[1:])], bool)

    def _owners(self, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Aligned:
        size_a, size_b = self.spell_a.size[ids_a], self.spell_b.size[ids_b]
        owner_a = np.repeat(np.arange(ids_a.size, dtype=np.int32), size_a)
        owner_b = np.repeat(np.arange(ids_b.size, dtype=np.int32), size_b)
        step_a, step_b = np.diff(owner_a) != 0, np.diff(owner_b) != 0
        run = np.flatnonzero(np.concatenate([step_a | step_b, np.ones(min(1, owner_a.size), bool)]))  # last byte of each overlap
        last = np.flatnonzero(np.concatenate([step_a & step_b, np.ones(min(1, owner_a.size), bool)]))  # last byte of each group
        links = np.stack([owner_a[last], owner_b[last]], 1)
        group_a, group_b = (np.repeat(np.arange(last.size), np.diff(links[:, side], prepend=-1)) for side in (0, 1))
        # texts meet at cuts too, so a text's groups end with that of its last token
        n_groups = np.diff(np.concatenate([[0], group_a + 1])[np.cumsum(n_a)], prepend=0)
        return Aligned(ids_a, ids_b, n_a, n_b, np.stack([owner_a[run], owner_b[run]], 1), group_a, group_b, links, n_groups)

    def pair_numbers(self, got: Aligned) -> np.ndarray:
        """The place of each link's ids in the table of pairs."""
        keys = got.ids_a[got.links[:, 0]] << 32 | got.ids_b[got.links[:, 1]]
        at = np.searchsorted(self.pairs, keys)
        assert np.array_equal(self.pairs[np.minimum(at, self.pairs.size - 1)], keys), "linked tokens do not end alike"
        return at.astype(np.int32)

    def group_digests(self, got: Aligned) -> list[str]:
        """SHA-256 of each text's `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        total = got.ids_a.size + got.ids_b.size
        ids, sign = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ends_a, ends_b = got.links[:, 0] + 1, got.links[:, 1] + 1
        at_a = np.arange(got.ids_a.size) + np.concatenate([[0], ends_b])[got.group_a]  # after all tokens of earlier groups
        at_b = np.arange(got.ids_b.size) + ends_a[got.group_b]  # and after this group's tokens of A
        ids[at_a], ids[at_b] = got.ids_a, got.ids_b
        sign[at_a[got.links[:, 0]]], sign[at_b[got.links[:, 1]]] = ord("|"), ord(";")
        flat, start, size = self.digits
        size = size[ids]
        ends = np.cumsum(size + 1)
        out = np.empty(int(ends[-1]) if total else 0, np.uint8)
        place = np.ones(out.size, bool)
        place[ends - 1] = False
        out[place], out[ends - 1] = flat[_ranges(start[ids], size)], sign
        stop = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(got.n_a + got.n_b)])]
        view = memoryview(out)
        return [hashlib.sha256(view[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(stop[:-1].tolist(), stop[1:].tolist())]


@lru_cache(maxsize=2)
def spellings(path_a: str, path_b: str) -> tuple[Spelling, Spelling]:
    import sentencepiece

    with open(path_a, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    code = _printable()
    words = [b""] * (max(vocabulary.values()) + 1)
    for word, i in vocabulary.items():
        words[i] = bytes(code[c] for c in word) if all(c in code for c in word) else word.encode()
    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]
    return Spelling(words), Spelling(pieces)


@lru_cache(maxsize=2)
def load_aligner(path_a: str, path_b: str) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Aligner(path_a, path_b)


def _mapped(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, columns: dict[str, pa.DataType], schema: str, make) -> DataFrame:
    """make: (aligner, Aligned) -> the columns after the id."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load_aligner(path_a, path_b)
        for batch in batches:
            for part, buf, offs in B.slices(batch, "_text"):
                got = make(aligner, aligner.align(buf, offs))
                yield pa.RecordBatch.from_arrays([part.column(0), *(x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(got, columns.values()))], [id_col, *columns])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, {schema}")


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def align(docs: DataFrame, *, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id; ids_a, ids_b; group_a, group_b (group of each token, from 0); overlaps (token of A, token of B, in text order)."""
    ints = pa.list_(pa.int32())
    pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def make(_: Aligner, got: Aligned) -> list:
        first_a, first_b, first_g = (np.cumsum(n) - n for n in (got.n_a, got.n_b, got.n_groups))
        doc = np.searchsorted(np.cumsum(got.n_a), got.overlaps[:, 0], "right")
        own = pa.StructArray.from_arrays([pa.array((got.overlaps[:, i] - first[doc]).astype(np.int32)) for i, first in enumerate((first_a, first_b))], ["a", "b"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=got.n_a.size))]).astype(np.int32)
        group_a, group_b = got.group_a - np.repeat(first_g, got.n_a), got.group_b - np.repeat(first_g, got.n_b)
        return [
            _lists(got.ids_a.astype(np.int32), got.n_a), _lists(got.ids_b.astype(np.int32), got.n_b),
            _lists(group_a.astype(np.int32), got.n_a), _lists(group_b.astype(np.int32), got.n_b), pa.ListArray.from_arrays(pa.array(ends), own),
        ]

    columns = {"ids_a": ints, "ids_b": ints, "group_a": ints, "group_b": ints, "overlaps": pair}
    return _mapped(docs, path_a, path_b, id_col, text_col, columns, "ids_a array<int>, ids_b array<int>, group_a array<int>, group_b array<int>, overlaps array<struct<a:int,b:int>>", make)


def pair_counts(links: DataFrame, column: str, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each pair of the table is linked, and whether no pair with the same id of B is linked oftener."""
    found = links.select(F.explode(column).alias("_pair")).groupBy("_pair").agg(F.count(F.lit(1)).alias("_n")).toArrow()  # at most pairs.size rows
    counts = np.zeros(pairs.size, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    side = pairs & 0xFFFFFFFF
    most = np.zeros(int(side.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, side, counts)
    return counts, (counts > 0) & (counts == most[side])


def alignment_digests(docs: DataFrame, *, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    longs = ["n_a", "n_b", "n_groups", "n_links"]

    def make(aligner: Aligner, got: Aligned) -> list:
        numbers = _lists(aligner.pair_numbers(got), got.n_groups)  # one link per group: the tokens that end at its cut
        return [got.n_a, got.n_b, got.n_groups, got.n_groups, numbers, aligner.group_digests(got)]

    columns = dict.fromkeys(longs, pa.int64()) | {"links": pa.list_(pa.int32()), "groups_sha256": pa.string()}
    rows = cut(_mapped(docs, path_a, path_b, id_col, text_col, columns, "n_a long, n_b long, n_groups long, n_links long, links array<int>, groups_sha256 string", make), "aligned")
    table = docs.sparkSession.sparkContext.broadcast(pair_counts(rows, "links", _suffix_pairs(*(s.words for s in spellings(path_a, path_b)))))  # bounded by the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = table.value
        for batch in batches:
            links = batch.column(5)
            offs = links.offsets.to_numpy()
            numbers = links.values.to_numpy()[offs[0] : offs[-1]]
            ends = offs - offs[0]
            n_best, total = (np.diff(np.concatenate([[0], np.cumsum(x[numbers], dtype=np.int64)])[ends]) for x in (best, counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n_best), pa.array(total), batch.column(6)], [id_col, *longs, "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
