"""Best-fit packing by bin completion over the length histogram.

How well a packing does depends only on how many pieces have which length, and
there are at most `capacity` lengths, so the search runs on that histogram,
whatever the size of the corpus.  Bin completion: each bin is built around the
largest remaining length by an undominated filling of least waste, and repeated
as often as its lengths last, so there are few distinct bins.  The best-fit
packing is the first incumbent.  Where the better of the two does not reach the
lower bound, a depth-first search branches over the undominated fillings of each
bin, in order of waste, prunes what cannot waste less than the incumbent, and
packs every node's rest by best fit, so that the incumbent improves on the way.
The search is bounded in the steps of fillings it may take.
Sums that remaining lengths can reach are bit sets, so a branch whose least
possible waste is too large is never entered.

Pieces then find their places without meeting in one task: each knows its rank
among the pieces of its length within its partition, a prefix sum over
partitions makes that a global rank, and the bin table (bounded by the number
of lengths) turns ranks into sequence and offset.

Defined results: a null or empty text is the end id alone; longer documents are
cut every `capacity` ids; repeated rows and null ids are packed like others; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import logging
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut, small_batches, text_or_empty

#: Words whose ids a worker keeps, about 50 bytes each.
KEPT_WORDS = 500_000
#: One bin: (how many such bins, {length: pieces of it per bin}).
Bin = tuple[int, dict[int, int]]


# packing a histogram


def _best_fit(count: np.ndarray, fits: np.ndarray, room: int) -> dict[int, int]:
    """The largest length that fits, again and again."""
    used: dict[int, int] = {}
    while room > 0:
        s = int(fits[room])
        while s and used.get(s, 0) >= count[s]:
            s = int(fits[s - 1])
        if not s:
            break
        n = min(int(count[s]) - used.get(s, 0), room // s)
        used[s] = used.get(s, 0) + n
        room -= n * s
    return used


def reachable(lengths: list[int], count: np.ndarray, room: int) -> list[int]:
    """Bit sets: k has the sums up to room of pieces of the first k lengths."""
    mask, sums = (2 << room) - 1, 1
    out = [1]
    for s in lengths:
        left, step = min(int(count[s]), room // s), 1
        while left > 0:
            take = min(step, left)
            sums |= (sums << take * s) & mask
            left, step = left - take, 2 * step
        out.append(sums)
    return out


def _exact(lengths: list[int], sums: list[int], count: np.ndarray, total: int) -> dict[int, int]:
    """The filling of exactly total with the largest parts; total is reachable."""
    used: dict[int, int] = {}
    for k in range(len(lengths) - 1, -1, -1):
        s = lengths[k]
        n = min(int(count[s]), total // s)
        while n and not sums[k] >> (total - n * s) & 1:
            n -= 1
        if n or not sums[k] >> total & 1:
            used[s] = n
            total -= n * s
        if not total:
            break
    return used


def complete(count: np.ndarray, fits: np.ndarray, room: int) -> dict[int, int]:
    """{length: pieces}: a filling of room with the least possible waste, the best-fit one where that is perfect.

    count[s]: pieces of length s; fits[r]: the largest length <= r at hand, 0 for none.
    No filling dominates it: a larger part in place of another would waste less, and
    of equal waste the one with the largest parts is taken.
    """
    best = _best_fit(count, fits, room)
    if sum(s * n for s, n in best.items()) == room:
        return best
    lengths = [int(s) for s in np.flatnonzero(count[: room + 1])]
    sums = reachable(lengths, count, room)
    return _exact(lengths, sums, count, sums[-1].bit_length() - 1)


def dominated(use: dict[int, int], count: np.ndarray, fits: np.ndarray, waste: int) -> bool:
    """Another filling takes a piece more, a larger piece for one of these, or one piece for two of these."""
    spare = lambda s: count[s] > use.get(s, 0)
    between = lambda low, high: next((s for s in _down(fits, high, low) if spare(s)), 0)
    if waste and between(1, waste):
        return True
    parts = sorted(use)
    if waste and any(between(p + 1, p + waste) for p in parts):
        return True
    pairs = {p + q for i, p in enumerate(parts) for q in parts[i:] if p != q or use[p] > 1}
    return any(between(p, min(p + waste, fits.size - 1)) for p in pairs if p < fits.size)


def _down(fits: np.ndarray, high: int, low: int) -> Iterator[int]:
    s = int(fits[min(high, fits.size - 1)])
    while s >= low and s:
        yield s
        s = int(fits[s - 1])


class Work:
    """What a search may still do: a unit per step of a filling and per filling tested for dominance by another."""

    def __init__(self, units: int):
        self.left = units

    def spend(self, units: int = 1) -> bool:
        self.left -= units
        return self.left > 0


#: A test for dominance costs about so many steps.
TEST_UNITS = 20


def completions(count: np.ndarray, fits: np.ndarray, room: int, most_waste: int, work: Work) -> Iterator[dict[int, int]]:
    """Undominated fillings of room that waste at most most_waste, least waste first; a stack, no recursion.  Ends early where the work is spent."""
    lengths = [int(s) for s in np.flatnonzero(count[: room + 1])]
    sums = reachable(lengths, count, room)
    for waste in range(min(most_waste, room) + 1):
        if not sums[-1] >> (room - waste) & 1:
            continue
        stack = [(len(lengths), room - waste, ())]
        while stack:
            if not work.spend():
                return
            k, left, path = stack.pop()
            if not left:
                use = dict(path)
                work.spend(TEST_UNITS)
                if not dominated(use, count, fits, waste):
                    yield use
                continue
            s = lengths[k - 1]
            for n in range(min(int(count[s]), left // s) + 1):  # the most of the largest length is popped first
                if sums[k - 1] >> (left - n * s) & 1:
                    stack.append((k - 1, left - n * s, path + ((s, n),) if n else path))


def _fits(count: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(count > 0, np.arange(count.size), 0))


def _counts(histogram: dict[int, int], capacity: int) -> np.ndarray:
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    return count


def _take(count: np.ndarray, largest: int, filling: dict[int, int]) -> Bin:
    """The bin of largest and filling, as often as its lengths last; count loses its pieces."""
    use = dict(filling)
    use[largest] = use.get(largest, 0) + 1
    times = int(min(count[s] // k for s, k in use.items()))
    for s, k in use.items():
        count[s] -= times * k
    return times, use


def _fill(count: np.ndarray, capacity: int, choose) -> list[Bin]:
    """Every piece of count, the largest first; count is used up."""
    bins: list[Bin] = []
    while count.any():
        largest = int(np.flatnonzero(count)[-1])
        count[largest] -= 1
        got = choose(count, _fits(count), capacity - largest)
        count[largest] += 1
        bins.append(_take(count, largest, got))
    return bins


def least_bins(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound, the best of three kinds.

    Pieces over half a bin never share one, and what is left of their bins takes only so much.  At most k pieces over
    1 / (k + 1) of a bin share one: a piece counts for what a whole number of (k + 1)-ths of a bin says, divided by k, and
    by its own size where that is exact.  The total length needs room.
    """
    count = _counts(histogram, capacity)
    size = np.arange(capacity + 1)
    many, much = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    half = capacity // 2
    low = np.arange(half + 1)  # pieces shorter than this are left out of account
    alone = many[-1] - many[capacity - low + 1]
    n = many[capacity - low + 1] - many[half + 1]
    free = n * capacity - (much[capacity - low + 1] - much[half + 1])
    rest = much[half + 1] - much[low]
    best = max(int((alone + n + np.maximum(0, -(-(rest - free) // capacity))).max()), -(-int(much[-1]) // capacity))
    for k in range(1, 65):
        parts, over = np.divmod((k + 1) * size, capacity)
        # in units of 1 / (k * capacity) of a bin, so that the sum is exact
        worth = sum(int(c) * (int(s) * k if not o else int(p) * capacity) for s, c, p, o in zip(size[count > 0], count[count > 0], parts[count > 0], over[count > 0]))
        best = max(best, -(-worth // (k * capacity)))
    return best


def _bins(made: list[Bin] | tuple[Bin, ...]) -> int:
    return sum(times for times, _ in made)


def _branch(histogram: dict[int, int], capacity: int, best: list[Bin], least: int, work: Work) -> tuple[list[Bin], bool]:
    """The best packing the search meets, and whether it came to its end.

    On the way down every node's rest is packed by best fit, so the incumbent improves long before a leaf is reached.
    """
    total = sum(s * n for s, n in histogram.items())
    branches: list[Iterator] = []

    def fillings(count: np.ndarray, made: tuple, waste: int) -> Iterator[tuple]:
        largest = int(np.flatnonzero(count)[-1])
        rest = count.copy()
        rest[largest] -= 1
        allowed = (_bins(best) - 1) * capacity - total - waste
        for use in completions(rest, _fits(rest), capacity - largest, allowed, work):
            after = count.copy()
            times, whole = _take(after, largest, use)
            lost = waste + times * (capacity - sum(s * k for s, k in whole.items()))
            if lost <= (_bins(best) - 1) * capacity - total:
                yield after, made + ((times, whole),), lost

    branches.append(fillings(_counts(histogram, capacity), (), 0))
    while branches and work.left > 0 and _bins(best) > least:
        step = next(branches[-1], None)
        if step is None:
            branches.pop()
            continue
        count, made, waste = step
        if _bins(made) >= _bins(best):
            continue
        if not count.any():
            best = list(made)
            continue
        work.spend(4 * int(np.count_nonzero(count)))
        rest = _fill(count.copy(), capacity, _best_fit)
        if _bins(made) + _bins(rest) < _bins(best):
            best = [*made, *rest]
        branches.append(fillings(count, made, waste))
    return best, (not branches and work.left > 0) or _bins(best) == least


def pack(histogram: dict[int, int], capacity: int, work: int = 100_000) -> list[Bin]:
    """Bins for {length: pieces}; lengths are 1..capacity.

    work bounds the branching on the driver (steps and tests of fillings, a second or so), after which the incumbent stands
    and a warning says so: the problem is NP-hard, and every piece is packed either way.
    """
    least = least_bins(histogram, capacity)
    made = min((_fill(_counts(histogram, capacity), capacity, choose) for choose in (_best_fit, complete)), key=_bins)
    if _bins(made) > least:
        made, proved = _branch(histogram, capacity, made, least, Work(work))
        if not proved:
            logging.getLogger(__name__).warning("packing: %d bins, at least %d needed; the search ended after %d units of work", _bins(made), least, work)
    return made


class Places:
    """Rank of a piece among those of its length -> (sequence, offset)."""

    def __init__(self, bins: list[Bin]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for times, use in bins:
            offset = 0
            for length in sorted(use, reverse=True):
                rows.setdefault(length, []).append((taken.get(length, 0), use[length], sequence, offset))
                taken[length] = taken.get(length, 0) + times * use[length]
                offset += length * use[length]
            sequence += times
        self.rows = {s: np.array(r, np.int64) for s, r in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(length.size, np.int64), np.zeros(length.size, np.int64)
        for s in np.unique(length):
            own = np.flatnonzero(length == s)
            table = self.rows[int(s)]
            row = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
            j = rank[own] - row[:, 0]
            sequence[own], offset[own] = row[:, 2] + j // row[:, 1], row[:, 3] + j % row[:, 1] * s
        return sequence, offset


# tokens


class WordTokens:
    """Ids of texts by a `tokenizers` file whose pieces never cross ASCII white space.

    Words are found and fingerprinted (64 bits) by the batch; each distinct word is
    encoded by the library once, and a text is its words' ids.  A sign after an ASCII
    letter or digit starts a piece of its own, so a word with one at its end is the
    word's ids and the sign's.  Known words are sorted arrays; when they pass
    KEPT_WORDS the half not met for longest is given up, but no word of the slice in work.
    """

    SIGNS = (b",", b".")

    def __init__(self, path: str):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.keys, self.at, self.size, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens, self.used, self.turn = np.empty(1 << 20, "<u4"), 0, 0
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1 << 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.signs = dict(zip(self.SIGNS, self._each(list(self.SIGNS))))

    def _each(self, words: list[bytes]) -> list[bytes]:
        got = self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def _encode(self, words: list[bytes], line: int = 400) -> dict[bytes, bytes]:
        """Words of letters alone are one piece each, which ends in a word end: they are encoded by the line."""
        out: dict[bytes, bytes] = {}
        single, other = [], []
        for w in words:
            text = w.decode()
            (single if text.isalpha() and (text.isascii() or (text.lower().isalpha() and is_normalized("NFC", text))) else other).append(w)
        lines = [single[at : at + line] for at in range(0, len(single), line)]
        for part, got in zip(lines, self.library.encode_batch_fast([b" ".join(part).decode() for part in lines], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            stop = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if stop.size != len(part) or stop[-1] != 4 * ids.size:
                other += part
                continue
            data = ids.tobytes()
            out.update((w, data[i:j]) for w, i, j in zip(part, [0, *stop.tolist()], stop.tolist()))
        out.update(zip(other, self._each(other)))
        return out

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """keys ascending."""
        core = [w[:-1] if w[-1:] in self.signs and w[-2:-1].isalnum() else w for w in words]
        each, found = list(dict.fromkeys(core)), {}
        for at in range(0, len(each), 4000):  # the library's own results are large while they last
            found |= self._encode(each[at : at + 4000])
        ids = [found[c] + (self.signs[w[-1:]] if len(c) < len(w) else b"") for c, w in zip(core, words)]
        new = np.frombuffer(b"".join(ids), "<u4")
        size = np.array([len(i) // 4 for i in ids], np.int64)
        if self.keys.size + keys.size > KEPT_WORDS and self.keys.size:
            self._forget()
        if self.used + new.size > self.tokens.size:
            self.tokens = np.concatenate([self.tokens[: self.used], np.empty(max(self.tokens.size, new.size), "<u4")])
        self.tokens[self.used : self.used + new.size] = new
        place = np.searchsorted(self.keys, keys)
        self.at, self.size = np.insert(self.at, place, self.used + np.cumsum(size) - size), np.insert(self.size, place, size)
        self.met, self.keys = np.insert(self.met, place, self.turn), np.insert(self.keys, place, keys)
        self.used += new.size

    def _forget(self) -> None:
        # the words of the slice in work are about to be read, however many they are
        stay = np.flatnonzero((self.met > np.median(self.met)) | (self.met >= self.turn))
        kept = self.tokens[_ranges(self.at[stay], self.size[stay])]
        self.keys, self.size, self.met = self.keys[stay], self.size[stay], self.met[stay]
        self.at = np.cumsum(self.size) - self.size
        self.tokens[: kept.size], self.used = kept, kept.size

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, self.keys.size - 1))
        return at, (self.keys[at] == keys) if self.keys.size else np.zeros(keys.size, bool)

    def ids(self, buf: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Little-endian uint32 ids of each text of a flat buffer."""
        start, end, doc = B.words(buf, offs)
        keys, first, which = np.unique(B.Prefix(buf).of(start, end), return_index=True, return_inverse=True)
        self.turn += 1
        at, known = self._find(keys)
        self.met[at[known]] = self.turn
        if not known.all():
            data, new = buf.tobytes(), first[~known]
            self._learn(keys[~known], [data[i:j] for i, j in zip(start[new].tolist(), end[new].tolist())])
            at, known = self._find(keys)
            assert known.all(), "a word of this slice has no ids"
        at = at[which]
        size = self.size[at]
        data = self.tokens[_ranges(self.at[at], size)].tobytes()
        stop = 4 * np.concatenate([[0], np.cumsum(size)])[np.searchsorted(doc, np.arange(offs.size))]
        return [data[i:j] for i, j in zip(stop.tolist(), stop[1:].tolist())]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if size.size else 0)


@lru_cache(maxsize=2)
def load_tokens(path: str) -> WordTokens:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return WordTokens(path)


def pieces(docs: DataFrame, *, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and _pid, _rank: which of its length it is in its partition."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pid = load_tokens(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for part, buf, offs in B.slices(batch, "_text"):
                out = []
                for row, ids in enumerate(coder.ids(buf, offs)):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        one = ids[k : k + 4 * capacity]
                        n = len(one) // 4
                        out.append((row, k // (4 * capacity), k // 4, n, zlib.crc32(one), pid, seen.get(n, 0)))
                        seen[n] = seen.get(n, 0) + 1
                a = np.array(out, np.int64).reshape(-1, 7)
                columns = [part.column(0).take(pa.array(a[:, 0])), pa.array(a[:, 1].astype(np.int32)), *(pa.array(a[:, i]) for i in range(2, 7))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32", "_pid", "_rank"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, _pid long, _rank long")


def best_fit_packing(docs: DataFrame, *, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cutup = cut(pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    counts = cut(cutup.groupBy("_pid", "length").agg(F.count(F.lit(1)).alias("_n")), "counts")  # partitions * lengths rows at most
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(Places(pack(histogram, capacity)))  # bounded by the number of lengths
    before = Window.partitionBy("length").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(counts.select("_pid", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "base")
    ranked = cutup.join(base, ["_pid", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_rank")).alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.of(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"`{id_col}` {ranked.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
