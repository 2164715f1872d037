"""Jaccard self-join on word n-grams: a size-aware heavy-light join.

Texts with equal n-gram sets are one class from the start.  Sets below a size
boundary are light: each enumerates its subsets of the sizes that an
intersection with a partner can have (all but two elements at least), and two
sets that enumerate the same subset are linked, without looking at them again.  Larger sets are heavy: they
enter inverted lists under the first of their n-grams in a fixed order, enough
of them that linked sets meet in at least `share` lists; sets with fewer
shared lists are out, the others scan the lists.  The boundary is the one of
least cost: how many subsets the sets of each size have against how long the
lists are that they would enter, both counted in the corpus first.

Scanning a list never emits its pairs.  Every member is first held against the
pivot of its lists (the class of most lists), linked members become one
component, and lists within one component are finished.  Members of what is
left carry their size, component and a parity sketch of their set, whose bits
differ in no more places than the sets do; a list is tested where it lies, and
only pairs whose sketches allow a link leave it for the exact test.  A list too
long for one task is not tested by pairs at all: members x, y that stay apart
from its pivot p can only be linked if their differences to p overlap,
x ^ y = (x ^ p) ^ (y ^ p); those small difference sets are joined under a
prefix of their rarest elements, and exact checks follow.  Both ways are exact;
nothing is capped.

Defined results: null or empty texts, or texts without words, have an empty set
and link with nothing; a text with fewer words than n has its whole word
sequence as the one n-gram; repeated rows are equal sets; a null id sorts last
and a component of null ids alone is null.  N-grams are compared by 64-bit
fingerprints, classes by 64 bits.  An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .bloom import maybe_in
from .common import cut, discard, small_batches, text_or_empty, tidy, whole_row

U = np.uint64
#: Light sets lose at most so many elements: with three, their subsets are too many for any lists.
MOST_REMOVED = 2
#: Costs, in tests of a pair where it lies: a subset moves once, an entry when lists are counted, met, trimmed and opened.
SUBSET_COST, ENTRY_COST = 50, 200
#: Open members of a list that one task tests in place; longer lists go by differences to a pivot, with the same answers.
SCAN = 256
#: Bits of a parity sketch: the power of two from so many times the most elements in which linked sets differ.
SKETCH, LEAST_BITS, MOST_BITS = 16, 128, 16384
#: Rows of a group of differences that one task holds against as many others; larger groups are dealt in pairs of blocks.
BLOCK = 2048


class Threshold:
    """Jaccard of at least num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def missing(self, size: int) -> int:
        """Most elements of a set that a linked set may lack."""
        return size - -(-self.num * size // self.den)

    def prefix(self, size: int) -> int:
        return self.missing(size) + 1

    def share(self, size: int) -> int:
        """Lists that linked sets share at least, with prefixes longer by share - 1."""
        return max(1, min(-(-size // 10), size - self.prefix(size) + 1))

    def need(self, size: int) -> int:
        """Lists shared at least with any linked set, which may be smaller and listed less."""
        return self.share(-(-self.num * size // self.den))

    def removable(self, size: int) -> int:
        """Most elements to remove from a light set for an intersection."""
        a = 0
        while a + 1 < size and self.den * (size - a - 1) >= self.num * size:
            a += 1
        return a

    def subsets(self, size: int) -> int:
        return sum(comb(size, a) for a in range(self.removable(size) + 1))

    def entries(self, size: int) -> int:
        """Lists that a heavy set enters."""
        return self.prefix(size) + self.share(size) - 1

    def most_light(self) -> int:
        """Largest size that may be light."""
        s = 1
        while self.removable(s + 1) <= MOST_REMOVED:
            s += 1
        return s

    def boundary(self, scans: dict[int, tuple[int, int, int]]) -> int:
        """Sets smaller than this are light: the cheapest over what sets of each size would do.

        scans: size -> (sets, entries in lists, tests against other members of those lists), as counted in the corpus.
        Lists grow with what the corpus repeats, subsets do not, so the boundary rises where n-grams are common.
        """
        top = self.most_light()
        light = lambda s: SUBSET_COST * scans[s][0] * self.subsets(s)
        heavy = lambda s: ENTRY_COST * scans[s][1] + scans[s][2]
        sizes = [s for s in scans if 0 < s <= top]
        cost = lambda b: sum(light(s) if s < b else heavy(s) for s in sizes)
        return min(range(1, top + 2), key=lambda b: (cost(b), b))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Most elements in which linked sets of these sizes differ."""
        both, whole = x + y, self.num + self.den
        return both - 2 * ((self.num * both + whole - 1) // whole)


def shingles(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of each distinct n-gram of each text, sorted by both."""
    start, end, doc = B.words(buf, offs)
    word = B.Prefix(B.lowered(buf)).of(start, end)
    at, gram = B.ngrams(word, doc, n)
    owner = doc[at]
    few = np.flatnonzero((np.bincount(doc, minlength=offs.size - 1) < n) & (np.bincount(doc, minlength=offs.size - 1) > 0)) if doc.size else []
    for d in few:
        i, j = np.searchsorted(doc, [d, d + 1])
        h = U(j - i)
        for w in word[i:j]:
            h = B.mix(np.array([h ^ w]))[0] ^ w
        owner, gram = np.append(owner, d), np.append(gram, h)
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(gram.size, bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], gram[new]


def _subsets(grams: np.ndarray, limit: Threshold) -> tuple[list[int], list[int]]:
    """(fingerprint, elements removed) of every subset that an intersection with a linked set can be."""
    marks = B.mix(grams ^ U(0xA5A5A5A5))
    total = marks.sum(dtype=U)
    h, a = [], []
    for gone in range(limit.removable(grams.size) + 1):
        size = grams.size - gone
        if gone == 0:
            left = np.array([total])
        else:
            left = total - np.array([marks[list(c)].sum(dtype=U) for c in combinations(range(grams.size), gone)], U)
        h += (B.mix(left) ^ B.mix(np.array([size], U))).view(np.int64).tolist()
        a += [gone] * left.size
    return h, a


def parity_sketches(doc: np.ndarray, gram: np.ndarray, size: np.ndarray, limit: Threshold) -> list[bytes]:
    """Per set: bit h mod width is the parity of its elements hashed there, so two sketches differ in at most as many bits as the sets in elements."""
    want = np.clip(SKETCH * np.maximum(limit.apart(size, size), 1), LEAST_BITS, MOST_BITS)
    width = 1 << np.ceil(np.log2(want)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(width)])
    bit = base[doc] + (B.mix(gram ^ U(0x3C6EF372)).view(np.int64) & (width[doc] - 1))
    flat = np.packbits((np.bincount(bit, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [flat[i:j] for i, j in zip((base // 8).tolist(), (base[1:] // 8).tolist())]


def within(i: np.ndarray, j: np.ndarray, size: np.ndarray, words: np.ndarray, start: np.ndarray, limit: Threshold) -> np.ndarray:
    """For pairs (i, j) of sets, in how many bits their sketches differ; -1 where sizes or sketches rule out a link.  Sketch k is words[start[k]:start[k + 1]]."""
    sx, sy = size[i], size[j]
    far, out = np.full(i.size, -1), limit.den * np.minimum(sx, sy) >= limit.num * np.maximum(sx, sy)
    width = np.diff(start)
    for a, b in {(int(u), int(v)) for u, v in zip(width[i[out]], width[j[out]])} if out.any() else ():
        own, least = np.flatnonzero(out & (width[i] == a) & (width[j] == b)), min(a, b)
        for at in range(0, own.size, max(1, (1 << 18) // max(a, b))):
            k = own[at : at + max(1, (1 << 18) // max(a, b))]
            # a wide sketch folds into a narrow one: its bits' places modulo the narrow width
            left, right = (np.bitwise_xor.reduce(words[start[m][:, None] + np.arange(w)].reshape(k.size, w // least, least), axis=1) for m, w in ((i[k], a), (j[k], b)))
            bits = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
            far[k] = np.where(bits <= limit.apart(size[i[k]], size[j[k]]), bits, -1)
    return far


def _entries(rows: DataFrame, n: int, limit: Threshold) -> DataFrame:
    """_id, _h (text hash), _size, _c (class), _lists (n-grams it is listed under), _small (the whole set where it may be light), _sk (sketch)."""
    top = limit.most_light()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in B.slices(batch, "_text"):
                doc, gram = shingles(buf, offs, n)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                size = np.diff(at)
                marks = B.mix(gram + U(0x51ED270B))
                total = np.concatenate([[U(0)], np.cumsum(marks, dtype=U)])
                cls = B.mix((total[at[1:]] - total[at[:-1]]) ^ B.mix(size.astype(U)))
                lists, small = [], []
                for i, j in zip(at, at[1:]):
                    s = int(j - i)
                    own = gram[i:j].view(np.int64)  # ascending fingerprints: the fixed order
                    lists.append(own[: limit.entries(s)].tolist() if s else [])
                    small.append(own.tolist() if s <= top else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size.astype(np.int64)), pa.array(cls.view(np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int64())), pa.array(parity_sketches(doc, gram, size, limit), pa.binary())],
                    ["_id", "_h", "_size", "_c", "_lists", "_small", "_sk"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, _h long, _size long, _c long, _lists array<long>, _small array<long>, _sk binary")


def _scans(entries: DataFrame, limit: Threshold) -> dict[int, tuple[int, int, int]]:
    """What Threshold.boundary() asks for: of each size that may be light, its classes, their entries, and the other members of their lists (of longer ones SCAN, as these are not tested by pairs).

    Only classes within a link's reach of such sizes are counted, for no other shares a list with them to any purpose.
    """
    top = limit.most_light()
    near = entries.filter(f"_size > 0 and {limit.num} * _size <= {limit.den * top}").groupBy("_c").agg(F.first("_size").alias("_size"), F.first("_lists").alias("_lists"))
    each = cut(near.select("_size", F.explode("_lists").alias("_t"), F.lit(1).alias("_one")), "scans")
    members = each.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    met = each.filter(f"_size <= {top}").join(members, "_t").groupBy("_size").agg(F.count(F.lit(1)).alias("_entries"), F.sum(F.least(F.col("_n") - 1, F.lit(SCAN))).alias("_others"))
    return {r[0]: (r[1] // limit.entries(r[0]), r[1], r[2]) for r in met.collect()}  # at most `top` rows


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """_id, _c, _size, _set (sorted fingerprints as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in B.slices(batch, "_text"):
                doc, gram = shingles(buf, offs, n)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                total = np.concatenate([[U(0)], np.cumsum(B.mix(gram + U(0x51ED270B)), dtype=U)])
                cls = B.mix((total[at[1:]] - total[at[:-1]]) ^ B.mix(np.diff(at).astype(U)))
                sets = [gram[i:j].tobytes() for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), pa.array(np.diff(at).astype(np.int64)), pa.array(sets, pa.binary())], ["_c", "_size", "_set"])

    return rows.mapInArrow(run, "_c long, _size long, _set binary")


def _verified(pairs: DataFrame, sets: DataFrame, limit: Threshold, differences: bool) -> DataFrame:
    """x, y, sx, sy, linked, and if asked for what x has more and less than y.  pairs: x, y distinct."""
    left = sets.select(F.col("_c").alias("x"), F.col("_size").alias("sx"), F.col("_set").alias("_sx"))
    right = sets.select(F.col("_c").alias("y"), F.col("_size").alias("sy"), F.col("_set").alias("_sy"))
    met = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "sx", "sy", "_sx", "_sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, more, less = [], [], []
            for a, b in zip(batch.column(4), batch.column(5)):
                a, b = np.frombuffer(a.as_py(), U), np.frombuffer(b.as_py(), U)
                common = np.intersect1d(a, b, assume_unique=True).size
                linked.append(limit.den * common >= limit.num * (a.size + b.size - common))
                for out, (u, w) in ((more, (a, b)), (less, (b, a))):
                    out.append(np.setdiff1d(u, w, assume_unique=True).view(np.int64).tolist() if differences else [])
            B.release()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(linked, pa.bool_()), *(pa.array(d, pa.list_(pa.int64())) for d in (more, less))], ["x", "y", "sx", "sy", "linked", "more", "less"])

    small_batches(pairs.sparkSession, 256)
    return met.mapInArrow(run, "x long, y long, sx long, sy long, linked boolean, more array<long>, less array<long>")


def components(edges: DataFrame) -> DataFrame:
    """v, label (least vertex reachable) of every vertex of edges (x, y): least neighbours and pointer jumping."""
    both = cut(edges.select("x", "y").unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "y"), "y").groupBy(F.col("x").alias("v")).agg(F.min("label").alias("_near"))
        less = cut(labels.join(near, "v").select("v", F.least("label", "_near").alias("label"), F.col("label").alias("_old")), "near")
        jump = less.select(F.col("v").alias("label"), F.col("label").alias("_far"))
        labels = cut(less.join(jump, "label").select("v", F.col("_far").alias("label"), (F.col("_far") != F.col("_old")).alias("_moved")), "labels")
        moved = labels.filter("_moved").isEmpty()
        labels = labels.select("v", "label")
        if moved:
            return labels


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("v", "_c"), "_c", "left").withColumn("label", F.coalesce("label", "_c"))


def _open_lists(members: DataFrame, labels: DataFrame) -> DataFrame:
    """_t, _c, _d, label, _n (members) of lists that hold more than one component."""
    now = cut(_labelled(members, labels), "labelled")
    apart = cut(now.groupBy("_t").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_n")).filter("_lo <> _hi").select("_t", "_n"), "apart")
    return cut(now.join(apart, "_t").select("_t", "_c", "_d", "label", "_n"), "open")


def _scanned(rows: DataFrame, sketches: DataFrame, limit: Threshold, closest: bool = False) -> DataFrame:
    """x > y of different components that meet in a group and whose sizes and sketches allow a link.

    rows: _t (group), _c, label, and what restricts pairs beyond that: _asks and _answers
    (a pair needs one of each), _i, _most (their places sum to at most _most of the one that
    asks), _block, _same (blocks that meet, or one by itself).  Each group is tested where it lies.
    closest: of each row's pairs in a group only the one with least distance.
    """

    def pairs(part: pa.Table) -> Iterator[pa.RecordBatch]:
        t, c, label, asks, answers, place, most, block, same, size = (part.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(10))
        buf, offs = B.flat(part.column(10))
        words = np.frombuffer(buf.tobytes(), U)
        last = np.append(np.flatnonzero(t[1:] != t[:-1]), t.size - 1)
        after = last[np.searchsorted(last, np.arange(t.size))] - np.arange(t.size)  # rows behind each in its group
        total = np.cumsum(after)
        at = 0
        while at < t.size:
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 19), "right")))
            i = np.repeat(np.arange(at, upto), after[at:upto])
            j = i + 1 + np.arange(i.size) - np.repeat(np.cumsum(after[at:upto]) - after[at:upto], after[at:upto])
            ok = (label[i] != label[j]) & (same[i] | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            both = place[i] + place[j]
            ok = (asks[i] & answers[j] & (both <= most[i])) | (asks[j] & answers[i] & (both <= most[j]))
            i, j = i[ok], j[ok]
            far = within(i, j, size, words, offs // 8, limit)
            ok = np.flatnonzero(far >= 0)
            if closest:
                first = [ok[order[np.unique(side[ok][order], return_index=True)[1]]] for side in (i, j) for order in [np.lexsort((far[ok], side[ok]))]]
                ok = np.unique(np.concatenate(first))
            x, y = np.maximum(c[i[ok]], c[j[ok]]), np.minimum(c[i[ok]], c[j[ok]])
            both = np.unique(np.stack([x, y], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["x", "y"])
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            t = held.column(0).to_numpy()
            change = np.flatnonzero(t[1:] != t[:-1])
            if change.size:  # the last group may go on in the next batch
                done, held = held.slice(0, int(change[-1]) + 1), held.slice(int(change[-1]) + 1)
                yield from pairs(done)
            B.release()
        if held is not None and held.num_rows:
            yield from pairs(held)

    small_batches(rows.sparkSession, 4096)
    each = rows.join(sketches, "_c").select("_t", "_c", "label", "_asks", "_answers", "_i", "_most", "_block", "_same", "_size", "_sk")
    return each.repartition("_t").sortWithinPartitions("_t").mapInArrow(run, "x long, y long").distinct()


def _whole_lists(lists: DataFrame) -> DataFrame:
    """Rows for _scanned(): every two members of a list may be a pair."""
    yes, none = F.lit(True), F.lit(0).cast("long")
    return lists.select("_t", "_c", "label", yes.alias("_asks"), yes.alias("_answers"), none.alias("_i"), none.alias("_most"), none.alias("_block"), yes.alias("_same"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows with _t, _block and _same such that no group is larger than two blocks and any two rows of a group of rows meet once."""
    sizes = cut(rows.groupBy("_t").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks")), "sizes")
    own = rows.join(sizes, "_t").withColumn("_block", F.pmod(F.xxhash64("_c"), "_blocks"))
    with_ = own.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    key = F.xxhash64("_t", F.least("_block", "_with"), F.greatest("_block", "_with"))
    return with_.withColumn("_same", F.col("_block") == F.col("_with")).withColumn("_t", F.when(F.col("_blocks") > 1, key).otherwise(F.col("_t"))).drop("_blocks", "_with")


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.filter("linked").select("x", "y")


def _near_pivots(long: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Every member of a long list against the list's pivot: _verified() with differences."""
    pivots = cut(_pivots(long), "pivots")
    pairs = cut(long.join(pivots, "_t").filter("_c <> _p._c").select(F.col("_c").alias("x"), F.col("_p._c").alias("y")).distinct(), "to_pivots")
    return cut(_verified(pairs, sets, limit, True), "differences")


def _crossed(near: DataFrame, labels: DataFrame, limit: Threshold) -> DataFrame:
    """Rows for _scanned() in which members of long lists meet that may be linked, by their differences to the lists' pivots."""
    near = cut(_labelled(near.withColumnRenamed("x", "_c"), labels), "apart")
    open_ = near.groupBy("y").agg(F.max(~F.col("linked")).alias("_any")).filter("_any").select("y")  # pivots to which all are linked are done
    rows = near.join(open_, "y", "left_semi").select("_c", F.col("y").alias("p"), "label", "linked", "sx", "sy", (F.size("more") + F.size("less")).alias("d"), F.explode_outer("more").alias("token"))
    # one order for all differences to a pivot: what the pivot lacks by rarity, then what only it has
    # combined before they move, so that a token of a large group meets in no one task
    common = rows.filter("token is not null").groupBy("p", "token").agg(F.count(F.lit(1)).alias("df"), ((F.min("label") != F.max("label")) & F.max(~F.col("linked"))).alias("_meets")).filter("df > 1")
    rows = cut(rows, "different").join(cut(common, "common"), ["p", "token"], "left").withColumns({"df": F.coalesce("df", F.lit(1)), "_meets": F.coalesce("_meets", F.lit(False))})
    # A linked pair differs in H elements at most, so their differences to p overlap in all but H of either;
    # and with x not linked to p, in half of y's: so much of the rarest elements is enough to meet.
    part, whole = limit.den - limit.num, limit.den + limit.num
    most = F.expr(f"((sx + sx * {limit.den} div {limit.num}) * {part}) div {whole}")
    gap = F.floor(F.greatest(F.lit(0), F.col("sx") - F.col("sy")) * part / whole)
    half = F.col("d") - F.greatest(F.lit(1), F.ceil((F.col("d") - gap - 1) / 2)) + 1
    rare = rows.groupBy("_c", "p").agg(
        F.first("label").alias("label"), F.first("linked").alias("linked"), F.first("sx").alias("_n"), F.first(most).alias("_most"), F.first(half).alias("_half"),
        F.filter(F.sort_array(F.collect_list(F.struct("df", "token", "_meets"))), lambda t: t["token"].isNotNull()).alias("_more"),
    )  # fmt: skip  one row's own difference set
    rare = rare.join(near.select("_c", F.col("y").alias("p"), F.col("less").alias("_less")), ["_c", "p"])
    take = F.when(F.col("linked"), F.least(F.col("_half"), F.col("_most") + 1)).otherwise(F.col("_most") + 1).cast("int")
    tokens = F.concat(F.transform("_more", lambda t: F.struct(t["token"].alias("token"), t["_meets"].alias("_meets"))), F.transform("_less", lambda t: F.struct(t.alias("token"), F.lit(True).alias("_meets"))))
    met = F.filter(F.transform(F.slice(tokens, F.lit(1), take), lambda t, i: F.struct(i.alias("i"), t["token"].alias("token"), t["_meets"].alias("meets"))), lambda t: t["meets"])
    each = cut(rare.select("p", "_c", "label", "linked", "_n", "_most", "_half", F.explode(met).alias("_m")).select("p", "_c", "label", "linked", "_n", "_most", "_half", "_m.i", "_m.token"), "prefixes")
    # all before the first common element differ, and sizes lie within a link's reach: tested where the tokens meet
    met = each.select(F.xxhash64("p", "token").alias("_t"), "_c", "label", (~F.col("linked")).alias("_asks"), (F.col("i") < F.col("_half")).alias("_answers"), F.col("i").cast("long").alias("_i"), F.col("_most").cast("long").alias("_most"))
    return cut(_in_blocks(met), "blocks")


def _pivots(members: DataFrame) -> DataFrame:
    """_t, _p: each list's member of most lists, (_d, _c); so few pivots serve a group of near copies."""
    return members.groupBy("_t").agg(F.min(F.struct("_d", "_c")).alias("_p"))


def jaccard_components(docs: DataFrame, *, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _id, _h, _row, n_shingles, component (least id reachable), first (this row is the one of its component that stays).

    num / den: the least Jaccard similarity of a link.
    """
    limit = Threshold(num, den)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_h"), text_or_empty(text_col).alias("_text"))
    entries = cut(_entries(rows, n, limit).withColumn("_row", F.monotonically_increasing_id()), "entries")
    bound = limit.boundary(_scans(entries, limit))
    edges = _light_edges(entries.filter(f"_size between 1 and {bound - 1}"), limit)
    heavy = entries.filter(f"{den} * _size >= {num * bound}")  # also light sets that can link with heavy ones
    listed = heavy.select(F.explode("_lists").alias("_t"), "_c")
    shared = cut(listed.groupBy("_t").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).filter("_lo <> _hi").select("_t"), "shared")
    perhaps = maybe_in(listed, F.col("_t"), shared, k=1).filter("_maybe").select("_t", "_c")  # entries of lists of one, most of all, do not move again
    met = cut(perhaps.join(shared, "_t").groupBy("_t", "_c").agg(F.lit(1).alias("_one")).select("_t", "_c"), "met")
    classes = heavy.groupBy("_c").agg(F.first("_size").alias("_size"), F.min(F.struct("_id", "_h")).alias("_of"))
    enough = met.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).join(classes, "_c").filter(F.col("_n") >= _need(limit, "_size"))
    enough = cut(enough.select("_c", "_size", "_of"), "enough")
    some = cut(met.join(enough.select("_c", "_size"), "_c"), "some")
    discard(shared, met)
    tidy(docs.sparkSession)
    rarest = _rarest(some, limit)
    degree = rarest.groupBy("_c").agg((-F.count(F.lit(1))).alias("_d"))
    members = listed = cut(rarest.join(degree, "_c"), "listed")
    lists = members.groupBy("_t").agg(F.min(F.struct("_d", "_c")).alias("_p"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).filter("_lo <> _hi").select("_t", "_p")
    members = cut(members.join(cut(lists, "lists"), "_t").select("_t", "_c", "_d", "_p"), "members")
    discard(some, rarest, listed)
    needed = cut(members.select("_c").distinct().join(enough, "_c"), "needed")
    sketches = cut(heavy.select("_c", "_sk").join(needed.select("_c", "_size"), "_c").groupBy("_c").agg(F.first("_size").alias("_size"), F.first("_sk").alias("_sk")), "sketches")
    # each class against the first of its pivots
    pairs = cut(members.filter("_c <> _p._c").groupBy(F.col("_c").alias("x")).agg(F.min("_p").alias("_p")).select("x", F.col("_p._c").alias("y")), "pairs")
    hopeful = _plausible(pairs, sketches, limit)
    sets = _fetch_sets(rows, needed, n)
    edges = cut(edges.unionAll(_links(_verified(hopeful, sets, limit, False))), "links")
    labels = components(edges)
    open_ = _open_lists(members, labels)
    discard(members)
    tidy(docs.sparkSession)
    tested = pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    rows, long = _whole_lists(open_.filter(F.col("_n") <= SCAN)), open_.filter(F.col("_n") > SCAN)
    if not long.isEmpty():
        near = _near_pivots(long, sets, limit)
        labels = _joined(labels, _links(near))
        crossed = _crossed(near, labels, limit)
        # first each member's closest, which makes most components one; then, below, every pair still apart
        found = cut(_scanned(crossed, sketches, limit, closest=True).join(tested, ["x", "y"], "left_anti"), "closest")
        labels = _joined(labels, cut(_links(_verified(found, sets, limit, False)), "more"))
        tested = tested.unionAll(found)
        rows = _labelled(rows.unionByName(crossed).drop("label"), labels)
    found = cut(_scanned(rows, sketches, limit).join(tested, ["x", "y"], "left_anti"), "scanned")
    labels = _joined(labels, cut(_links(_verified(found, sets, limit, False)), "more"))
    discard(open_, sets, sketches)
    tidy(docs.sparkSession)
    return _named(entries, labels)


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels after more links: only the components that these connect are looked at again."""
    if more.isEmpty():
        return labels
    side = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"_{c}"))
    edges = more.select("x", "y").join(side("x"), "x", "left").join(side("y"), "y", "left").select(F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"))
    new = components(edges.filter("x <> y"))
    old = labels.join(new.select(F.col("v").alias("label"), F.col("label").alias("_new")), "label", "left").select("v", F.coalesce("_new", "label").alias("label"))
    return cut(old.unionAll(new.join(labels, "v", "left_anti").select("v", "label")), "joined")


def _need(limit: Threshold, size: str) -> Column:
    """Threshold.need() as a column."""
    least = f"(({limit.num} * {size} + {limit.den - 1}) div {limit.den})"
    common = f"(({limit.num} * {least} + {limit.den - 1}) div {limit.den})"
    return F.expr(f"greatest(1, least(({least} + 9) div 10, {common}))")


def _plausible(pairs: DataFrame, sketches: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    side = lambda c: sketches.select(F.col("_c").alias(c), F.col("_size").alias(f"_n{c}"), F.col("_sk").alias(f"_s{c}"))
    met = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y").select("x", "y", "_nx", "_ny", "_sx", "_sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.concat_arrays([batch.column(4), batch.column(5)])
            buf, offs = B.flat(both)
            k = np.arange(batch.num_rows)
            size = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
            far = within(k, k + k.size, size, np.frombuffer(buf.tobytes(), U), offs // 8, limit)
            yield batch.select([0, 1]).filter(pa.array(far >= 0))

    small_batches(pairs.sparkSession, 4096)
    return cut(met.mapInArrow(run, "x long, y long"), "plausible")


def _rarest(met: DataFrame, limit: Threshold) -> DataFrame:
    """_t, _c: of each class's shared lists those that are left without its need - 1 longest.

    Two linked classes share need lists or more; the shortest shared one, in the
    order of (length, fingerprint), is left on both sides.  If that one is long, all
    that they share are, so only classes with need long lists stay in long ones.
    Long lists are split by bands of set size, of which linked sets share one.
    """
    length = cut(met.groupBy("_t").agg(F.count(F.lit(1)).alias("_df")), "lengths")
    own = met.join(length, "_t").groupBy("_c").agg(F.first("_size").alias("_size"), F.sort_array(F.collect_list(F.struct("_df", "_t"))).alias("_of"))  # one class's own entries
    need = _need(limit, "_size")
    left = F.slice("_of", F.lit(1), F.greatest(F.lit(0), F.size("_of") - need + 1).cast("int"))
    popular = F.size(F.filter("_of", lambda e: e["_df"] > SCAN)) >= need
    each = own.select("_c", "_size", popular.alias("_popular"), F.explode(left).alias("_e")).select("_c", "_size", "_popular", "_e._df", "_e._t").filter("_df > 1")
    short = each.filter(F.col("_df") <= SCAN).select("_t", "_c")
    band = lambda size: F.floor(F.log(size) / (2 * math.log(limit.den / limit.num)))
    bands = F.array_distinct(F.array(band(F.col("_size")), band(F.expr(f"_size * {limit.den} div {limit.num}"))))
    long = each.filter((F.col("_df") > SCAN) & F.col("_popular")).select("_t", "_c", F.explode(bands).alias("_band"))
    return cut(short.unionAll(long.select(F.xxhash64("_t", "_band"), "_c")), "rarest")


def _light_edges(light: DataFrame, limit: Threshold) -> DataFrame:
    """Star edges of sets that enumerate a common subset: to the set that removed least, by which all linked ones hang together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, small in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = small.values.to_numpy().view(U)
                h, gone = _subsets(own, limit)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), c)), pa.array(h, pa.int64()), pa.array(gone, pa.int64()), pa.array(own.size - np.array(gone, np.int64))], ["_c", "_s", "_a", "_i"])

    classes = light.groupBy("_c").agg(F.first("_small").alias("_small"))
    each = cut(classes.mapInArrow(run, "_c long, _s long, _a long, _i long"), "subsets")
    centre = each.groupBy("_s", "_i").agg(F.min(F.struct("_a", "_c")).alias("_m"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).filter("_lo <> _hi")
    fits = limit.den * F.col("_i") >= limit.num * (F.col("_i") + F.col("_a") + F.col("_m._a"))
    return each.join(cut(centre, "centres"), ["_s", "_i"]).filter((F.col("_c") != F.col("_m._c")) & fits).select(F.col("_c").alias("x"), F.col("_m._c").alias("y")).distinct()


def _fetch_sets(rows: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """_c, _size, _set of the needed classes, from one text each; texts that are surely not needed do not move."""
    keyed = rows.withColumn("_key", F.xxhash64("_id", "_h"))
    keys = cut(needed.select(F.xxhash64("_of._id", "_of._h").alias("_key")), "keys")
    some = maybe_in(keyed, F.col("_key"), keys).filter("_maybe").join(keys, "_key", "left_semi")
    return cut(_sets(some.select("_id", "_text"), n).dropDuplicates(["_c"]), "sets")


def _named(entries: DataFrame, labels: DataFrame) -> DataFrame:
    own = entries.select("_id", "_h", "_row", "_size", "_c")
    rooted = cut(own.filter("_size > 0").join(labels.withColumnRenamed("v", "_c"), "_c", "left").withColumn("_root", F.coalesce("label", "_c")).select("_id", "_h", "_row", "_size", "_root"), "rooted")
    best = cut(rooted.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row")).alias("_best")), "best")
    met = rooted.join(best, "_root").select("_id", "_h", "_row", F.col("_size").alias("n_shingles"), F.col("_best._id").alias("component"), (F.col("_row") == F.col("_best._row")).alias("first"))
    empty = own.filter("_size = 0").select("_id", "_h", "_row", F.col("_size").alias("n_shingles"), F.col("_id").alias("component"), F.lit(True).alias("first"))
    return met.unionAll(empty)


def keep_first(docs: DataFrame, *, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component keeps another row; all columns as they are.

    Rows that surely stay pass straight through; of rows alike in id and text one stays.
    """
    found = cut(jaccard_components(docs, n=n, num=num, den=den, id_col=id_col, text_col=text_col), "components")
    key = F.xxhash64(F.col(id_col), F.xxhash64(text_or_empty(text_col)))
    # a row to keep may have twins alike in id and text: those keys are kept once
    fate = found.groupBy(F.xxhash64("_id", "_h").alias("_key")).agg(F.max("first").alias("_stays"), F.count(F.lit(1)).alias("_twins")).filter("not _stays or _twins > 1")
    fate = cut(fate, "fate")
    marked = maybe_in(docs.select(whole_row(docs).alias("_r"), key.alias("_jaccard_key")), F.col("_jaccard_key"), fate.select("_key"))
    passed = marked.filter("not _maybe")
    asked = marked.filter("_maybe").join(fate, F.col("_jaccard_key") == F.col("_key"), "left").filter("_stays is null or _stays")
    once = asked.filter("_twins is null or _twins = 1")
    twins = asked.filter("_twins > 1").dropDuplicates(["_jaccard_key"])
    return passed.select("_r").unionAll(once.select("_r")).unionAll(twins.select("_r")).select("_r.*")
