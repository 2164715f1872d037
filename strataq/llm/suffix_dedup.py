"""Repeated substrings by the triggers of prefix-free parsing, settled by counts where counts suffice.

This is not the dealt method to its end: no suffix array of a whole dictionary or parse is made (README has the
figures why).  What is kept of it are the triggers, phrases that agree wherever the text agrees, and, where counts do
not decide, the order of suffixes before and continuations after a trigger.

Triggers.  Every window of `length` bytes has one trigger: the first place of
least rolling hash among its first `reach` places.  Equal windows have their
trigger at the same place in them; a run of windows shares each trigger.

Counts.  A trigger occurrence is known by two fingerprints: of what surely
follows it in each of its windows, and of all its run's windows, i.e. also the
end of the phrase before it.  Followers met once end there: none of their windows
repeats.  Where all occurrences of a follower agree on the whole run, all windows
repeat.  Both are settled by counts of 64-bit fingerprints with map-side
combination.

Order.  What is left, the distinct runs around the ends of repeats, is ordered
per follower: suffixes of the phrases before the trigger and continuations after
it are sorted, each with the common prefix lengths of neighbours, and the two
orders combine into the order of these windows, in which equal windows are those
of one suffix whose continuations share enough.  A follower with more than
HOT_RUNS distinct runs is split by salt, and equal windows of different salts meet
through 128-bit fingerprints, again combined first; results are the same.

Defined results: a null text is empty; matches never cross documents; texts
below `length` bytes keep everything; whole texts of any length; repeated rows
are texts of their own, so their windows repeat; null ids pass through; an empty
table gives an empty result; extra columns are kept by remove_repeats().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut, small_batches, text_or_empty

U = np.uint64
#: Bytes under one rolling hash.
ROLL = 16
#: Distinct runs of one follower that one task orders; more are salted.
HOT_RUNS = 20_000


def _reach(length: int) -> int:
    """Places a trigger is sought in; leaves enough bytes after it to tell followers apart."""
    return max(1, min(128, (length * 5) // 8, length - ROLL + 1))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    span, m = 1, x
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: m.size - rest], m[rest:]) if rest else m


def runs(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one trigger: text, trigger, first and last window start (buffer positions), follower and run fingerprints."""
    reach, roll = _reach(length), min(ROLL, length)
    count = np.maximum(np.diff(offs) - length + 1, 0)  # windows of each text
    if not count.sum():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.int64),) * 2
    hashed = B.Prefix(buf)
    rolled = B.mix(hashed.windows(roll))
    key = (rolled & U(0xFFFFFFFF00000000)) | np.arange(rolled.size, dtype=U)
    least = _sliding_min(key, reach)
    ends = np.cumsum(count)
    at = np.repeat(offs[:-1] - (ends - count), count) + np.arange(int(ends[-1]))
    doc = np.repeat(np.arange(count.size), count)
    trigger = (least[at] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(at.size, bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], at.size) - 1
    t, lo, hi = trigger[first], at[first], at[last]
    follower = hashed.of(t, t + length - reach + 1)
    whole = B.mix(hashed.of(lo, hi + length) + (t - lo).astype(U) * U(0x9E3779B97F4A7C15))
    return doc[first], t, lo, hi, follower.view(np.int64), whole.view(np.int64)


def _keys(id_col: str) -> list[Column]:
    """What names a row: rows alike in id and text have like results."""
    return [F.xxhash64(F.lit(5), F.col(f"`{id_col}`")).alias("_a"), F.xxhash64("_text").alias("_b")]


_RUNS = "_a long, _b long, _at long, _k long, _w long"


def _run_rows(rows: DataFrame, length: int) -> DataFrame:
    """_a, _b, _at (trigger, windows before and after packed), _k (follower), _w (run) of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in B.slices(batch, "_text"):
                doc, t, lo, hi, follower, whole = runs(buf, offs, length)
                a, b = (part.column(i).to_numpy() for i in (0, 1))
                packed = ((t - offs[doc]) << 16) | ((t - lo) << 8) | (t - hi)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[doc], b[doc], packed, follower, whole)], ["_a", "_b", "_at", "_k", "_w"])

    return rows.mapInArrow(run, _RUNS)


def _spans(at: Column, length: int) -> tuple[Column, Column]:
    """Bytes that the windows of a packed run cover."""
    t = F.shiftright(at, 16)
    return t - F.shiftright(at.bitwiseAND(0xFFFF), 8), t - at.bitwiseAND(0xFF) + length


# ordering distinct runs


def _order(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by (group, bytes) and the common prefix of each with its predecessor (-1 across groups)."""
    pad = (-rows.shape[1]) % 8
    wide = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(U)
    order = np.lexsort((*wide.T[::-1], group))
    s = rows[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), s.shape[1])
    return order, np.concatenate([[-1], np.where(group[order][1:] == group[order][:-1], common, -1)])


def repeated_windows(group: np.ndarray, many: np.ndarray, before: np.ndarray, after: np.ndarray, texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each l: runs with a window that starts l bytes before the trigger, and how often that window occurs.

    Run i: its group, occurrences, most and fewest bytes its windows start before the
    trigger, and the bytes from the first window's start to the last one's end.
    """
    n, reach = group.size, int(before.max()) + 1
    left, right = np.zeros((n, reach), np.uint8), np.zeros((n, length), np.uint8)
    for i, (text, b) in enumerate(zip(texts, before)):
        data = np.frombuffer(text, np.uint8)
        left[i, :b] = data[:b][::-1]
        right[i, : data.size - b] = data[b:]
    left_order, left_common = _order(group, left)
    right_order, right_common = _order(group, right)
    suffix_class, rest_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(int(after.min()), reach):
        own = np.flatnonzero((after <= back) & (back <= before))
        if not own.size:
            continue
        suffix_class[left_order] = np.cumsum(left_common < back)
        rest_class[right_order] = np.cumsum(right_common < length - back)
        _, which = np.unique(suffix_class[own] * (n + 1) + rest_class[own], return_inverse=True)
        yield back, own, np.bincount(which, many[own])[which]


_FOUND = "_k long, _w long, lo int, hi int, f1 long, f2 long, n long"


def _order_runs(classes: DataFrame, length: int) -> DataFrame:
    """classes: _k, _salt, _split, _w, _many, _before, _after, _bytes, dealt by (_k, _salt) and sorted.

    Rows with lo, hi: the least and most bytes before the trigger at which a
    repeated window of a once-met run starts.  Rows with f1, f2: windows of split groups.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        k, salt, split, w, many, before, after, texts = (list(c) for c in zip(*rows))
        k, w, many = np.array(k, np.int64), np.array(w, np.int64), np.array(many, np.int64)
        before, after, split = np.array(before, np.int64), np.array(after, np.int64), np.array(split, bool)
        change = np.ones(k.size, bool)
        change[1:] = (k[1:] != k[:-1]) | (np.array(salt)[1:] != np.array(salt)[:-1])
        lo, hi = np.full(k.size, 999), np.full(k.size, -1)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        start = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
        prefixes = [B.Prefix(flat), B.Prefix(flat, 99)] if split.any() else []
        extra = []
        for back, own, times in repeated_windows(np.cumsum(change), many, before, after, texts, length):
            twice = own[(times > 1) & (many[own] == 1)]
            lo[twice], hi[twice] = np.minimum(lo[twice], back), np.maximum(hi[twice], back)
            if prefixes and (s := own[split[own]]).size:
                at = start[s] + before[s] - back
                extra.append((k[s], w[s], np.full(s.size, back), many[s], *(p.of(at, at + length).view(np.int64) for p in prefixes)))
        found = np.flatnonzero(hi >= 0)
        cols = [k[found], w[found], lo[found], hi[found]]
        none = [None] * found.size
        out = [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32)), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64())]
        if extra:
            x = [np.concatenate(c) for c in zip(*extra)]
            add = [pa.array(x[0]), pa.array(x[1]), pa.array(x[2].astype(np.int32)), pa.array(x[2].astype(np.int32)), pa.array(x[4]), pa.array(x[5]), pa.array(x[3])]
            out = [pa.concat_arrays([a, b]) for a, b in zip(out, add)]
        return pa.RecordBatch.from_arrays(out, ["_k", "_w", "lo", "hi", "f1", "f2", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= HOT_RUNS and row[:2] != held[-1][:2]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return classes.mapInArrow(run, _FOUND)


def repeated_spans(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_a, _b, spans: array of (start, end) bytes, not yet merged, of every row that has any."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`"), text_or_empty(f"`{text_col}`").alias("_text"))
    keyed = rows.select(*_keys(id_col), "_text")
    reach = _reach(length)
    # pass 1: followers met more than once, by counts alone
    known = cut(_run_rows(keyed, length).groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_k"), "followers")
    # pass 2: their occurrences
    hits = cut(_run_rows(keyed, length).join(known, "_k"), "hits")
    classes = cut(hits.groupBy("_k", "_w").agg(F.count(F.lit(1)).alias("_many"), F.min(F.struct("_a", "_b", "_at")).alias("_one")), "runs")
    groups = cut(classes.groupBy("_k").agg(F.count(F.lit(1)).alias("_classes")).filter("_classes > 1"), "mixed")
    mixed = classes.join(groups, "_k")
    # the bytes of one occurrence of each distinct run that is not settled
    asked = mixed.groupBy("_one._a", "_one._b").agg(F.collect_list(F.struct("_k", "_w", "_many", "_classes", F.col("_one._at").alias("_at"))).alias("_asked"))
    texts = keyed.join(cut(asked, "asked"), ["_a", "_b"]).select("_text", "_asked")

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(0).cast(pa.binary())
            out = []
            for text, asked in zip(data, batch.column(1)):
                text = memoryview(text.as_py())
                for q in asked.as_py():
                    t, before, after = q["_at"] >> 16, q["_at"] >> 8 & 0xFF, q["_at"] & 0xFF
                    out.append((q["_k"], q["_w"], q["_many"], q["_classes"], before, after, bytes(text[t - before : t - after + length])))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_k", "_w", "_many", "_classes", "_before", "_after", "_bytes"])

    clipped = texts.mapInArrow(clip, "_k long, _w long, _many long, _classes long, _before long, _after long, _bytes binary").dropDuplicates(["_k", "_w"])
    salts = F.expr(f"cast(ceil(_classes / {HOT_RUNS}.0) as long)")
    dealt = clipped.select("_k", F.pmod("_w", salts).alias("_salt"), (salts > 1).alias("_split"), "_w", "_many", "_before", "_after", "_bytes")
    dealt = dealt.repartition("_k", "_salt").sortWithinPartitions("_k", "_salt")
    found = cut(_order_runs(dealt, length), "found")
    shared = found.filter("f1 is not null").groupBy("f1", "f2").agg(F.sum("n").alias("_n")).filter("_n > 1").select("f1", "f2")
    across = found.filter("f1 is not null").join(shared, ["f1", "f2"]).select("_k", "_w", "lo", "hi")
    ends = found.filter("f1 is null").select("_k", "_w", "lo", "hi").unionAll(across).groupBy("_k", "_w").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    t = F.shiftright(F.col("_one._at"), 16)
    once = classes.filter("_many = 1").join(ends, ["_k", "_w"]).select("_one._a", "_one._b", (t - F.col("hi")).alias("s"), (t - F.col("lo") + length).alias("e"))
    start, end = _spans(F.col("_at"), length)
    often = hits.join(classes.filter("_many > 1").select("_k", "_w"), ["_k", "_w"]).select("_a", "_b", start.alias("s"), end.alias("e"))
    return once.unionAll(often).groupBy("_a", "_b").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union; touching spans are one run."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _applied(docs: DataFrame, make, columns: list[tuple[str, str]], length: int, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """keep columns and make(text bytes, merged spans) of every row."""
    spans = cut(repeated_spans(docs, length=length, id_col=id_col, text_col=text_col), "spans")
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), F.col(f"`{id_col}`").alias("_id"), text_or_empty(f"`{text_col}`").alias("_text"))
    rows = rows.withColumns({"_a": F.xxhash64(F.lit(5), F.col("_id")), "_b": F.xxhash64("_text")}).drop("_id").join(spans.withColumnsRenamed({"_a": "_sa", "_b": "_sb"}), F.col("_a").eqNullSafe(F.col("_sa")) & F.col("_b").eqNullSafe(F.col("_sb")), "left")
    rows = rows.select(*(f"_k{i}" for i in range(len(keep))), "_text", "spans")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    made = [(c, kinds[k]) for c, k in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for batch in batches:
            out = [make(t.as_py().encode(), merged(s.as_py() or [])) for t, s in zip(batch.column(n), batch.column(n + 1))]
            arrays = [pa.array(c, k) for c, (_, k) in zip(zip(*out), made)] if out else [pa.array([], k) for _, k in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], [*keep, *(c for c, _ in made)])

    schema = [(c, docs.schema[c].dataType.simpleString()) for c in keep]
    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in [*schema, *columns]))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def removal_digests(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes)."""

    def make(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        return len(text), sum(e - s for s, e in spans), len(spans), hashlib.sha256(_kept(text, spans)).hexdigest()

    return _applied(docs, make, [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")], length, id_col, text_col, [id_col])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to character boundaries, so that what stays is UTF-8."""
    out = []
    for s, e in spans:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col without its repeated spans (whole characters); same columns, same order."""

    def make(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        return (_kept(text, whole_characters(text, spans)).decode("utf-8"),)

    others = [c for c in docs.columns if c != text_col]
    return _applied(docs, make, [(text_col, "string")], length, id_col, text_col, others).select(*(F.col(f"`{c}`") for c in docs.columns))
