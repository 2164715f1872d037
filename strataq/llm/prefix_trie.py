"""Prefix trie of conversations by preorder intervals.

A conversation is a sequence of turns; a node is a distinct sequence of first turns.
Sequences are ranked lexicographically (by 128-bit codes of their turns), eight turns
at a time: runs of eight get order-preserving names, runs of eight names get names, and
so on, so there are few rounds and no conversation is gathered in one row.  The
sequences that pass through a node have consecutive ranks lo .. hi, and nodes in order
of (lo, depth) stand in preorder: a subtree is an interval, which ends where rank hi
ends.  Leaves and savings of every subtree are differences of prefix sums over that
order.

Order matters in four places (turns of a conversation, its prefix hashes, names,
preorder).  All use one distributed scan: rows are dealt and sorted by range, summed in
each partition, and a carry per partition, computed from one row each, is added on the
second read.  So a conversation, a node or a group of copies may hold any share of the
rows.  Copies of one sequence go on as one row with a count.  Ids of those that end at a
node are joined in pieces where they lie sorted, and one digest reads the pieces in turn
(SHA-256 is sequential; its task reads a row per 8192 ids).

Defined results: rows with a null conversation id belong to none and are left out; null
role or text is empty; a null turn comes first, equal turns go by a hash of role and
text, repeated rows count each; texts are read whole; other columns are ignored and
cannot clash.  Without conversations there is no node, not even the root.  Turns are
told apart by 128 bits and prefixes by 128 bits and their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, text_or_empty

#: Elements that one name stands for.
RADIX = 8
#: Ids joined in one piece of a digest.
PIECE = 8192
WORD = r"[^\x20\x09-\x0D]+"


# the distributed scan


def _with_columns(batch: pa.RecordBatch, arrays: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, arrays)], [*batch.schema.names, *names])


def _sums(g: np.ndarray, values: list[np.ndarray], before: tuple | None) -> list[np.ndarray]:
    """Inclusive sums (modulo 2**64) of each column over rows with one g in a row, going on from `before`: (g, sums so far)."""
    fresh = np.concatenate([[True], g[1:] != g[:-1]])
    run, start = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    out = []
    for k, v in enumerate(values):
        total = np.cumsum(v, dtype=np.uint64)
        base = np.concatenate([np.zeros(1, np.uint64), total])[start]
        if before is not None and before[0] == g[0]:
            base[0] -= before[1][k]
        out.append(total - base[run])
    return out


def scan(rows: DataFrame, group: str | None, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """rows plus `_n`, their number within `group` (or of all) by `order`, from 1, and for each long column s in `sums`
    s + "_upto" and s + "_before": the sum over the group's rows up to here, with and without this one, modulo 2**64.
    """
    spark = rows.sparkSession
    small_batches(spark, rows=1 << 16)
    rows = rows.withColumn("_g", F.lit(0).cast("long") if group is None else F.col(group))
    keys = [F.col("_g"), *order] if group is not None else order
    summed = ["_n", *(f"{s}_upto" for s in sums)]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held is not None:
                yield _with_columns(held, [np.zeros(held.num_rows, bool)], ["_end"])
            g = batch.column("_g").to_numpy()
            values = [np.ones(g.size, np.uint64), *(batch.column(s).to_numpy().view(np.uint64) for s in sums)]
            got = _sums(g, values, before)
            before = (g[-1], [x[-1] for x in got])
            held = _with_columns(batch, [*(x.view(np.int64) for x in got), np.full(g.size, pid, np.int32)], [*summed, "_pid"])
        if held is not None:
            yield _with_columns(held, [np.arange(held.num_rows) == held.num_rows - 1], ["_end"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {s} long" for s in summed)
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = cut(sorted_rows.mapInArrow(local, f"{kind}, _pid int, _end boolean"), name)
    carry: dict[int, tuple] = {}
    last = None
    for pid, g, *got in sorted(map(tuple, table.filter("_end").select("_pid", "_g", *summed).collect())):  # a row per partition
        if last is not None:
            carry[pid] = last
        go_on = last[1] if last is not None and last[0] == g else [0] * len(summed)
        last = (g, [(x + y) % (1 << 64) for x, y in zip(go_on, got)])
    top = 1 + max(carry, default=0)
    of_group = np.zeros(top, np.int64)
    add = np.zeros((len(summed), top), np.uint64)
    known = np.zeros(top, bool)
    for pid, (g, got) in carry.items():
        of_group[pid], add[:, pid], known[pid] = g, np.array(got, np.uint64), True
    shared = spark.sparkContext.broadcast((of_group, add, known))  # a few numbers per partition

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_group, add, known = shared.value
        for batch in batches:
            pid = np.minimum(batch.column("_pid").to_numpy(), known.size - 1)
            mine = known[pid] & (batch.column("_g").to_numpy() == of_group[pid]) & (pid == batch.column("_pid").to_numpy())
            columns, names = batch.columns[:-2], batch.schema.names[:-2]
            for k, s in enumerate(summed):
                at = names.index(s)
                total = columns[at].to_numpy().view(np.uint64) + np.where(mine, add[k, pid], 0).astype(np.uint64)
                columns[at] = pa.array(total.view(np.int64))
                if k:
                    columns.append(pa.array((total - batch.column(sums[k - 1]).to_numpy().view(np.uint64)).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names + [f"{s}_before" for s in sums])

    return table.mapInArrow(carried, kind + "".join(f", {s}_before long" for s in sums)).drop("_g")


# conversations as coded turns


def coded_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per turn: _c (conversation), _d (its place, from 1), _c1, _c2 (128 bits of role and text), _w (words of its text)."""
    role, text = text_or_empty(f"`{role_col}`"), text_or_empty(f"`{text_col}`")
    rows = conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("_c"), F.col(f"`{turn_col}`").alias("_turn"), F.xxhash64(F.lit(1), role, text).alias("_c1"),
        F.xxhash64(F.lit(2), role, text).alias("_c2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_w"), F.monotonically_increasing_id().alias("_row"),
    ).filter("_c is not null")
    order = [F.col("_turn").asc_nulls_first(), F.col("_c1"), F.col("_c2"), F.col("_row")]
    return scan(rows, "_c", order, [], "turns").select("_c", F.col("_n").alias("_d"), "_c1", "_c2", "_w")


def share_heads(turns: DataFrame, *, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns and the ids of all conversations.

    Conversation c gets the first h turns of conversation c - c % every (all if it has fewer, none if it is absent),
    then its own turns after its first h; h = crc32 of c in decimal, modulo `most`.
    """
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % most
    length = cut(turns.groupBy("_c").agg(F.max("_d").alias("_len")), "lengths")
    base = F.col("_c") - F.col("_c") % every
    convs = length.select("_c", base.alias("_b"), h(F.col("_c")).alias("_h"))
    held = convs.join(length.select(F.col("_c").alias("_b"), F.col("_len")), "_b", "left").select("_c", F.least("_h", F.coalesce("_len", F.lit(0))).alias("_k"))
    heads = turns.filter((F.col("_c") % every == 0) & (F.col("_d") < most)).withColumnRenamed("_c", "_b")
    heads = convs.join(heads, "_b").filter("_d <= _h").select("_c", F.col("_d").alias("_p"), "_c1", "_c2", "_w")
    tails = turns.filter(F.col("_d") > h(F.col("_c"))).join(held, "_c").select("_c", (F.col("_d") - h(F.col("_c")) + F.col("_k")).alias("_p"), "_c1", "_c2", "_w")
    return heads.unionAll(tails), length.select("_c")


# ranks and nodes


def sequence_ranks(turns: DataFrame) -> DataFrame:
    """_c, _rank: the lexicographic rank of its sequence of codes among the distinct ones, from 1; turns have _c, _p, _c1, _c2."""
    longest = turns.agg(F.max("_p")).first()[0] or 0
    items = turns.select("_c", (F.col("_p") - 1).alias("_q"), F.array("_c1", "_c2").alias("_v"))
    while True:
        at = F.floor(F.col("_q") / RADIX)
        key = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_q", "_v"))), lambda x: x["_v"]))  # RADIX elements at most
        runs = items.groupBy("_c", at.alias("_q")).agg(key.alias("_key"))
        runs = cut(runs.select("_c", "_q", F.xxhash64(F.lit(1), "_key").alias("_k1"), F.xxhash64(F.lit(2), "_key").alias("_k2"), "_key"), "runs")
        distinct = runs.groupBy("_k1", "_k2").agg(F.first("_key").alias("_key"))
        names = scan(distinct, None, [F.col("_key")], [], "names").select("_k1", "_k2", F.col("_n").alias("_name"))
        items = runs.drop("_key").join(names, ["_k1", "_k2"])
        longest = -(-longest // RADIX)
        if longest <= 1:
            return items.select("_c", F.col("_name").alias("_rank"))
        items = items.select("_c", "_q", F.array("_name").alias("_v"))


def _end_digests(ranked: DataFrame) -> DataFrame:
    """_rank, _ends: SHA-256 of the ids with that rank, ascending, comma-joined."""
    small_batches(ranked.sparkSession, rows=1 << 16)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            rank, conv = (batch.column(x).to_numpy() for x in ("_rank", "_c"))
            start = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if rank.size else np.zeros(0, np.int64)
            start = np.unique(np.concatenate([start, np.arange(0, rank.size, PIECE)])).astype(np.int64)
            ids = list(map(str, conv.tolist()))
            text = [",".join(ids[i:j]) for i, j in zip(start.tolist(), [*start[1:].tolist(), rank.size])]
            yield pa.RecordBatch.from_arrays([pa.array(rank[start]), pa.array(np.full(start.size, pid, np.int32)), pa.array(k + np.arange(start.size)), pa.array(text, pa.string())], ["_rank", "_pid", "_k", "_text"])
            k += start.size

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for rank, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if rank == now:
                    state.update(b"," + text.encode())
                    continue
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = rank, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["_rank", "_ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["_rank", "_ends"])

    dealt = ranked.select("_rank", "_c").repartitionByRange("_rank", "_c").sortWithinPartitions("_rank", "_c").mapInArrow(pieces, "_rank long, _pid int, _k long, _text string")
    return dealt.repartition("_rank").sortWithinPartitions("_rank", "_pid", "_k").mapInArrow(digests, "_rank long, _ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; and
    preorder, subtree_end: its place among all nodes, from 1, and that of the last node below it (or itself).

    turns: _c, _p (place, from 1 without gaps), _c1, _c2 (the turn's code), _w (its words).  convs: _c, all conversations, also those without turns.
    """
    salted = turns.withColumns({f"_h{i}": F.xxhash64(F.lit(i + 2), "_c1", "_c2", "_p") for i in (1, 2)})
    prefixes = cut(scan(salted, "_c", [F.col("_p")], ["_h1", "_h2"], "prefixes").select("_c", "_p", "_c1", "_c2", "_w", "_h1_upto", "_h2_upto", "_h1_before", "_h2_before"), "prefix_hashes")
    ranked = cut(convs.join(sequence_ranks(prefixes), "_c", "left").select("_c", F.coalesce("_rank", F.lit(0).cast("long")).alias("_rank")), "ranked")
    sequences = cut(ranked.groupBy("_rank").agg(F.count(F.lit(1)).alias("_members"), F.min("_c").alias("_c")), "sequences")

    total = [F.sum("_members").alias("n_convs"), F.min("_c").alias("conv_id"), F.min("_rank").alias("_lo"), F.max("_rank").alias("_hi")]
    one = [F.first(x).alias(x) for x in ("_w", "_u1", "_u2")]
    named = prefixes.select("_c", "_p", "_w", F.col("_h1_upto").alias("_t1"), F.col("_h2_upto").alias("_t2"), F.col("_h1_before").alias("_u1"), F.col("_h2_before").alias("_u2"))
    below = named.join(sequences, "_c").groupBy("_p", "_t1", "_t2").agg(*total, *one)
    zero = lambda n: F.lit(0).cast("long").alias(n)
    root = sequences.agg(*total).filter("n_convs > 0").select(*map(zero, ("_p", "_t1", "_t2")), "n_convs", "conv_id", "_lo", "_hi", *map(zero, ("_w", "_u1", "_u2")))
    nodes = cut(below.unionByName(root), "nodes")

    children = nodes.filter("_p > 0").groupBy((F.col("_p") - 1).alias("_p"), F.col("_u1").alias("_t1"), F.col("_u2").alias("_t2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("_p") + 1).alias("_p"), F.col("_t1").alias("_u1"), F.col("_t2").alias("_u2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, ["_p", "_t1", "_t2"], "left").join(parents, ["_p", "_u1", "_u2"], "left")
    nodes = nodes.select(
        "conv_id", F.col("_p").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "_lo", "_hi",
        F.col("n_children").isNull().cast("long").alias("_leaf"), ((F.col("n_convs") - 1) * F.col("_w")).alias("_saved"),
    )

    ordered = cut(scan(nodes, None, [F.col("_lo"), F.col("depth")], ["_leaf", "_saved"], "preorder"), "ordered")
    # every rank brings its own last node, so each has an end
    ends = ordered.groupBy(F.col("_lo").alias("_hi")).agg(F.max("_n").alias("subtree_end"), F.max("_leaf_upto").alias("_leaves"), F.max("_saved_upto").alias("_all_saved"))
    own_end = ordered.groupBy("_lo").agg(F.max("depth").alias("depth")).join(_end_digests(ranked).withColumnRenamed("_rank", "_lo"), "_lo")
    out = ordered.join(ends, "_hi").join(own_end, ["_lo", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("_leaves") - F.col("_leaf_before")).alias("n_leaves"),
        (F.col("_all_saved") - F.col("_saved_before")).alias("saved_tokens"), F.coalesce("_ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.col("_n").alias("preorder"), "subtree_end",
    )
