"""Quality rules: text statistics and a learned decision list over them.

Sequential covering: grow a conjunction of thresholds by information gain on
two thirds of the labelled rows, prune conditions from its end on the last
third, keep it if it is precise enough there, drop the rows it covers, repeat.
The list becomes one ordered Spark conditional expression.

Learning takes at most `max_labelled` labelled documents (lowest id hash), a
documented bound; the statistics cover every word and line of every document.

Defined results: a null text has no words, so all counts are 0; whole texts of
any length; repeated rows each get their row; repeated labels of one id count
once (the lowest); null labels do not teach; without labels of both kinds the
list is empty and keeps all.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut, least_hashed, small_batches, text_or_empty

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: Feature -> (numerator, denominator) of the statistics.
FEATURES = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "mean_word": ("word_chars", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "mark_ratio": ("n_marks", "n_words"),
    "words": ("n_words", None),
}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _UPPER, _MARK = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"!?")
_LEAD = np.arange(256) & 0xC0 != 0x80  # first byte of a code point
_SOLID = ~_table(b" \t\n\x0b\x0c\r")


def text_statistics(buf: np.ndarray, offs: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    n = offs.size - 1
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
    solid = _SOLID[buf]
    start, end, doc = B.words(buf, offs)
    hashed = B.Prefix(buf)
    at, gram = B.ngrams(hashed.of(start, end), doc, window)
    many, _ = B.repeated(doc[at], gram)
    edge = np.zeros(start.size + 1, np.int32)
    np.add.at(edge, at[many], 1)
    np.add.at(edge, at[many] + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    breaks = np.flatnonzero(buf == 10)
    line_start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    line_doc = np.sort(np.concatenate([np.arange(n), B.owner(offs, breaks)]), kind="stable")
    last = np.ones(line_start.size, bool)
    last[:-1] = line_doc[1:] != line_doc[:-1]
    line_end = np.where(last, offs[line_doc + 1], np.append(line_start[1:] - 1, 0))
    seen = np.concatenate([[0], np.cumsum(solid)])
    worded = seen[line_end] > seen[line_start]
    _, later = B.repeated(line_doc[worded], hashed.of(line_start[worded], line_end[worded]))
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": per_text(solid & _LEAD[buf]),
        "n_symbols": per_text(_SYMBOL[buf]),
        "n_dup_lines": np.bincount(line_doc[worded][later], minlength=n),
        "n_repeat_words": np.bincount(doc[covered], minlength=n),
        "n_lines": np.bincount(line_doc, minlength=n),
        "n_upper": per_text(_UPPER[buf]),
        "n_marks": per_text(_MARK[buf]),
    }


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and STATS."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in B.slices(batch, "_text"):
                got = text_statistics(buf, offs)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[k].astype(np.int64)) for k in STATS)], [id_col, *STATS])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in STATS))


# the list


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.limit if self.above else x[self.feature] < self.limit

    def column(self) -> Column:
        value = feature_column(self.feature)
        return value >= self.limit if self.above else value < self.limit


Rule = tuple[Condition, ...]


def feature_column(name: str) -> Column:
    over, under = FEATURES[name]
    over = F.col(over).cast("double")
    return over if under is None else over / F.greatest(F.col(under), F.lit(1)).cast("double")


def feature_values(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: stats[a].astype(float) if b is None else stats[a].astype(float) / np.maximum(stats[b], 1).astype(float) for k, (a, b) in FEATURES.items()}


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray, most: int, cuts: int) -> Rule:
    rule: list[Condition] = []
    inside = live.copy()
    while len(rule) < most and bad[inside].sum() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), inside.sum()
        best = (1e-9, None)
        for name, value in x.items():
            for limit in np.unique(np.quantile(value[inside], np.linspace(0, 1, cuts + 1)[1:])):
                for above in (True, False):
                    got = inside & ((value >= limit) if above else (value < limit))
                    p, n = bad[got].sum(), got.sum()
                    if p and n < n0:
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if gain > best[0]:
                            best = (gain, Condition(name, above, float(limit)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def learn(stats: dict[str, np.ndarray], good: np.ndarray, *, precision: float = 0.9, least: int = 5, max_rules: int = 24, max_conditions: int = 4, cuts: int = 48, seed: int = 3) -> list[Rule]:
    """Ordered rules that each reject; rows that none covers are kept."""
    x, bad = feature_values(stats), good == 0
    turn = np.random.default_rng(seed).permutation(bad.size) % 3
    grow_live, prune_live = turn > 0, turn == 0
    rules: list[Rule] = []
    while len(rules) < max_rules and bad[grow_live].sum() >= least:
        rule = _grow(x, bad, grow_live, max_conditions, cuts)
        if not rule:
            break

        def worth(r: Rule) -> float:
            got = prune_live & _covers(r, x)
            p, n = bad[got].sum(), got.sum()
            return (2 * p - n) / n if n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        got = prune_live & _covers(rule, x)
        if got.sum() < max(1, least // 2) or bad[got].mean() < precision:
            break
        rules.append(rule)
        covered = _covers(rule, x)
        grow_live, prune_live = grow_live & ~covered, prune_live & ~covered
    return rules


def rejecting_rule(rules: list[Rule]) -> Column:
    """1-based number of the first rule that covers the row, else null: one ordered conditional."""
    out = None
    for i, rule in enumerate(rules):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, i + 1) if out is None else out.when(test, i + 1)
    return F.lit(None).cast("int") if out is None else out


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, min_words: int = 20, max_repeat_percent: int = 30, **learning) -> DataFrame:
    """Per row: id, STATS, base_failed, kept, rule (the first that rejects).  labels: (id, good 0/1)."""
    stats = cut(statistics(docs, id_col=id_col, text_col=text_col), "statistics")
    taught = labels.toDF("_id", "_good").filter("_id is not null and _good is not null").groupBy("_id").agg(F.min("_good").cast("int").alias("_good"))
    # only labelled rows move: past the sample's bound a label can still be the only one whose document is here, so all take part
    chosen = cut(taught, "taught")
    known = stats.withColumnRenamed(id_col, "_id").join(chosen, "_id").groupBy("_id").agg(F.max("_good").alias("_good"), F.min(F.struct(*STATS)).alias("_s"))
    rows = least_hashed(cut(known, "labelled"), "_id", max_labelled).select("_good", "_s.*").collect()  # max_labelled rows of numbers; of rows with one id the least
    a = np.array(rows, np.int64).reshape(-1, 1 + len(STATS))
    rules = learn({k: a[:, i + 1] for i, k in enumerate(STATS)}, a[:, 0], **learning)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", rejecting_rule(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
