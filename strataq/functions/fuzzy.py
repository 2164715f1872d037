"""Text functions that no built-in expresses: Arrow-batched, behind a JVM shortcut where there is one."""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _offsets(short: str, long: str, least: float) -> Iterable[int]:
    """Starts of the windows of long that can be like short by least of 100.

    At most m characters of either side stay unmatched then, so of 2 m + 1 pieces of short
    one lies in the window whole, shifted by m places at most.
    """
    n, span = len(short), len(long) - len(short)
    m = int(n * (100 - least) / 100 + 1e-9)
    size = n // (2 * m + 1)
    if not size:
        return range(span + 1)
    found: set[int] = set()
    for k in range(0, size * (2 * m + 1), size):
        at = long.find(short[k : k + size])
        while at >= 0:
            found.update(range(max(0, at - k - m), min(span, at - k + m) + 1))
            at = long.find(short[k : k + size], at + 1)
    return sorted(found)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a column of its table as the bits of a number."""
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for ch in b:
        met = row & places.get(ch, 0)
        row = (row + met | row - met) & whole
    return start + end + len(a) - row.bit_count()


def _window_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best similarity, of 100, of the shorter text with any equally long window of the longer; 0 where none reaches least.

    Similar is what both have in common in order, as a share: repeated words do not hide each other.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    best = max((_common(short, long[i : i + len(short)]) for i in _offsets(short, long, least)), default=0) * 100 / len(short)
    return best if best >= least else 0.0


def partial_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """100 where one contains the other, found in the JVM; else the best window's similarity, 0 under least."""

    @F.pandas_udf("double")
    def slow(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None or y is None else round(_window_ratio(x, y, least), 4) for x, y in zip(a, b)])

    inside = F.contains(b, a) | F.contains(a, b)
    return F.when(inside, 100.0).otherwise(slow(F.when(~inside, a), F.when(~inside, b)))


def passages_like(text: Column, parts: Column, least: float) -> Column:
    """array<boolean>: which of the parts one contains the other with, or are like a passage of text by least of 100."""

    @F.pandas_udf("array<boolean>")
    def run(text: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([[q is not None and (q in t or t in q or _window_ratio(q, t, least) >= least) for q in these] for t, these in zip(text, parts)], dtype=object)

    return run(text, parts)


def _places(text: str, parts: Iterable[str]) -> list[tuple[int, int] | None]:
    """Of each part the 0-based half-open place in text, white space runs alike; text is read once for all."""
    words = text.split()
    flat = " ".join(words)
    starts: list[int] = []  # of the words in text, and in flat
    flat_starts: list[int] = []
    if flat != text:
        at = place = 0
        for word in words:
            at = text.index(word, at)
            starts.append(at), flat_starts.append(place)
            at, place = at + len(word), place + len(word) + 1

    def back(k: int) -> int:
        if flat == text:
            return k
        w = bisect_right(flat_starts, k) - 1
        return starts[w] + k - flat_starts[w]

    out: list[tuple[int, int] | None] = []
    for part in parts:
        part = " ".join(part.split())
        k = flat.find(part) if part else -1
        out.append((back(k), back(k + len(part) - 1) + 1) if k >= 0 else None)
    return out


def collapsed_spans(content: Column, spans: Column) -> Column:
    """array<struct<s, e>>: the place of each of an array of spans in content, as collapsed_span has it; content goes to Python once."""

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def find(content: pd.Series, spans: pd.Series) -> pd.Series:
        none = {"s": None, "e": None}
        return pd.Series([[none if at is None else {"s": at[0], "e": at[1]} for at in _places(text or "", (p or "" for p in parts))] for text, parts in zip(content, spans)], dtype=object)

    return find(content, spans)


def collapsed_span(content: Column, span: Column) -> Column:
    """struct<s, e>: 0-based half-open place of span in content, white space runs alike; null without one."""

    @F.pandas_udf("s int, e int")
    def find(content: pd.Series, span: pd.Series) -> pd.DataFrame:
        found = (_places(text or "", [part or ""])[0] for text, part in zip(content, span))
        return pd.DataFrame([at or (None, None) for at in found], columns=["s", "e"]).astype("Int32")

    return find(content, span)


def merge_fragments(a: Column, b: Column) -> Column:
    """a and b joined over their longest common end and start: an expression over all overlaps."""
    sizes = F.reverse(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))))
    overlap = F.filter(sizes, lambda n: (n == 0) | (F.right(a, n) == F.left(b, n)))
    return F.concat(a, F.substring(b, F.get(overlap, F.lit(0)) + 1, F.length(b)))


def deep_merge(base: Column, over: Column) -> Column:
    """JSON objects merged key by key at any depth; scalars and lists of the second replace."""

    def merge(x, y):
        if not (isinstance(x, dict) and isinstance(y, dict)):
            return y
        return x | {k: merge(x[k], v) if k in x else v for k, v in y.items()}

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(merge(json.loads(x), json.loads(y)), separators=(",", ":"), sort_keys=True) for x, y in zip(a, b)])

    return run(base, over)


def compatible(text: Column) -> Column:
    """NFKC; only texts with characters that it can change leave the JVM."""

    @F.pandas_udf("string")
    def normal(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    odd = text.rlike("[^\\x00-\\x9f\\u00c0-\\u00ff]")
    return F.when(odd, normal(F.when(odd, text))).otherwise(text)
