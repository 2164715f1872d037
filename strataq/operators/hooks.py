"""Injectable model calls with deterministic fallbacks.

A hook takes a list of texts and returns a list of the same length; it runs over
Arrow batches.  Where it fails or returns null, the fallback column stands.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unavailable(texts: Sequence[str]) -> list:
    """A hook for which there is no model."""
    raise RuntimeError("no model is configured")


def with_retry(first: Callable[[list], list], second: Callable[[list], list] | None = None, attempts: int = 3) -> Callable[[list], list]:
    """A hook that asks the first model up to `attempts` times, then the second one."""

    def ask(texts: list) -> list:
        for _ in range(attempts):
            try:
                return first(texts)
            except Exception:  # the next attempt may do
                continue
        return (second or unavailable)(texts)

    return ask


def _called(hook: Callable[[list], list], text: Column, kind: str, batch: int) -> Column:
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for at in range(0, len(texts), batch):
            part = texts.iloc[at : at + batch].tolist()
            try:
                out += list(hook(part))
            except Exception:  # any failure of a model call means its fallback
                out += [None] * len(part)
        return pd.Series(out, dtype="object" if kind == "string" else "float64")

    return run(text)


def completed(rows: DataFrame, hook: Callable[[list], list], text: str, fallback: Column, name: str, batch: int = 32) -> DataFrame:
    """rows with `name`: the hook's text, else the fallback."""
    return rows.withColumn(name, F.coalesce(_called(hook, F.col(text).cast("string"), "string", batch), fallback.cast("string")))


def rescored(rows: DataFrame, hook: Callable[[list], list], text: str, score: str, batch: int = 32) -> DataFrame:
    """rows with `score` replaced by the hook's, where it has one."""
    return rows.withColumn(score, F.coalesce(_called(hook, F.col(text).cast("string"), "double", batch), F.col(score).cast("double")))
