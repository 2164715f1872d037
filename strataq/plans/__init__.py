"""Registered queries, by section, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

SECTIONS = ("scans", "relational", "scalars", "search", "decisions")


def _load():
    from . import registry

    for name in SECTIONS:
        import_module(f"{__name__}.{name}")
    return registry


def queries() -> dict[str, Callable]:
    return dict(_load().QUERIES)


def oracles() -> dict[str, str]:
    return dict(_load().ORACLES)
