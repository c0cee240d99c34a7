"""Named queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("hotkeys", "corpus", "ngrams", "scorers", "phrases", "results", "sources")


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        m = import_module(f"{__name__}.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
