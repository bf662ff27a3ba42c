"""Named plans: one Spark query per operator, with its DuckDB restatement.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and ``ORACLE[name] = sql``.
Result columns are flat, aliased identically on both sides, and doubles are
rounded to 6 places, because the two engines are compared by value hash.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers plans."""
    from mailsieve.plans import (  # noqa: F401
        q_corpus,
        q_extensions,
        q_features,
        q_files,
        q_functions,
        q_ingest,
        q_metrics,
        q_scans,
        q_score,
        q_streams,
    )
