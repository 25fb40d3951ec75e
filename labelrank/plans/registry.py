"""Query registry: one Spark callable ``(spark, sf_dir) -> DataFrame`` and, where SQL
can express it, one DuckDB oracle string per operator key."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so their queries register."""
    from labelrank.plans import (catalog_eval, catalog_text, catalog_sampling,  # noqa: F401
                                 catalog_vectors, catalog_io, catalog_jobs, catalog_storage, catalog_deep,
                                 catalog_keyed)
