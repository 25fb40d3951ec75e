"""Queries of this subpackage: one callable ``(spark, sf_dir) -> DataFrame`` per operator and,
where SQL can express it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every operator module so that its query registers."""
    from labelrank.llm import (bpe, chat, collocations, decontaminate, knn_join, mixing, ngram_join,  # noqa: F401
                               quality, repair, secrets, suffix_dedup, url_filters, warc)
