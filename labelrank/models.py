"""Plug-in protocols (text generator, encoder, tokenizer) and deterministic stand-ins.

Real models are supplied by the user and run inside ``mapInPandas`` tasks: one
instance per Python worker (created lazily by a factory), fed Arrow batches.
The stand-ins are simple, deterministic and reproducible in SQL; they exist to
test the data steps around a model, not to judge relevance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd


class Generator(Protocol):
    def generate(self, batch: pd.DataFrame) -> pd.Series:
        """Reply text for every row of the batch (a model reads ``batch['prompt']``)."""


class Encoder(Protocol):
    dim: int

    def encode(self, texts: pd.Series) -> np.ndarray:
        """One float vector per text, shape (n, dim)."""


class Tokenizer(Protocol):
    def encode(self, texts: pd.Series, max_length: int) -> list[list[int]]:
        """Token ids per text, no special tokens, cut to ``max_length``."""


# ---- fixed values: special token ids of the stand-in vocabulary -----------------
PAD_ID, CLS_ID, SEP_ID = 0, 1, 2
N_SPECIAL = 3
# ---------------------------------------------------------------------------------

_INSTANCES: dict[int, tuple[object, object]] = {}


def instance(factory: Callable[[], object]) -> object:
    """One plug-in instance per Python worker process and factory.

    The factory itself is kept in the cache so its ``id`` cannot be reused by
    another object while the entry exists (workers are reused across tasks)."""
    key = id(factory)
    hit = _INSTANCES.get(key)
    if hit is None or hit[0] is not factory:
        hit = (factory, factory())
        _INSTANCES[key] = hit
    return hit[1]


def _tokens(text: str) -> set[str]:
    return set(text.lower().split(" "))


class OverlapSelector:
    """Stand-in selection judge: ``My selection:[[i],...].`` listing the passages
    (1-based) that share at least ``min_shared`` distinct lower-cased space tokens
    with the query.  Reads columns ``query`` and ``passages`` (already truncated)."""

    def __init__(self, min_shared: int = 2):
        self.min_shared = min_shared

    def generate(self, batch: pd.DataFrame) -> pd.Series:
        out = []
        for query, passages in zip(batch["query"], batch["passages"]):
            q = _tokens(query)
            picked = [f"[{i}]" for i, p in enumerate(passages, start=1) if len(q & _tokens(p)) >= self.min_shared]
            out.append("My selection:[" + ",".join(picked) + "].")
        return pd.Series(out, index=batch.index)


class OverlapRanker:
    """Stand-in listwise ranker: passages by shared-token count desc, then position."""

    def generate(self, batch: pd.DataFrame) -> pd.Series:
        out = []
        for query, passages in zip(batch["query"], batch["passages"]):
            q = _tokens(query)
            scored = sorted(((-len(q & _tokens(p)), i) for i, p in enumerate(passages, start=1)))
            out.append(" > ".join(f"[{i}]" for _, i in scored))
        return pd.Series(out, index=batch.index)


class PromptLengthAnswerer:
    """Stand-in answer generator: a reasoning block, then the prompt's piece count."""

    def generate(self, batch: pd.DataFrame) -> pd.Series:
        return pd.Series([f"<think>reading</think>The context has {len(p.split(' '))} pieces."
                          for p in batch["prompt"]], index=batch.index)


def generate_in_pandas(it: Iterator[pd.DataFrame], factory: Callable[[], Generator], out_col: str,
                       keep: list[str]) -> Iterator[pd.DataFrame]:
    gen = instance(factory)
    for pdf in it:
        res = pdf[keep].copy()
        res[out_col] = gen.generate(pdf).astype(str).values
        yield res


class HashedBowEncoder:
    """Python twin of the SQL stand-in encoder (for the ``mapInPandas`` plug-in path):
    lower-cased non-empty space tokens -> ``md5`` bucket -> counts -> L2 norm."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: pd.Series) -> np.ndarray:
        import hashlib
        out = np.zeros((len(texts), self.dim))
        for r, text in enumerate(texts):
            for tok in text.lower().split(" "):
                if tok:
                    out[r, int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:15], 16) % self.dim] += 1
        norms = np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-12)
        return out / norms[:, None]
