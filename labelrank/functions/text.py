"""Text column functions: all built-in expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() whitespace set, as a regex class valid in Java and RE2.
PY_WHITESPACE = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
STRIP_PATTERN = rf"^{PY_WHITESPACE}+|{PY_WHITESPACE}+\z"
THINK_END = "</think>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c) -> Column:
    """``str.strip()``: leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), STRIP_PATTERN, "")


def format_query(q) -> Column:
    return py_strip(q)


def format_passage(text, title=None) -> Column:
    """``strip(strip(title) + " " + strip(text))``; a missing title counts as ''."""
    t = F.lit("") if title is None else F.coalesce(_c(title), F.lit(""))
    return py_strip(F.concat(py_strip(t), F.lit(" "), py_strip(text)))


def title_sep_join(title, text, sep: str = "[SEP]", use_title: bool = True) -> Column:
    """``title + sep + text`` when a title exists (and ``use_title``), else the text."""
    if not use_title:
        return _c(text)
    return F.when(_c(title).isNotNull(), F.concat(_c(title), F.lit(sep), _c(text))).otherwise(_c(text))


def truncate_words(text, n: int = 300) -> Column:
    """First ``n`` pieces of ``text.split(" ")`` (empty pieces count) joined by a space.

    Written as an anchored regex that stops at the n-th space, so a long text is
    scanned only up to its cut instead of being split into an array."""
    return F.regexp_extract(_c(text), rf"^(?:[^ ]* ){{0,{n - 1}}}[^ ]*", 0)


def strip_reasoning(reply) -> Column:
    """Text between the first and a second ``</think>``; the reply unchanged without one."""
    r = _c(reply)
    return F.when(r.contains(THINK_END), F.get(F.split(r, THINK_END, -1), 1)).otherwise(r)


def relevance_filter(ids, scores) -> Column:
    """Ids whose 0/1 score is 1, list order kept."""
    s = _c(scores)
    return F.filter(_c(ids), lambda x, i: F.get(s, i) == 1)


def has_hard_negatives(hard) -> Column:
    """Hard-negative list, or an empty list when missing or exactly ``['']``."""
    h = _c(hard)
    empty = F.array().cast("array<string>")
    return F.when(h.isNull() | (h == F.array(F.lit(""))), empty).otherwise(h)


def shard_filter(df, num_shards: int, index: int, offset: str = "offset", total: int | None = None,
                 contiguous: bool = True):
    """Rows of shard ``index`` of ``num_shards`` by dense 0-based ``offset``.

    Contiguous shards: the first ``total mod n`` shards hold one extra row (needs
    the row count, a single-row aggregate).  Otherwise every n-th row.
    """
    if not contiguous:
        return df.filter(F.pmod(F.col(offset), F.lit(num_shards)) == index)
    n = df.count() if total is None else total
    div, mod = divmod(n, num_shards)
    start = div * index + min(index, mod)
    end = start + div + (1 if index < mod else 0)
    return df.filter((F.col(offset) >= start) & (F.col(offset) < end))
