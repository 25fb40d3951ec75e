"""Deterministic, partition-independent hashing used for every "random" choice.

Python's Mersenne Twister is not reproducible across tasks, so every draw is a
pure function of its key: ``md5(seed|...)`` read as a 60-bit integer.  The same
expression is written in DuckDB as ``('0x'||substr(md5(s),1,15))::BIGINT``, so
oracles can reproduce every sample exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_string(*parts) -> Column:
    """``concat_ws('|', parts...)`` with every part cast to string."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    if len(cols) == 1:  # concat_ws of one part is the part itself
        return cols[0].cast("string")
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash60(*parts) -> Column:
    """Non-negative 60-bit integer hash of the parts (md5 based)."""
    return F.conv(F.substring(F.md5(key_string(*parts)), 1, 15), 16, 10).cast("bigint")


def hash60_mod(m: int, *parts) -> Column:
    """``hash60(parts) mod m``.  When m divides 16^j (a power of two), only the last
    j hex digits of the 15-digit prefix matter, so fewer digits are converted."""
    for j in range(1, 16):
        if (16 ** j) % m == 0:
            return F.pmod(F.conv(F.substring(F.md5(key_string(*parts)), 16 - j, j), 16, 10).cast("bigint"), F.lit(m))
    return F.pmod(hash60(*parts), F.lit(m))


def hash_order(*parts) -> Column:
    """Sort key for a seeded shuffle: the full md5 hex string."""
    return F.md5(key_string(*parts))
