"""Nullable integer keys on their way through Arrow batches.

Pandas turns an integer column with a null into floating point, which cannot hold every 64-bit
key. Keys therefore travel with the smallest 64-bit integer in place of null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_KEY = -(2**63)


def sealed(key: Column | str) -> Column:
    """The key as a 64-bit integer without nulls."""
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("bigint"), F.lit(NULL_KEY).cast("bigint"))


def opened(key: Column | str) -> Column:
    """The key with its nulls back."""
    return F.nullif(F.col(key) if isinstance(key, str) else key, F.lit(NULL_KEY).cast("bigint"))


def sampled(share: float, seed: int, *columns: str) -> Column:
    """Whether the row is in a sample of about ``share`` of the rows, by 64 bits of hash, so that no share is too small."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(F.lit(seed), *columns) < F.lit(int(share * 2**64) - 2**63)
