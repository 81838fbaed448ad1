"""Bounded samples of a table by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_hash(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """The n rows of `df` whose hash of `keys` is smallest (ties by all columns); all rows where there are at most n. Rows are
    filtered by a share of the hashes where they are read, so only about the sample is sorted; where repeated keys leave fewer
    than n, those are the sample. The same table gives the same rows, however it is split."""
    total = df.count()
    if total <= n:
        return df
    hashed = F.xxhash64(*keys)
    cut = int(min(1.0, 1.2 * n / total) * 2**64) - 2**63
    return df.where(hashed < F.lit(min(cut, 2**63 - 1))).orderBy(hashed, *df.columns).limit(n)
