"""Saved scans as a keyed table: upsert, retention, search, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(scans: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest version of each key (SNK16, JOI17): a partial maximum of structs, so a hot key is reduced before the shuffle."""
    rest = [c for c in scans.columns if c != key and c not in order]
    best = scans.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_b"))
    return best.select(key, *[F.col("_b")[c].alias(c) for c in [*order, *rest]])


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    return latest(old.unionByName(new), key, order)


def retain(scans: DataFrame, order: str, n: int, ties: str) -> DataFrame:
    """The newest n (SRT2, SRT3)."""
    return scans.orderBy(F.desc(order), F.desc(ties)).limit(n)


def search(scans: DataFrame, query: str, *fields: str) -> DataFrame:
    """Rows of which a field contains the query, case aside; an empty query keeps all (FLT14)."""
    q = query.strip().lower()
    hit = F.lit(not q)
    for f in fields:
        hit = hit | F.coalesce(F.lower(f).contains(q), F.lit(False))
    return scans.where(hit)


def delete(scans: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among `keys` (SNK17)."""
    return scans.join(keys.select(key).distinct(), key, "left_anti")


def gaps(scans: DataFrame, key: str, order: str) -> DataFrame:
    """Seconds since the last row of the same key."""
    return scans.withColumn("gap", F.unix_seconds(order) - F.unix_seconds(F.lag(order).over(W.partitionBy(key).orderBy(order))))
