"""Ordering and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sort_multi_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Global ascending order (range-partitioned sort)."""
    return df.orderBy(*keys)


def top_rows(df: DataFrame, order, n: int) -> DataFrame:
    """First ``n`` rows in ``order``: per-partition top-n then a merge
    (TakeOrderedAndProject), never a full sort."""
    return df.orderBy(*order).limit(n)
