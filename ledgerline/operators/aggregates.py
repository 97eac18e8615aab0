"""Grouped aggregations; Spark combines map-side before the shuffle, so a hot
key costs one partial row per task, not one task for all its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_by(df: DataFrame, keys: list[str], value: str, alias: str, dtype: str | None = None) -> DataFrame:
    total = F.sum(value)
    if dtype:
        total = total.cast(dtype)
    return df.groupBy(*keys).agg(total.alias(alias))


def stats_by(df: DataFrame, keys: list[str], value: str, dtype: str | None = None) -> DataFrame:
    """avg / min / max / count(non-NULL) of ``value``."""
    def c(x):
        return x.cast(dtype) if dtype else x
    return df.groupBy(*keys).agg(
        c(F.avg(value)).alias(f"avg_{value}"),
        c(F.min(value)).alias(f"min_{value}"),
        c(F.max(value)).alias(f"max_{value}"),
        F.count(value).alias(f"count_{value}"),
    )


def first_constant(df: DataFrame, keys: list[str], col: str, alias: str, count_alias: str) -> DataFrame:
    """Value of a column that is constant within each group, and the group's rows."""
    return df.groupBy(*keys).agg(F.any_value(col).alias(alias), F.count(F.lit(1)).alias(count_alias))


def ordered_string_agg(df: DataFrame, keys: list[str], order_col: str, value_col: str,
                       alias: str, sep: str = ", ") -> DataFrame:
    """Values of each group joined by ``sep`` in ``order_col`` order.

    ``collect_list`` alone has no defined order after a shuffle, so each value
    travels with its order key and the array is sorted before joining.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                 F.col(value_col).alias("v"))))
    joined = F.array_join(F.transform(pairs, lambda x: x["v"]), sep)
    return df.groupBy(*keys).agg(joined.alias(alias))
