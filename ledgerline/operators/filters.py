"""Day filters written so the Parquet/JDBC scan receives a plain range predicate."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.dates import as_date


def _is_timestamp(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.TimestampType, T.TimestampNTZType))


def day_literal(df: DataFrame, col: str, day) -> Column:
    """``day`` as a literal of the column's own type (midnight for timestamps)."""
    lit = F.lit(as_date(day))
    if _is_timestamp(df, col):
        return lit.cast(df.schema[col].dataType)
    return lit


def on_or_before_day(df: DataFrame, col: str, day) -> DataFrame:
    """``to_date(col) <= day``; for timestamps expressed as ``col < day + 1``."""
    d = as_date(day)
    if _is_timestamp(df, col):
        return df.filter(F.col(col) < day_literal(df, col, d + _dt.timedelta(days=1)))
    return df.filter(F.to_date(F.col(col)) <= F.lit(d))


def on_day(df: DataFrame, col: str, day) -> DataFrame:
    """``to_date(col) == day``; for timestamps a half-open range of that day."""
    d = as_date(day)
    if _is_timestamp(df, col):
        return df.filter((F.col(col) >= day_literal(df, col, d))
                         & (F.col(col) < day_literal(df, col, d + _dt.timedelta(days=1))))
    return df.filter(F.to_date(F.col(col)) == F.lit(d))


def equals_raw(df: DataFrame, col: str, day) -> DataFrame:
    """``col == day`` without truncation: a timestamp only matches at midnight."""
    return df.filter(F.col(col) == day_literal(df, col, day))


def month_to_date(df: DataFrame, col: str, day) -> DataFrame:
    """``first of month <= col <= day`` on the raw column."""
    d = as_date(day)
    return df.filter((F.col(col) >= day_literal(df, col, d.replace(day=1)))
                     & (F.col(col) <= day_literal(df, col, d)))


def any_positive(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep rows where at least one of ``cols`` is > 0 (NULL counts as not positive)."""
    cond = None
    for c in cols:
        term = F.coalesce(F.col(c) > 0, F.lit(False))
        cond = term if cond is None else (cond | term)
    return df.filter(cond)
