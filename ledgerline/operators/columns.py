"""Column-wise steps of the reports: defaults for missing values, comparison
flags, exact price arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import PRICE


def fill_missing(df: DataFrame, value, columns: list[str]) -> DataFrame:
    return df.na.fill(value, subset=columns)


def flag_greater(df: DataFrame, keep: list[str], left: str, right: str, alias: str) -> DataFrame:
    """``alias`` = left > right (NULL if either is)."""
    return df.select(*keep, (F.col(left) > F.col(right)).alias(alias))


def price_arithmetic(df: DataFrame, keep: list[str], price: str, discount: str, tax: str, quantity: str) -> DataFrame:
    """Exact discount amount, net, gross and unit price of every row."""
    p = F.col(price)
    parts = df.select(*keep, price, quantity, (p * F.col(discount)).alias("disc_amount"),
                      (p * F.col(tax)).alias("tax_amount"))
    return parts.select(*keep, "disc_amount", (p - F.col("disc_amount")).alias("net_price"),
                        (p + F.col("tax_amount")).alias("gross_price"),
                        (p / F.col(quantity)).cast(PRICE).alias("unit_price"))
