"""Decimal types of the marts, money normalisation and the guarded percentage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed output types of the marts.
QUANTITY = "decimal(38,8)"
PORTFOLIO = "decimal(38,4)"
MONEY = "decimal(18,2)"
PRICE = "decimal(18,4)"
PCT = "decimal(5,2)"



def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_pct(numerator, denominator, dtype: str = PCT) -> Column:
    """``denominator > 0 ? numerator / denominator * 100 : 0``.

    The ratio goes to ``dtype`` with try_cast: a value that does not fit
    (above 999.99 for decimal(5,2)) becomes NULL instead of failing the job.
    A NULL or non-positive denominator takes the zero branch.
    """
    n, d = _col(numerator), _col(denominator)
    return F.when(d > 0, (n / d * 100).try_cast(dtype)).otherwise(F.lit(0).cast(dtype))


def spark_avg(total, count) -> Column:
    """Average from a decimal partial sum and a row count, rounded the way
    ``F.avg`` rounds a decimal: quotient against ``decimal(20,0)``; NULL for 0 rows.

    Lets averages be pre-aggregated (sum, count) before a join and finished after it.
    """
    t, c = _col(total), _col(count)
    return F.when(c > 0, t / c.cast("decimal(20,0)"))


def times(amount, n) -> Column:
    """The sum of ``n`` equal QUANTITY amounts, exact to the last digit (a plain product of two
    such wide decimals is rounded); results from 10^29 on are an error."""
    c = _col(amount)
    k = n.cast("decimal(10,0)")
    part = c % F.lit(1)
    parts = (part * k).cast("decimal(20,8)")
    whole = (c - part).cast("decimal(30,0)") * k
    total = (whole + (parts - parts % F.lit(1)).cast("decimal(11,0)")).cast("decimal(29,0)")
    return F.when(n == 1, c.cast(QUANTITY)).otherwise((total + (parts % F.lit(1)).cast("decimal(8,8)")).cast(QUANTITY))
