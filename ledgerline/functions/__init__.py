"""Column-level helpers (Column -> Column), all native Spark expressions."""

from ledgerline.functions.dates import (
    datediff_days, month_start, parse_day, to_day, now,
)
from ledgerline.functions.money import (
    MONEY, PCT, PRICE, PORTFOLIO, QUANTITY, safe_pct,
    spark_avg,
)
from ledgerline.functions.text import bytes_to_kb, concat_colon, first_present_names

__all__ = [
    "datediff_days", "month_start", "parse_day", "to_day", "now",
    "MONEY", "PCT", "PRICE", "PORTFOLIO", "QUANTITY",
    "safe_pct", "spark_avg", "bytes_to_kb", "concat_colon", "first_present_names",
]
