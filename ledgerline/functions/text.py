"""String helpers of the access audit and the file inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concat_colon(left, right) -> Column:
    """``left:right``; a missing part prints as ``None`` (as Python's f-string does)."""
    return F.concat_ws(":", F.coalesce(_col(left), F.lit("None")),
                       F.coalesce(_col(right), F.lit("None")))


_NAMED = "array<struct<name: string>>"


def first_present_names(payload, keys: tuple[str, ...]) -> Column:
    """Names of the first key of ``keys`` that holds a non-empty array of ``{name}``.

    A missing key, a JSON null and an empty array all fall through to the next
    key; with none left the result is an empty array, as for a NULL payload.
    A payload that is no valid JSON, and an entry without a name, fail the job:
    a truncated listing must not read as "has nothing".
    """
    # parsed once, into a VARIANT; anything but an object fails the cast to a map
    fields = F.variant_get(F.parse_json(_col(payload)), "$", "map<string, variant>")
    arrays = F.filter(F.transform(F.array(*map(F.lit, keys)), lambda k: F.try_element_at(fields, k).cast(_NAMED)), lambda a: F.size(a) > 0)
    chosen = F.coalesce(F.get(arrays, F.lit(0)), F.array().cast(_NAMED))
    return F.transform(chosen, lambda x: F.when(x["name"].isNull(), F.raise_error(F.lit("listing entry without a name")))
                       .otherwise(x["name"]))


def bytes_to_kb(c) -> Column:
    """size in bytes -> KB rounded to 2 decimals (HALF_UP)."""
    return F.round(_col(c) / 1024, 2)
