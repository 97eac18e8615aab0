"""Equi-joins. The physical strategy is Spark's: a side is broadcast only when
its estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` at plan
time, or its measured size under the adaptive threshold once AQE has run it;
otherwise both sides shuffle on the key and AQE splits skewed partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_inner_expr(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on differently named keys; both key columns stay."""
    return left.join(right, left[left_key] == right[right_key], "inner")


def join_using(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on same-named key(s); one copy of each key column is kept."""
    return left.join(right, keys if isinstance(keys, list) else [keys], how)


def left_chain(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """``base`` left-joined with each frame of ``others`` on ``key``."""
    out = base
    for o in others:
        out = out.join(o, key, "left")
    return out


def header_detail_sum(detail: DataFrame, header: DataFrame, detail_key: str, header_key: str,
                      owner: str, amount: str, alias: str) -> DataFrame:
    """Sum detail amounts per owner found on the header row (inner join)."""
    h = header.select(F.col(header_key).alias("__hk"), F.col(owner).alias(owner))
    d = detail.select(F.col(detail_key).alias("__hk"), F.col(amount).alias("__amt"))
    return (d.join(h, "__hk", "inner")
            .groupBy(owner).agg(F.sum("__amt").alias(alias)))


def left_anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` whose key has no match in ``right`` (only the key of right is read)."""
    r = right.select(F.col(right_key).alias("__rk")).distinct()   # pre-aggregated: hot keys collapse map-side
    return left.join(r, left[left_key] == r["__rk"], "left_anti")


BITMAP_BITS = 32768                    # bits of one bitmap of bitmap_construct_agg: 4 KB


def key_bitmaps(df: DataFrame, key: str, bitmaps: int = 1024) -> DataFrame:
    """(__bucket, __bits): a hashed bitmap of the keys, at most ``bitmaps`` rows of 4 KB."""
    slot = F.pmod(F.xxhash64(key), F.lit(bitmaps * BITMAP_BITS))
    return (df.where(F.col(key).isNotNull()).select(slot.alias("__slot"))
            .groupBy(F.floor(F.col("__slot") / BITMAP_BITS).cast("int").alias("__bucket"))
            .agg(F.bitmap_construct_agg(F.col("__slot") % BITMAP_BITS).alias("__bits")))


def maybe_in(df: DataFrame, key: str, bitmaps_df: DataFrame, bitmaps: int = 1024) -> DataFrame:
    """Rows of ``df`` whose key may be among those of the bitmaps: all that are,
    and few others while the keys are few for the bits. No row is shuffled: the bitmaps are sent
    to every task, 4 MB by default whatever the size of the table."""
    slot = F.pmod(F.xxhash64(key), F.lit(bitmaps * BITMAP_BITS))
    at = slot % BITMAP_BITS
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = (df.withColumn("__at", at).withColumn("__in", F.floor(slot / BITMAP_BITS).cast("int"))
             .join(F.broadcast(bitmaps_df), F.col("__in") == F.col("__bucket")))
    return found.where(F.bit_get(byte, (F.col("__at") % 8).cast("int")) == 1).select(*df.columns)


def left_anti_prefiltered(left: DataFrame, right: DataFrame, left_key: str, right_key: str, bitmaps: int = 1024) -> DataFrame:
    """``left_anti`` for a right side that is much larger than the left: only the
    right rows whose key may occur on the left reach the exact join. The keys must be of one type. Reads the left twice."""
    if left.schema[left_key].dataType != right.schema[right_key].dataType:
        raise ValueError(f"keys of different types: {left_key}, {right_key}")
    near = maybe_in(right.select(F.col(right_key).alias("__rk")), "__rk", key_bitmaps(left, left_key, bitmaps), bitmaps)
    return left_anti(left, near, left_key, "__rk")
