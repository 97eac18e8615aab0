"""Sharding by a keyed Feistel permutation with cycle walking.

Rows get global numbers 0..n-1 in the order of the given columns. A balanced
Feistel network over the smallest power of four that is at least n permutes
the numbers; outputs of n or more are fed back until they fall below n, which
keeps it a permutation of 0..n-1. The permuted number p gives shard
``p % shards`` and slot ``p // shards``: shard sizes differ by at most one and
slots are gapless. Both are computable from a row number alone, and back.

Nulls sort first. Rows equal in every order column are interchangeable. More
shards than rows leaves the last shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import mix64, save, shuffle_partitions

ROUNDS = 6


def _network(x: np.ndarray, half: int, key: int, forward: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    h = np.uint64(half)
    left, right = x >> h, x & mask
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    for k in keys if forward else keys[::-1]:
        if forward:
            left, right = right, left ^ (mix64(right + k) & mask)
        else:
            left, right = right ^ (mix64(left + k) & mask), left
    return (left << h) | right


def permute(numbers, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 (or its inverse) at ``numbers``."""
    x = np.asarray(numbers, dtype=np.uint64)
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _network(x, half, key, not inverse)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = _network(out[outside], half, key, not inverse)
        outside = outside[out[outside] >= n]
    return out


def place(numbers, n: int, shards: int, key: int):
    """(shard, slot) of row numbers."""
    p = permute(numbers, n, key)
    return (p % np.uint64(shards)).astype(np.int32), (p // np.uint64(shards)).astype(np.int64)


def row_at(shard, slot, n: int, shards: int, key: int) -> np.ndarray:
    """Row number stored at (shard, slot): the inverse of ``place``."""
    p = np.asarray(slot, np.uint64) * np.uint64(shards) + np.asarray(shard, np.uint64)
    return permute(p, n, key, inverse=True)


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(df with a global ``row_number`` 0..n-1 in ``order``, n).

    One range exchange; the position inside a range partition is counted while
    the partition streams by, and the offset of a partition is the sum of the
    counts before it (a table of as many rows as there are partitions). A tie
    column built from the input position splits a run of equal keys over
    several partitions.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, "_tie"]
    ranged = tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])

    def count(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for pdf in batches:
            yield pdf.assign(_part=np.int32(part), _at=np.arange(at, at + len(pdf), dtype=np.int64))
            at += len(pdf)

    table = save(ranged.mapInPandas(count, schema), "numbered")
    sizes = sorted((r["_part"], r["n"]) for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, size in sizes:                 # one row per range partition
        offsets.append((part, total))
        total += size
    starts = spark.createDataFrame(offsets, "_part int, _start long")
    numbered = (table.join(F.broadcast(starts), "_part")
                .withColumn("row_number", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"))
    return numbered, total


def shard_rows(df: DataFrame, order: list[str], shards: int, key: int = 20_24) -> DataFrame:
    """``df`` plus ``row_number``, ``shard`` and ``slot``.

    The frame travels through one range exchange, so pass the columns that are
    to be stored with the placement (ids and sizes), or all of them when the
    shards themselves are to be written. ``df`` must not have those three names.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    numbered, total = number_rows(df, order)

    @F.pandas_udf("shard int, slot long")
    def at(number):
        import pandas as pd

        shard, slot = place(number.to_numpy(), total, shards, key)
        return pd.DataFrame({"shard": shard, "slot": slot})

    return numbered.withColumn("_at", at("row_number")).select("*", "_at.shard", "_at.slot").drop("_at")
