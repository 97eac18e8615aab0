"""Object/file inventory through the ``binaryFile`` source.

Only ``path``, ``length`` and ``modificationTime`` are selected, so file
contents are never read. Large directory trees are listed by executors in
parallel, but all file statuses end in the driver's file index: for buckets of
many millions of objects pass a stored inventory table instead (as
``plans.maintenance.table_upkeep(files=...)`` takes one).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import bytes_to_kb


def _strip_scheme(path: str) -> str:
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length", "modificationTime")


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """bucket, key, size (bytes and KB with 2 decimals), modified time of every file below ``root``.

    ``bucket`` is the first folder below ``root`` (the root's own name for files
    directly in it); ``key`` the rest of the path. No cap on the number of keys.
    """
    base = _strip_scheme(root)
    rel = F.regexp_extract("path", "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)?" + re.escape(base) + "/(.*)$", 1)
    nested = F.instr(rel, "/") > 0
    return (list_files(spark, root)
            .select(F.when(nested, F.substring_index(rel, "/", 1))
                    .otherwise(F.lit(base.rsplit("/", 1)[-1])).alias("bucket"),
                    F.when(nested, F.regexp_extract(rel, "^[^/]*/(.*)$", 1)).otherwise(rel).alias("key"),
                    F.col("length").alias("size_bytes"),
                    bytes_to_kb("length").alias("size_kb"),
                    F.col("modificationTime").alias("modified_at")))


def table_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Inventory of the given Parquet tables below ``root`` joined with a scan of
    them: key, rows read from the file, and whether the listed size is the one
    that the reader saw."""
    plain = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"
    scans = None
    for name in names:
        seen = (spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
                .groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("seen_bytes"))
                .agg(F.count(F.lit(1)).alias("n_rows")))
        scans = seen if scans is None else scans.unionAll(seen)
    listed = list_files(spark, root).select(F.regexp_replace("path", plain, "").alias("p"), "path", "length")
    keyed = listed.select("p", "length", F.regexp_extract("p", re.escape(_strip_scheme(root)) + "/(.*)$", 1).alias("key"))
    return (keyed.join(scans.withColumn("p", F.regexp_replace("p", plain, "")), "p")
            .select("key", "n_rows", (F.col("length") == F.col("seen_bytes")).alias("sizes_agree")))


def parquet_files(spark: SparkSession, table_path: str, partition_col: str) -> DataFrame:
    """Data files of a Parquet table: partition value (from ``col=value`` in the
    path), path and length."""
    part = F.regexp_extract("path", "/" + re.escape(partition_col) + "=([^/]*)/", 1)
    return (list_files(spark, table_path, "*.parquet")
            .select(part.alias(partition_col), "path", "length"))
