"""Compaction of a partitioned Parquet table, file by file.

Small files of a partition are packed into bins of about a target size; every
bin of at least two files becomes one new file. Files over the threshold are
neither read nor touched. The work goes in batches of bins, each of which is

1. *staged*: the batch's files alone are read and rewritten below the run's folder, which readers skip;
2. *checked*: rows and an order-free checksum of what was read and what was written;
3. *journalled*: the list of replacements is written, the point of no return;
4. *swapped*: per bin the old files move aside and the new one moves in;
5. *closed*: the journal is marked done, and the run's folder deleted.

A run may end anywhere. The next one (or ``recover``) finishes every batch that
has a journal and discards every batch that has none, so no row is lost or stored
twice. Every step of the replay may be repeated. While a bin is swapped, readers of the partition may
miss its rows or fail on a moved file: plain Parquet folders have no snapshots.
One compaction at a time may run on a table, and no other job may rewrite it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.session import fresh_path
from ledgerline.sources import files as file_source
from ledgerline.sources.storage import children, data_files
from ledgerline.sources.storage import filesystem as _fs
from ledgerline.sources.storage import move as _move
from ledgerline.sources.storage import read_text as _read_text
from ledgerline.sources.storage import write_text as _write_text

MB = 1024 * 1024
COMPACT_THRESHOLD = 128 * MB   # files below this size are rewritten
TARGET_FACTOR = 4              # rewritten files are this many thresholds large
GROUP_FILES, GROUP_BINS = 100_000, 64   # small files of a partition that one task packs, about
BATCH_FILES = 10_000           # files that are replaced under one journal
RUN = "_compact-run-"          # folders that hold a batch; the underscore hides them from readers


def compaction_plan(files: DataFrame, partition_col: str, size_col: str,
                    threshold: int = COMPACT_THRESHOLD, target: int | None = None) -> DataFrame:
    """Per partition: files, files under ``threshold``, their bytes and the
    file count they compact to (``ceil(bytes / target)``). Only partitions with
    more than one small file need work."""
    target = target or threshold
    small = F.col(size_col) < threshold
    return (files.groupBy(partition_col)
            .agg(F.count(F.lit(1)).alias("total_files"),
                 F.count(F.when(small, 1)).alias("small_files"),
                 F.coalesce(F.sum(F.when(small, F.col(size_col))), F.lit(0)).cast("bigint")
                 .alias("small_bytes"))
            .filter(F.col("small_files") > 1)
            .withColumn("target_files", F.ceil(F.col("small_bytes") / F.lit(target)).cast("bigint")))


def compaction_bins(files: DataFrame, partition_col: str, path_col: str, size_col: str,
                    threshold: int = COMPACT_THRESHOLD, target: int | None = None) -> DataFrame:
    """The small files that are worth rewriting, each with its bin: partition,
    path, size, pack, bin, bin_files, bin_bytes.

    Files are lined up by path and cut where the running size passes a multiple of
    ``target``, so a bin exceeds the target by less than one small file. Bins of a
    single file are left out. A partition with very many small files is split into packs by a hash of
    the path; each pack is lined up on its own, so no task holds the whole partition.
    """
    target = target or TARGET_FACTOR * threshold
    small = files.where(F.col(size_col) < threshold).select(partition_col, path_col, size_col)
    packs = (small.groupBy(F.col(partition_col).alias("__part"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(size_col).alias("b")).where("n > 1")
             .select("__part", F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP_FILES),
                                          F.ceil(F.col("b") / (GROUP_BINS * target))).cast("int").alias("packs")))
    dealt = (small.join(packs, small[partition_col].eqNullSafe(F.col("__part")))
             .withColumn("pack", F.pmod(F.xxhash64(path_col), "packs").cast("int")).drop("__part", "packs"))
    line = W.partitionBy(partition_col, "pack").orderBy(path_col).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size_col).over(line), F.lit(0))
    packed = dealt.withColumn("bin", F.floor(before / F.lit(target)).cast("bigint"))
    one = W.partitionBy(partition_col, "pack", "bin")
    return (packed.withColumn("bin_files", F.count(F.lit(1)).over(one))
            .withColumn("bin_bytes", F.sum(size_col).over(one).cast("bigint")).where("bin_files > 1"))


# ---------------------------------------------------------------- journal

def _replay(spark: SparkSession, run: str, threads: int) -> None:
    """Carry out a batch's replacements, whatever part of them was done before."""
    fs, to_path = _fs(spark, run)
    bins = [json.loads(line) for line in _read_text(fs, to_path, f"{run}/journal").splitlines()]

    def swap(entry):
        for k, old in enumerate(entry["old"]):
            _move(fs, to_path(old), to_path(f"{run}/old/{entry['bin']}/{k}"))
        for staged, final in entry["new"]:
            _move(fs, to_path(staged), to_path(final))

    missing = [final for e in bins for staged, final in e["new"]
               if not fs.exists(to_path(staged)) and not fs.exists(to_path(final))]
    if missing:
        raise RuntimeError(f"{run}: neither staged nor in place: {missing[:3]}; the old files are kept below {run}/old")
    with ThreadPoolExecutor(max_workers=threads) as pool:
        for _ in pool.map(swap, bins):
            pass
    _close(fs, to_path, run)


def _close(fs, to_path, run: str) -> None:
    """From here on the batch counts as done; what is left is rubbish."""
    if not fs.rename(to_path(f"{run}/journal"), to_path(f"{run}/done")):
        raise RuntimeError(f"could not close {run}")
    fs.delete(to_path(run), True)


def recover(spark: SparkSession, path: str, threads: int = 8) -> dict[str, int]:
    """Finish the batches of interrupted runs that have a journal, discard those
    that have none: {"finished": n, "discarded": n}."""
    fs, to_path = _fs(spark, path)
    done = {"finished": 0, "discarded": 0}
    for name in children(fs, to_path, path):
        if not name.startswith(RUN):
            continue
        run = f"{path.rstrip('/')}/{name}"
        if fs.exists(to_path(f"{run}/journal")):
            _replay(spark, run, threads)
            done["finished"] += 1
        else:                              # nothing was moved yet, or all of it
            fs.delete(to_path(run), True)
            done["discarded"] += 1
    if any(done.values()):
        spark.catalog.refreshByPath(path)
    return done


# ---------------------------------------------------------------- rewrite

def _free(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _digest(df: DataFrame, columns: list[str]) -> list[Column]:
    """Row count and order-free checksum over the columns."""
    maps = {f.name for f in df.schema.fields if "map<" in f.dataType.simpleString()}      # cannot be hashed directly
    parts = [F.to_json(F.struct(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`") for c in columns]
    return [F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*parts).cast("decimal(20,0)")).alias("checksum")]


def _stage(spark: SparkSession, run: str, bins: list[list[str]]) -> tuple[int, object]:
    """Rewrite every bin into one file below ``run/new``; rows and checksum of
    what was read. The old files are read once, by their paths alone."""
    _, to_path = _fs(spark, run)
    rows = spark.read.option("mergeSchema", "true").parquet(*[p for files in bins for p in files])
    columns = rows.columns
    bin_col, from_col, uri = (_free(name, columns) for name in ("__bin", "__from", "__uri"))
    mapping = spark.createDataFrame([(to_path(p).toUri().toString(), k) for k, files in enumerate(bins) for p in files],
                                    f"`{uri}` string, `{bin_col}` int")
    # file_path is the file's URI, and the mapping has at most BATCH_FILES rows
    all_rows, seen = Observation(), Observation()
    tagged = (rows.withColumn(from_col, F.col("_metadata.file_path")).observe(all_rows, F.count(F.lit(1)).alias("n_rows"))
              .join(F.broadcast(mapping), F.col(from_col) == F.col(uri)).select(*[F.col(f"`{c}`") for c in columns], bin_col))
    (tagged.observe(seen, *_digest(tagged, tagged.columns)).repartitionById(len(bins), F.col(bin_col))
     .write.partitionBy(bin_col).parquet(f"{run}/new"))
    read = seen.get
    if all_rows.get["n_rows"] != read["n_rows"]:
        raise RuntimeError(f"compaction: rows of files that the plan does not name, the table is unchanged (see {run})")
    if not read["n_rows"]:
        return 0, None
    back = spark.read.schema(tagged.schema).parquet(f"{run}/new")
    _compare(read, _written(back, tagged.columns), run)
    return read["n_rows"], bin_col


def _written(back: DataFrame, columns: list[str]):
    return back.agg(*_digest(back, columns)).first().asDict()


def _compare(read: dict, written: dict, run: str) -> None:
    if (read["n_rows"], read["checksum"]) != (written["n_rows"], written["checksum"]):
        raise RuntimeError(f"compaction: the rewritten rows differ, the table is unchanged (see {run})")


def _compact_batch(spark: SparkSession, path: str, bins: list[list[str]], threads: int) -> None:
    run = f"{path.rstrip('/')}/{RUN}{uuid.uuid4().hex[:12]}"
    n_rows, bin_col = _stage(spark, run, bins)
    fs, to_path = _fs(spark, run)
    entries = []
    for k, old in enumerate(bins if n_rows else []):
        staged = f"{run}/new/{bin_col}={k}"
        home = to_path(old[0]).getParent().toString()
        made = [[f"{staged}/{name}", f"{home}/compact-{uuid.uuid4().hex[:8]}-{name}"] for name in data_files(fs, to_path, staged)]
        if made:                           # else only empty files: they stay
            entries.append({"bin": k, "old": old, "new": made})
    if not entries:
        fs.delete(to_path(run), True)
        return
    _write_text(fs, to_path, f"{run}/journal", "\n".join(map(json.dumps, entries)))
    _replay(spark, run, threads)


def _batches(plan: DataFrame, keys: list[str], path_col: str, limit: int) -> Iterator[list[list[str]]]:
    """Bins in batches of at most ``limit`` files (or one bin); the plan is streamed."""
    batch, size = [], 0
    rows = plan.select(*keys, path_col).orderBy(*keys, path_col).toLocalIterator()
    for _, members in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        files = [r[path_col] for r in members]
        if batch and size + len(files) > limit:
            yield batch
            batch, size = [], 0
        batch.append(files)
        size += len(files)
    if batch:
        yield batch


def compact_table(spark: SparkSession, path: str, partition_col: str, threshold: int = COMPACT_THRESHOLD,
                  target: int | None = None, batch_files: int = BATCH_FILES, threads: int = 8) -> DataFrame:
    """Pack the files under ``threshold`` of every partition into files of about
    ``target`` bytes (default: four times the threshold, so that none comes out
    small again and a further run finds nothing). Rows and columns are unchanged;
    files of a batch that lack a column of the others get it as NULL.

    Interrupted earlier runs are finished first. Returns per partition what was
    done: total_files, small_files and small_bytes before, rewritten files,
    new files (bins) and n_files afterwards.
    """
    target = target or TARGET_FACTOR * threshold
    recover(spark, path, threads)
    inv = file_source.parquet_files(spark, path, partition_col)
    # the listing changes once files are replaced: freeze plan and summary
    plan_path, sum_path = fresh_path(spark, "compaction-bins"), fresh_path(spark, "compaction-plan")
    compaction_bins(inv, partition_col, "path", "length", threshold, target).write.parquet(plan_path)
    plan = spark.read.parquet(plan_path)
    rewritten = plan.groupBy(partition_col).agg(F.count(F.lit(1)).alias("rewritten_files"),
                                                F.count_distinct("pack", "bin").alias("new_files"))
    (compaction_plan(inv, partition_col, "length", threshold, target).join(rewritten, partition_col)
     .withColumn("n_files", F.col("total_files") - F.col("rewritten_files") + F.col("new_files"))
     .write.parquet(sum_path))
    for batch in _batches(plan, [partition_col, "pack", "bin"], "path", batch_files):
        _compact_batch(spark, path, batch, threads)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(sum_path)
