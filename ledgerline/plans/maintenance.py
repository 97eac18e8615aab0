"""Table upkeep: compaction, snapshot expiry with the files that only expired
snapshots hold, and the orphan-file report.

The original runs these as catalog procedures; here they are user-level
Spark jobs over file listings and snapshot tables. Reports never delete;
``delete_files`` is the separate step for reported files, and refuses a report
that names a live file. Addresses are compared in canonical form
(``functions.addresses``), so a listing may spell them in any way.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.addresses import ANY_SPELLING, canonical, default_filesystem, folder
from ledgerline.plans.compaction import (  # noqa: F401  (compaction is part of upkeep)
    COMPACT_THRESHOLD, MB, compact_table, compaction_bins, compaction_plan, recover,
)
from ledgerline.session import fresh_path
from ledgerline.sources import files as file_source

SNAPSHOT_RETENTION = _dt.timedelta(days=3)
ORPHAN_MIN_AGE = _dt.timedelta(days=1)


def _cutoff(ts_source: DataFrame, ts_col: str, now, age: _dt.timedelta) -> Column:
    """``now - age``; ``now`` None is the clock at query time, else a timestamp
    or a column (e.g. a scalar subquery)."""
    ref = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    ref = ref.cast(ts_source.schema[ts_col].dataType)
    secs = F.lit(f"{age.seconds}.{age.microseconds:06d}").cast("decimal(18,6)")
    return ref - F.make_dt_interval(F.lit(age.days), F.lit(0), F.lit(0), secs)


def snapshot_retention(snapshots: DataFrame, table_col: str = "table_name",
                       id_col: str = "snapshot_id", ts_col: str = "committed_at",
                       retention: _dt.timedelta = SNAPSHOT_RETENTION, now=None) -> DataFrame:
    """Snapshots committed before ``now - retention`` that are not the current
    (latest) snapshot of their table."""
    current = (snapshots.groupBy(table_col)
               .agg(F.max_by(id_col, F.struct(F.col(ts_col), F.col(id_col))).alias(id_col)))
    old = snapshots.filter(F.col(ts_col) < _cutoff(snapshots, ts_col, now, retention))
    return (old.join(current, [table_col, id_col], "left_anti")
            .select(table_col, id_col, ts_col))


def _key(df: DataFrame, col: str) -> Column:
    """What a file is compared by: its canonical address, or the value itself
    where files are named by numbers. Escapes are undone as often as they may
    have been applied: a file taken for a live one by mistake is only kept."""
    if not isinstance(df.schema[col].dataType, T.StringType):
        return df[col]
    return canonical(df[col], ANY_SPELLING, *default_filesystem(df.sparkSession))


def _join_key(df: DataFrame, col: str) -> Column:
    """``_key`` for a join: "" for NULL, which no address has. Of a key that may be NULL a join
    drops the NULLs first and computes the whole address for that a second time."""
    key = _key(df, col)
    return F.coalesce(key, F.lit("")) if isinstance(df.schema[col].dataType, T.StringType) else key


FIRST_FOLDERS = 1000                   # folders of listed files that are looked for before all of them


class ForeignListing(ValueError):
    """A listing that cannot be one of the files it is compared with."""


def _check_same_place(files: DataFrame, refs: DataFrame) -> None:
    """Raise unless some listed file lies in a folder that holds a referenced one.

    Compared with a listing of another place (or spelt in a way that
    ``canonical`` does not know) every file would come out as an orphan."""
    folders = {r[0] for r in files.select(folder(F.col("__key"))).take(FIRST_FOLDERS)}
    if not folders:
        return
    # one shared folder settles it, and usually turns up in the first rows read
    if refs.where(folder(F.col("__ref")).isin(*folders)).take(1):
        return
    there = refs.select(folder(F.col("__ref")).alias("__folder")).distinct()
    shared = files.select(folder(F.col("__key")).alias("__folder")).join(there, "__folder", "left_semi")
    if shared.isEmpty():
        one, other = files.first()["__key"], refs.first()
        raise ForeignListing(f"no listed file is in a folder of a referenced one: {one!r} against "
                             f"{other['__ref'] if other else 'nothing'!r}")


def orphan_files(files: DataFrame, referenced: DataFrame, path_col: str, ref_col: str,
                 modified_col: str, min_age: _dt.timedelta = ORPHAN_MIN_AGE, now=None) -> DataFrame:
    """Files no live snapshot references and older than ``now - min_age``.

    Text addresses are compared in canonical form. Two sides that share no folder
    raise ``ForeignListing`` (also if nothing is referenced at all): the check reads the first rows of both
    listings before the report, and all of them if those share no folder."""
    keyed = files.select("*", _join_key(files, path_col).alias("__key"))
    named = referenced.where(F.col(ref_col).isNotNull()).select(_join_key(referenced, ref_col).alias("__ref"))
    if isinstance(files.schema[path_col].dataType, T.StringType):
        _check_same_place(keyed, named)
    # distinct first: a path referenced by a third of all manifest rows is
    # combined map-side instead of landing whole on one task of the anti join
    refs = named.distinct()
    aged = keyed.filter(F.col(modified_col) < _cutoff(files, modified_col, now, min_age))
    return aged.join(refs, F.col("__key") == F.col("__ref"), "left_anti").drop("__key")


def _held(manifest: DataFrame, expired: DataFrame, table_col: str, id_col: str) -> DataFrame:
    """Manifest rows with the mark whether their snapshot is expired."""
    gone = expired.select(F.col(table_col).alias("__t"), F.col(id_col).alias("__s"), F.lit(True).alias("__gone")).distinct()
    return manifest.join(gone, manifest[table_col].eqNullSafe(F.col("__t")) & manifest[id_col].eqNullSafe(F.col("__s")),
                         "left").withColumn("__gone", F.coalesce("__gone", F.lit(False))).drop("__t", "__s")


def _files_of_expired(manifest: DataFrame, expired: DataFrame, table_col: str, id_col: str, path_col: str,
                      size_col: str | None) -> DataFrame:
    """One row per table and file of an expired snapshot: path, (size,) held_by, and __kept: a live snapshot
    of any table holds the file as well. The manifest is read once, its addresses computed once."""
    # the address after the join, which then moves one text per row
    rows = _held(manifest, expired, table_col, id_col)
    rows = rows.withColumn("__key", _key(rows, path_col))
    gone = lambda c: F.when(F.col("__gone"), F.col(c))
    sizes = [F.max(gone(size_col)).alias(size_col)] if size_col else []
    files = (rows.groupBy(table_col, "__key")
             .agg(F.min(gone(path_col)).alias(path_col), *sizes, F.count_distinct(gone(id_col)).alias("held_by"),
                  F.bool_or("__gone").alias("__gone"), F.bool_or(~F.col("__gone") & F.col("__key").isNotNull()).alias("__live")))
    kept = F.max("__live").over(Window.partitionBy("__key"))
    return files.withColumn("__kept", kept).where("__gone").drop("__key", "__gone", "__live")


def expired_files(manifest: DataFrame, expired: DataFrame, table_col: str = "table_name", id_col: str = "snapshot_id",
                  path_col: str = "path", size_col: str | None = "length") -> DataFrame:
    """Files that only expired snapshots hold: table, path, (size,) snapshots that held them.

    ``manifest``: one row per snapshot and file; ``expired``: rows of
    ``snapshot_retention``. A file that any live snapshot of any table holds, under any
    spelling of its address, stays. Files held by a snapshot that is not in
    ``expired`` count as live, so an unknown snapshot loses nothing.
    """
    return _files_of_expired(manifest, expired, table_col, id_col, path_col, size_col).where("not __kept").drop("__kept")


def live_files(manifest: DataFrame, expired: DataFrame, table_col: str = "table_name", id_col: str = "snapshot_id",
               path_col: str = "path") -> DataFrame:
    """Paths that a snapshot outside ``expired`` holds."""
    return _held(manifest, expired, table_col, id_col).where("not __gone").select(path_col).distinct()


def expiry_summary(snapshots: DataFrame, manifest: DataFrame, expired: DataFrame, table_col: str = "table_name",
                   id_col: str = "snapshot_id", path_col: str = "path", size_col: str = "length") -> DataFrame:
    """Per table: snapshots, expired snapshots, files that go with them and their
    bytes, files that an expired snapshot shares with a live one."""
    every = snapshots.groupBy(table_col).agg(F.count_distinct(id_col).alias("n_snapshots"))
    old = expired.groupBy(table_col).agg(F.count_distinct(id_col).alias("n_expired"))
    touched = (_files_of_expired(manifest, expired, table_col, id_col, path_col, size_col).groupBy(table_col)
               .agg(F.count(F.lit(1)).alias("__touched"), F.count_if(~F.col("__kept")).alias("files_freed"),
                    F.sum(F.when(~F.col("__kept"), F.col(size_col))).cast("bigint").alias("bytes_freed")))
    out = every.join(old, table_col, "left").join(touched, table_col, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select(table_col, "n_snapshots", zero("n_expired").alias("n_expired"), zero("files_freed").alias("files_freed"),
                      zero("bytes_freed").alias("bytes_freed"),
                      (zero("__touched") - zero("files_freed")).alias("files_shared"))


def table_upkeep(spark: SparkSession, path: str, partition_col: str,
                 snapshots: DataFrame | None = None, files: DataFrame | None = None, now=None,
                 threshold: int = COMPACT_THRESHOLD, manifest: DataFrame | None = None) -> dict[str, DataFrame]:
    """The nightly order for one table: compaction, then snapshot expiry, then
    the orphan-file report. Returns the applied compaction plan and the
    reports; nothing else is deleted.

    ``snapshots``: table_name, snapshot_id, committed_at. ``manifest``: table_name,
    snapshot_id, path, length; with it the files that go with the expired snapshots are
    reported. ``files``: path, modified_at of every object stored under the table (e.g. an object-store
    inventory, addresses in any spelling); it is compared with the table's live data files, listed here
    *after* compaction (a file listing is fixed when its DataFrame is made).
    """
    out = {"compaction": compact_table(spark, path, partition_col, threshold)}
    if snapshots is not None:
        out["expired_snapshots"] = snapshot_retention(snapshots, now=now)
        if manifest is not None:
            out["expired_files"] = expired_files(manifest, out["expired_snapshots"])
    if files is not None:
        live = file_source.parquet_files(spark, path, partition_col).select("path")
        out["orphan_files"] = orphan_files(files, live, "path", "path", "modified_at", now=now)
    return out


def _chunks(rows: Iterator, size: int) -> Iterator[list]:
    while chunk := list(islice(rows, size)):
        yield chunk


def delete_files(report: DataFrame, live: DataFrame, path_col: str = "path", live_col: str = "path",
                 threads: int = 16) -> DataFrame:
    """Explicit second step after ``orphan_files`` or ``expired_files``: delete
    the reported files through the file system client, reading the report as a
    stream. Returns path, deleted (False: it was gone already).

    ``live`` lists the files in use *now* (list them again before this step). A report that
    names one of them under any spelling is refused as a whole, before anything is deleted. Pass a written report,
    so that what is deleted is what was looked at."""
    held = report.select(path_col, _join_key(report, path_col).alias("__key")).join(
        live.where(F.col(live_col).isNotNull()).select(_join_key(live, live_col).alias("__key")).distinct(),
        "__key", "left_semi").select(path_col).take(3)
    if held:
        raise ValueError(f"the report names live files, nothing was deleted: {[r[0] for r in held]}")
    spark = report.sparkSession
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    out = fresh_path(spark, "deleted")

    def delete(name: str) -> tuple[str, bool]:
        p = to_path(name)
        return name, bool(p.getFileSystem(conf).delete(p, False))

    schema = "path string, deleted boolean"
    spark.createDataFrame([], schema).write.parquet(out)
    with ThreadPoolExecutor(max_workers=threads) as pool:
        for chunk in _chunks((r[0] for r in report.select(path_col).toLocalIterator()), 10_000):
            spark.createDataFrame(list(pool.map(delete, chunk)), schema).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def remove_orphans(spark: SparkSession, path: str, partition_col: str, files: DataFrame,
                   min_age: _dt.timedelta = ORPHAN_MIN_AGE, now=None) -> DataFrame:
    """The orphan report of a table, written, compared again with the files
    listed after it, and deleted: safe to run unattended. Files outside the
    table's folder are never deleted."""
    inside = canonical(F.lit(path), ANY_SPELLING, *default_filesystem(spark))
    own = files.where(F.startswith(_key(files, "path"), F.concat(inside, F.lit("/"))))
    listed = file_source.parquet_files(spark, path, partition_col).select("path")
    where = fresh_path(spark, "orphans")
    orphan_files(own, listed, "path", "path", "modified_at", min_age, now).write.parquet(where)
    again = file_source.parquet_files(spark, path, partition_col).select("path")
    return delete_files(spark.read.parquet(where), again)


def main(argv=None) -> dict[str, DataFrame]:
    """``python -m ledgerline.plans.maintenance --table PATH --partition-col C
    [--threshold-mb 128] [--snapshots PARQUET] [--manifest PARQUET] [--inventory PARQUET]
    [--delete-orphans] [--out PATH]``: compaction, then the snapshot-expiry and orphan-file
    reports. With ``--out`` each is written whole below it; the row counts are printed.
    ``--delete-orphans`` deletes what the orphan report names, after a second look at the live files."""
    import argparse

    from ledgerline.session import build_session, input_bytes, size_session

    ap = argparse.ArgumentParser(description="Nightly upkeep of one Parquet table.")
    ap.add_argument("--table", required=True)
    ap.add_argument("--partition-col", required=True)
    ap.add_argument("--threshold-mb", type=int, default=COMPACT_THRESHOLD // MB)
    ap.add_argument("--snapshots", help="Parquet: table_name, snapshot_id, committed_at")
    ap.add_argument("--inventory", help="Parquet: path, modified_at of stored objects")
    ap.add_argument("--manifest", help="Parquet: table_name, snapshot_id, path, length of the files each snapshot holds")
    ap.add_argument("--delete-orphans", action="store_true", help="delete the reported orphans (needs --inventory)")
    ap.add_argument("--out", help="folder for the reports: compaction, expired_snapshots, expired_files, orphan_files, deleted")
    args = ap.parse_args(argv)
    if args.delete_orphans and not args.inventory:
        ap.error("--delete-orphans needs --inventory")
    spark = build_session()
    size_session(spark, input_bytes(spark, args.table))
    out = table_upkeep(
        spark, args.table, args.partition_col,
        snapshots=spark.read.parquet(args.snapshots) if args.snapshots else None,
        files=spark.read.parquet(args.inventory) if args.inventory else None,
        manifest=spark.read.parquet(args.manifest) if args.manifest else None,
        threshold=args.threshold_mb * MB)
    root = args.out.rstrip("/") if args.out else fresh_path(spark, "upkeep")
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        out[name] = spark.read.parquet(f"{root}/{name}")
        print(f"{name}: {out[name].count()} rows in {root}/{name}")
    if args.delete_orphans:
        out["deleted"] = remove_orphans(spark, args.table, args.partition_col, spark.read.parquet(args.inventory))
        out["deleted"].write.mode("overwrite").parquet(f"{root}/deleted")
        print(f"deleted: {out['deleted'].where('deleted').count()} files")
    return out


if __name__ == "__main__":
    main()
