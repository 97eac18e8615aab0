"""Asset holdings without rescanning history: sums per day, kept between runs.

The holdings mart adds up all records up to a day. Here the records are stored
in one folder per day (or per month, for tables that are small per day), and a state keeps the sums of every day
by user, asset and sub-type together with a signature of each folder's source files. ``refresh`` recomputes
only the folders whose files changed since (new days, late rows, corrections, deletions); the
mart then adds up the small daily sums.

State folder: ``sums/run=N/record_day=D`` holds the sums that refresh N computed for folder D, ``ledger/v=N``
one row per folder: signature and the run that holds its sums. Nothing is overwritten, and the
ledger is written last, so an interrupted refresh leaves the state as it was. One refresh at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.addresses import canonical
from ledgerline.functions.dates import as_date
from ledgerline.plans import marts
from ledgerline.sources import files as file_source
from ledgerline.sources.storage import children, filesystem

DAY = "record_day"                     # folder of the records: their day, or the first of their month
OWN = "__own_day"
KEYS = ["user_id", "asset_id", "asset_sub_type"]
LEDGER = "day string, n_files long, bytes long, signature long, run int, n_sums long"


def store_by_day(holdings: DataFrame, path: str, mode: str = "append", grain: str = "day") -> None:
    """Records into the folder of their day or month (``mode`` overwrite replaces the folders
    of the batch). Records without a date belong to no day up to any date and are left out."""
    day = F.to_date("record_date") if grain == "day" else F.trunc("record_date", grain)
    (holdings.where(F.col("record_date").isNotNull()).withColumn(DAY, day).hint("rebalance", DAY)
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path))


def day_signatures(spark: SparkSession, source: str) -> DataFrame:
    """One row per stored day: files, bytes and a signature over name, size and
    time of every file, which changes with any of them."""
    part = F.regexp_extract("path", f"/{DAY}=([^/]*)/", 1)
    listed = file_source.list_files(spark, source, "*.parquet").select(part.alias("day"), canonical("path").alias("p"), "length", "modificationTime")
    return listed.groupBy("day").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"),
        F.bit_xor(F.xxhash64("p", "length", "modificationTime")).alias("signature"))


def _version(spark: SparkSession, state: str) -> int:
    """Newest complete ledger, 0 for none."""
    fs, to_path = filesystem(spark, state)
    found = [int(n[2:]) for n in children(fs, to_path, f"{state}/ledger") if n.startswith("v=")]
    return max((v for v in found if fs.exists(to_path(f"{state}/ledger/v={v}/_SUCCESS"))), default=0)


def ledger(spark: SparkSession, state: str) -> DataFrame:
    """The state's days with the run that holds the sums of each."""
    state = state.rstrip("/")
    version = _version(spark, state)
    if not version:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{state}/ledger/v={version}")


def changes(now: dict[str, tuple], before: dict[str, tuple]) -> dict[str, str]:
    """Days that differ between two sets of signatures: new, changed or removed."""
    return ({d: "removed" for d in before.keys() - now.keys()} | {d: "new" for d in now.keys() - before.keys()}
            | {d: "changed" for d in now.keys() & before.keys() if now[d] != before[d]})


def refresh(spark: SparkSession, source: str, state: str) -> dict[str, str]:
    """Bring the state up to date with the stored records; day -> change. Only
    the folders of new and changed days are read."""
    source, state = source.rstrip("/"), state.rstrip("/")
    known = {r.day: r for r in ledger(spark, state).collect()}                  # one row per day
    seen = [tuple(r) for r in day_signatures(spark, source).select("day", "n_files", "bytes", "signature").collect()]
    todo = changes({s[0]: s for s in seen}, {d: (d, r.n_files, r.bytes, r.signature) for d, r in known.items()})
    if not todo:
        return {}
    run = _version(spark, state) + 1
    days = sorted(d for d, c in todo.items() if c != "removed")
    sums = f"{state}/sums/run={run}"
    counts = {}
    if days:
        rows = spark.read.option("basePath", source).option("mergeSchema", "true").parquet(*[f"{source}/{DAY}={d}" for d in days])
        # a retry of an interrupted refresh writes the same run again
        (rows.groupBy(DAY, F.to_date("record_date").alias(OWN), *KEYS).agg(F.sum("quantity").alias("quantity")).hint("rebalance", DAY)
         .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(DAY).parquet(sums))
        fs, to_path = filesystem(spark, state)
        if [n for n in children(fs, to_path, sums) if n.startswith(f"{DAY}=")]:
            found = spark.read.parquet(sums).groupBy(F.col(DAY).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
            counts = {r.day: r.n for r in found.collect()}
    rows = [(*s, run, counts.get(s[0], 0)) if s[0] in todo else (*s, known[s[0]].run, known[s[0]].n_sums) for s in seen]
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{state}/ledger/v={run}")
    return todo


def daily_sums(spark: SparkSession, state: str, as_of) -> DataFrame | None:
    """Sums of the days up to ``as_of``, None if there are none. Later days are not read."""
    state = state.rstrip("/")
    day = as_date(as_of)
    wanted = ledger(spark, state).where((F.col("day") <= str(day)) & (F.col("n_sums") > 0)).select("run", "day").collect()
    if not wanted:
        return None
    folders = sorted(f"{state}/sums/run={r.run}/{DAY}={r.day}" for r in wanted)
    return spark.read.option("basePath", f"{state}/sums").parquet(*folders).where(F.col(OWN) <= F.lit(day))


def asset_holdings(spark: SparkSession, state: str, users: DataFrame, assets: DataFrame, as_of, run_ts=None) -> DataFrame:
    """The holdings mart of ``as_of`` from the state; equal to
    ``marts.asset_holdings`` over all stored records."""
    sums = daily_sums(spark, state, as_of)
    if sums is None:
        sums = spark.createDataFrame([], "user_id long, asset_id long, asset_sub_type string, quantity decimal(38,8)")
    per_key = sums.groupBy(*KEYS).agg(F.sum("quantity").alias("quantity"))
    return marts.holdings_from_sums(per_key, users, assets, as_of, run_ts)


def vacuum(spark: SparkSession, state: str, keep: int = 2) -> int:
    """Delete daily sums that none of the last ``keep`` ledgers refers to, and older ledgers; folders deleted."""
    state = state.rstrip("/")
    fs, to_path = filesystem(spark, state)
    newest, used, gone = _version(spark, state), set(), 0
    for v in range(max(1, newest - keep + 1), newest + 1):
        if fs.exists(to_path(f"{state}/ledger/v={v}/_SUCCESS")):
            used |= {(r.run, r.day) for r in spark.read.schema(LEDGER).parquet(f"{state}/ledger/v={v}").select("run", "day").collect()}
    for name in children(fs, to_path, f"{state}/sums"):
        run = int(name[4:]) if name.startswith("run=") else newest + 1
        if run > newest:                     # a refresh that is not finished
            continue
        for day in children(fs, to_path, f"{state}/sums/{name}"):
            if day.startswith(f"{DAY}=") and (run, day[len(DAY) + 1:]) not in used:
                fs.delete(to_path(f"{state}/sums/{name}/{day}"), True)
                gone += 1
    for name in children(fs, to_path, f"{state}/ledger"):
        if name.startswith("v=") and int(name[2:]) <= newest - keep:
            fs.delete(to_path(f"{state}/ledger/{name}"), True)
    return gone
