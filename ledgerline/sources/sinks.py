"""Table writers.

Partition overwrite is only ever done in *dynamic* mode: a plain
``mode("overwrite")`` on a partitioned table would drop every partition not
present in the batch (and an empty batch would empty the table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DYNAMIC = "dynamic"


def _grouped(df: DataFrame, partition_col: str | None, rebalance: bool) -> DataFrame:
    """With ``rebalance`` rows of one partition value are brought together
    before the write (REBALANCE hint: AQE keeps the shuffle partitions near the
    advisory size and splits a hot value), so a batch spanning many dates does
    not leave every task writing one small file into every date folder."""
    return df.hint("rebalance", partition_col) if (rebalance and partition_col) else df


def append(df: DataFrame, path: str, partition_col: str | None = None,
           rebalance: bool = False) -> None:
    """Add the batch; running it twice stores the rows twice."""
    w = _grouped(df, partition_col, rebalance).write.mode("append")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_col: str,
                         rebalance: bool = False) -> None:
    """Replace only the partitions present in the batch; others stay, and an
    empty batch changes nothing. Idempotent for a rerun of the same day."""
    if partition_col not in df.columns:
        raise ValueError(f"batch lacks partition column {partition_col!r}")
    (_grouped(df, partition_col, rebalance).write.mode("overwrite")
     .option("partitionOverwriteMode", DYNAMIC).partitionBy(partition_col).parquet(path))


def overwrite(df: DataFrame, path: str, partition_col: str | None = None) -> None:
    """Replace the whole table."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)


def append_table(df: DataFrame, table: str) -> None:
    """Append to a catalog table by column name."""
    cols = df.sparkSession.table(table).columns
    df.select(*cols).write.insertInto(table, overwrite=False)


def overwrite_table_partitions(df: DataFrame, table: str) -> None:
    """Dynamic partition overwrite of a partitioned catalog table stored as Parquet.

    ``insertInto`` ignores the writer's overwrite mode and would need a session-wide
    setting, which other threads of the session would see. So the batch, cast to the table's types, is
    written to the table's folder with the mode of this write alone; new partitions are then added to the catalog."""
    spark = df.sparkSession
    columns = spark.catalog.listColumns(table)
    parts = [c.name for c in columns if c.isPartition]
    where = [r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Location"]
    if not parts or not where:
        raise ValueError(f"{table} is not a partitioned table with a folder of its own")
    (df.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in columns]).write.mode("overwrite")
     .option("partitionOverwriteMode", DYNAMIC).partitionBy(*parts).parquet(where[0]))
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    spark.catalog.refreshTable(table)
