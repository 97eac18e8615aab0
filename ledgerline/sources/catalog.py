"""Namespaces and tables in the session catalog (Parquet tables at explicit locations)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def create_namespace(spark: SparkSession, namespace: str, location: str | None = None) -> None:
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}{loc}")


def create_table_sql(name: str, columns_ddl: str, partition_col: str | None = None,
                     location: str | None = None) -> str:
    part = f" PARTITIONED BY ({partition_col})" if partition_col else ""
    loc = f" LOCATION '{location}'" if location else ""
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns_ddl}) USING parquet{part}{loc}"


def create_table(spark: SparkSession, name: str, columns_ddl: str, partition_col: str | None = None,
                 location: str | None = None) -> None:
    """Idempotent typed (optionally partitioned) table."""
    spark.sql(create_table_sql(name, columns_ddl, partition_col, location))


def create_bucketed_table(spark: SparkSession, name: str, columns_ddl: str, bucket_cols: list[str], buckets: int,
                          location: str | None = None, sort_cols: list[str] | None = None) -> None:
    """Idempotent table whose rows are stored by a hash of ``bucket_cols``.

    Tables bucketed alike join and aggregate on those columns without an
    exchange: the stored files already are the shuffle partitions. Worth it for
    tables that are written once and joined on one key again and again. Choose ``buckets`` so that one of
    them fits a task; one hot key still is one bucket, so join hot tables the plain way.
    """
    if buckets < 1 or not bucket_cols:
        raise ValueError("a bucketed table needs columns and at least one bucket")
    quote = lambda cols: ", ".join(f"`{c}`" for c in cols)
    by = f" SORTED BY ({quote(sort_cols)})" if sort_cols else ""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns_ddl}) USING parquet "
              f"CLUSTERED BY ({quote(bucket_cols)}){by} INTO {buckets} BUCKETS{loc}")


def write_bucketed(df: DataFrame, table: str) -> None:
    """Append to a bucketed table with one file per bucket: the rows are dealt
    to the buckets first, else every task would write a file into each."""
    spark = df.sparkSession
    spec = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    columns = [c.strip(" `") for c in spec["Bucket Columns"].strip("[]").split(",")]
    dealt = df.select(*spark.table(table).columns).repartition(int(spec["Num Buckets"]), *columns)
    dealt.write.insertInto(table)


def register_external(spark: SparkSession, name: str, path: str) -> None:
    """Catalog entry over existing Parquet data (no copy)."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{path}'")


def ensure_table(spark: SparkSession, name: str, create_sql: str) -> bool:
    """Create the table when it does not exist; True if it was created.

    The table is probed by resolving it; only a missing table leads to
    creation. Any other failure (unreadable metadata, permissions) is raised,
    and nothing is ever dropped.
    """
    try:
        spark.table(name).schema
        return False
    except AnalysisException as e:
        condition = e.getCondition() if hasattr(e, "getCondition") else None
        if condition != "TABLE_OR_VIEW_NOT_FOUND" and "TABLE_OR_VIEW_NOT_FOUND" not in str(e):
            raise
    spark.sql(create_sql)
    return True


def list_namespaces(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW NAMESPACES")


def list_tables(spark: SparkSession, namespace: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {namespace}")


def insert_values(spark: SparkSession, table: str, rows_sql: str) -> None:
    """``INSERT INTO table <rows_sql>`` where rows_sql is ``VALUES (...), ...`` or a query."""
    spark.sql(f"INSERT INTO {table} {rows_sql}")


def register_partitioned(spark: SparkSession, name: str, columns_ddl: str, partition_col: str,
                         path: str) -> None:
    """Catalog entry over an existing partitioned Parquet folder; the partition
    folders already on storage are added to the catalog."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns_ddl}) USING parquet "
              f"PARTITIONED BY ({partition_col}) LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
