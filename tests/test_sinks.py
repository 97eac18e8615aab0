"""Sink round trips: append twice = 2x, partition overwrite twice = 1x, empty
overwrite = no change, other partitions survive; catalog tables too."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ledgerline.session import fresh_path
from ledgerline.sources import catalog, sinks


def batch(spark, day, n):
    return spark.createDataFrame([(i, f"v{i}", day) for i in range(n)], "id long, v string, d date")


def test_append_twice_stores_twice(spark):
    p = fresh_path(spark, "t_append")
    b = batch(spark, dt.date(2024, 1, 1), 3)
    sinks.append(b, p, "d")
    sinks.append(b, p, "d")
    assert spark.read.parquet(p).count() == 6


def test_partition_overwrite_is_idempotent_and_keeps_other_partitions(spark):
    p = fresh_path(spark, "t_dyn")
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    sinks.overwrite_partitions(batch(spark, d1, 2), p, "d")
    sinks.overwrite_partitions(batch(spark, d2, 3), p, "d")
    sinks.overwrite_partitions(batch(spark, d2, 4), p, "d")           # rerun of d2
    sinks.overwrite_partitions(batch(spark, d2, 4).filter(F.lit(False)), p, "d")   # empty batch
    got = {(r.d, r.c) for r in spark.read.parquet(p).groupBy("d").agg(F.count("*").alias("c")).collect()}
    assert got == {(d1, 2), (d2, 4)}


def test_overwrite_replaces_table(spark):
    p = fresh_path(spark, "t_over")
    sinks.overwrite(batch(spark, dt.date(2024, 1, 1), 5), p, "d")
    sinks.overwrite(batch(spark, dt.date(2024, 1, 2), 2), p, "d")
    assert spark.read.parquet(p).count() == 2


def test_partition_overwrite_requires_partition_column(spark):
    import pytest

    with pytest.raises(ValueError):
        sinks.overwrite_partitions(batch(spark, dt.date(2024, 1, 1), 1).drop("d"),
                                   fresh_path(spark, "x"), "d")


def test_catalog_table_dynamic_overwrite_keeps_other_partition(spark):
    ns = f"t_{uuid.uuid4().hex[:8]}"
    catalog.create_namespace(spark, ns, fresh_path(spark, ns))
    name = f"{ns}.events"
    catalog.create_table(spark, name, "id BIGINT, v STRING, d DATE", "d", fresh_path(spark, "ev"))
    catalog.create_table(spark, name, "id BIGINT, v STRING, d DATE", "d")    # idempotent
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    sinks.append_table(batch(spark, d1, 2), name)
    sinks.append_table(batch(spark, d2, 2), name)
    sinks.overwrite_table_partitions(batch(spark, d2, 5), name)
    sinks.overwrite_table_partitions(batch(spark, d2, 5).filter(F.lit(False)), name)
    got = {(r.d, r.c) for r in spark.table(name).groupBy("d").agg(F.count("*").alias("c")).collect()}
    assert got == {(d1, 2), (d2, 5)}
    # the session setting is switched for the call only
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_ensure_table_creates_once_and_insert_values(spark):
    ns = f"t_{uuid.uuid4().hex[:8]}"
    catalog.create_namespace(spark, ns, fresh_path(spark, ns))
    name = f"{ns}.users"
    sql = catalog.create_table_sql(name, "id BIGINT, name STRING, job STRING", None, fresh_path(spark, "u"))
    assert catalog.ensure_table(spark, name, sql) is True
    assert catalog.ensure_table(spark, name, sql) is False
    catalog.insert_values(spark, name, "VALUES (1, 'a', 'x'), (2, 'b', 'y')")
    assert sorted(r.id for r in spark.table(name).collect()) == [1, 2]
    tables = [r.tableName for r in catalog.list_tables(spark, ns).collect()]
    assert "users" in tables


def test_ensure_table_surfaces_failures(spark):
    import pytest
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        # the table is missing and so is its namespace: the failure surfaces, nothing is swallowed
        catalog.ensure_table(spark, "no_such_namespace_x.t", "CREATE TABLE no_such_namespace_x.t (a INT) USING parquet")


def test_rebalanced_backfill_writes_few_files_per_date(spark):
    from ledgerline.sources import files as file_source

    days = [dt.date(2024, 1, d) for d in range(1, 6)]
    df = (spark.range(5000).repartition(8)
          .select(F.col("id"), F.element_at(F.array(*[F.lit(d) for d in days]),
                                            (F.col("id") % 5 + 1).cast("int")).alias("d")))
    plain, grouped = fresh_path(spark, "bf_plain"), fresh_path(spark, "bf_grouped")
    sinks.overwrite_partitions(df, plain, "d")
    sinks.overwrite_partitions(df, grouped, "d", rebalance=True)
    def files_per_day(p):
        return {r.d: r["count"] for r in file_source.parquet_files(spark, p, "d").groupBy("d").count().collect()}
    assert max(files_per_day(grouped).values()) < max(files_per_day(plain).values())
    assert spark.read.parquet(grouped).count() == spark.read.parquet(plain).count() == 5000
