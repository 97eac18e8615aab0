"""Column helpers: guarded percentage, JSON fallback, dates, KB rounding."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerline import functions as fn
from ledgerline.operators import filters


def test_safe_pct_branches(spark):
    df = spark.createDataFrame([(D("1.00"), D("8.00")), (D("5.00"), D("0.00")), (D("5.00"), None),
                                (D("20.00"), D("1.00")), (D("-1.00"), D("3.00")), (D("0.125"), D("100"))],
                               "n decimal(18,2), d decimal(18,2)")
    got = [r.p for r in df.select(fn.safe_pct("n", "d").alias("p")).collect()]
    assert got == [D("12.50"), D("0.00"), D("0.00"), None, D("-33.33"), D("0.13")]


def test_json_fallback_cases(spark):
    keys = ("catalogRoles", "roles", "entities")
    docs = ['{"catalogRoles": [{"name": "a"}]}', '{"catalogRoles": [], "roles": [{"name": "b"}]}',
            '{"entities": [{"name": "c"}, {"name": "d"}]}', '{}', '{"roles": null, "entities": []}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, j string")
    got = {r.i: r.names for r in df.select("i", fn.first_present_names("j", keys).alias("names")).collect()}
    assert got == {0: ["a"], 1: ["b"], 2: ["c", "d"], 3: [], 4: []}


def test_concat_colon_none(spark):
    df = spark.createDataFrame([(None, "READ"), ("t", None)], "a string, b string")
    assert [r.s for r in df.select(fn.concat_colon("a", "b").alias("s")).collect()] == ["None:READ", "t:None"]


def test_parse_day_rejects_bad_input(spark):
    df = spark.createDataFrame([("2024-02-30",)], "s string")
    with pytest.raises(Exception):
        df.select(fn.parse_day("s")).collect()
    assert fn.dates.as_date("2024-03-15") == dt.date(2024, 3, 15)
    with pytest.raises(ValueError):
        fn.dates.as_date("15.03.2024")


def test_day_filters_on_timestamps(spark):
    ts = dt.datetime
    df = spark.createDataFrame([(1, ts(2024, 3, 14, 23, 59)), (2, ts(2024, 3, 15, 0, 0)),
                                (3, ts(2024, 3, 15, 23, 59, 59)), (4, ts(2024, 3, 16))], "i int, t timestamp")
    day = dt.date(2024, 3, 15)
    ids = lambda d: sorted(r.i for r in d.collect())
    assert ids(filters.on_day(df, "t", day)) == [2, 3]
    assert ids(filters.on_or_before_day(df, "t", day)) == [1, 2, 3]
    assert ids(filters.equals_raw(df, "t", day)) == [2]
    assert ids(filters.month_to_date(df, "t", day)) == [1, 2]


def test_day_filter_reaches_parquet_scan(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = filters.on_day(ev, "ts", "2024-01-15")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_bytes_to_kb(spark):
    df = spark.createDataFrame([(128,), (1024,), (1535,)], "n long")
    assert [r.k for r in df.select(fn.bytes_to_kb("n").alias("k")).collect()] == [0.13, 1.0, 1.5]


def test_rows_with_schema_rejects_nulls(spark):
    from pyspark.sql import types as T

    from ledgerline.sources.tables import rows_with_schema

    schema = T.StructType([T.StructField("ITEM_NAME", T.StringType(), False),
                           T.StructField("QUANTITY", T.IntegerType(), False)])
    ok = spark.createDataFrame([("Laptop", 50), ("Monitor", 150)], "ITEM_NAME string, QUANTITY long")
    assert [tuple(r) for r in rows_with_schema(ok, schema).collect()] == [("Laptop", 50), ("Monitor", 150)]
    bad = spark.createDataFrame([("Mouse", None)], "ITEM_NAME string, QUANTITY long")
    with pytest.raises(Exception):
        rows_with_schema(bad, schema).collect()


def test_jdbc_options_partitioned_and_plain():
    from ledgerline.sources.jdbc import jdbc_options

    plain = jdbc_options("jdbc:postgresql://db/x", "public.users")
    assert plain["dbtable"] == "public.users" and "partitionColumn" not in plain
    part = jdbc_options("jdbc:postgresql://db/x", "public.users", partition_column="id",
                        lower_bound=0, upper_bound=1000, num_partitions=8, user="u")
    assert (part["partitionColumn"], part["lowerBound"], part["upperBound"], part["numPartitions"]) == \
        ("id", "0", "1000", "8")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", partition_column="id")


def test_jdbc_bounds_query_and_split_columns():
    from ledgerline.sources import finance
    from ledgerline.sources.jdbc import bounds_query

    assert bounds_query("public.goals", "id") == "SELECT MIN(id) AS lo, MAX(id) AS hi FROM public.goals"
    assert set(finance.JDBC_SPLIT_COLUMN) == set(finance.SOURCE_TABLE_NAMES)


def test_safe_pct_matches_oracle_emulation_on_many_pairs(spark):
    """Spark's guarded percentage vs the oracle's integer HALF_UP emulation on
    ~500k (numerator, denominator) cent pairs incl. zero/negative denominators
    and overflowing ratios."""
    import duckdb

    from ledgerline.oracle import safe_pct_sql

    n_vals, d_vals = 1001, 501
    grid = (spark.range(n_vals * d_vals)
            .select((F.col("id") % n_vals * 37 - 18500).alias("nc"),
                    (F.col("id") / n_vals).cast("long").alias("dc"))
            .select("nc", (F.col("dc") * 13 - 250).alias("dc"))
            .select("nc", "dc", (F.col("nc") / 100).cast("decimal(18,2)").alias("n"),
                    (F.col("dc") / 100).cast("decimal(18,2)").alias("d")))
    got = grid.select("nc", "dc", fn.safe_pct("n", "d").cast("string").alias("p"))
    spark_rows = {(r.nc, r.dc): r.p for r in got.collect()}
    con = duckdb.connect()
    sql = f"""
        WITH g AS (SELECT nc, dc, CAST(nc AS DECIMAL(18,0)) * 0.01 AS n0, CAST(dc AS DECIMAL(18,0)) * 0.01 AS d0
                   FROM (SELECT (i % {n_vals}) * 37 - 18500 AS nc, (i // {n_vals}) * 13 - 250 AS dc
                         FROM range({n_vals * d_vals}) t(i))),
             h AS (SELECT nc, dc, CAST(n0 AS DECIMAL(18,2)) AS n, CAST(d0 AS DECIMAL(18,2)) AS d FROM g)
        SELECT nc, dc, CAST({safe_pct_sql('n', 'd')} AS VARCHAR) AS p FROM h"""
    duck_rows = {(a, b): c for a, b, c in con.execute(sql).fetchall()}
    assert len(spark_rows) == len(duck_rows) == n_vals * d_vals
    diff = [(k, spark_rows[k], duck_rows[k]) for k in spark_rows if spark_rows[k] != duck_rows[k]]
    assert diff == []
    assert sum(v is None for v in spark_rows.values()) > 0          # overflow cases present


def test_decimal_average_chain_matches_oracle_on_large_groups(spark):
    """avg(decimal(19,4)) -> decimal(18,4) in Spark (rounded at 13, 8, then 4
    decimals) vs the oracle's integer emulation, on groups of up to 30k values
    where a double rounding can differ from a single one."""
    import duckdb

    from ledgerline.oracle import from_units, half_up, pow10, units

    n = 300_000
    df = (spark.range(n)
          .select((F.col("id") % 97).alias("g"),
                  ((F.col("id") * 7919 % 1_000_003) - 500_000).alias("u")))
    got = (df.select("g", (F.col("u") / 10000).cast("decimal(19,4)").alias("x"))
           .groupBy("g").agg(F.avg("x").cast("decimal(18,4)").cast("string").alias("a")))
    spark_rows = {r.g: r.a for r in got.collect()}
    s = "sum(" + units("x", 4) + ")"
    c = "count(x)"
    a4 = half_up(half_up(half_up(f"{s} * {pow10(9)}", c), "100000"), "10000")
    sql = f"""
        WITH t AS (SELECT i % 97 AS g, CAST(CAST((i * 7919 % 1000003) - 500000 AS DECIMAL(19,0)) * 0.0001
                                          AS DECIMAL(19,4)) AS x FROM range({n}) r(i))
        SELECT g, CAST({from_units(a4, 4, 18)} AS VARCHAR) AS a FROM t GROUP BY g"""
    duck_rows = {g: a for g, a in duckdb.connect().execute(sql).fetchall()}
    assert spark_rows == duck_rows
