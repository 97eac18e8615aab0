"""One key holding a third of all rows: the joins are arranged so AQE can split it."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import windows
from ledgerline.plans import access

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def executed(df):
    df.collect()          # runs this DataFrame's own adaptive plan to its final form
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_by_time_hot_key_is_split(skew_conf):
    spark = skew_conf
    n = 60000
    df = (spark.range(n)
          .withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997 + 1))
          .withColumn("t", F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 86400))
          .withColumn("v", F.col("id").cast("double")))
    out = windows.first_by_time(df, ["k"], "t", "v", "id", "open_v")
    plan = executed(out)
    assert "SortMergeJoin(skew=true)" in plan
    hot = out.filter(F.col("k") == 0).agg(F.count(F.lit(1)), F.countDistinct("open_v")).first()
    assert hot[0] == n // 3 and hot[1] == 1


def test_access_lookup_hot_principal_is_split(skew_conf):
    spark = skew_conf
    principals = spark.range(3000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("principal_name"))
    roles = (spark.range(30000)
             .select(F.when(F.col("id") % 3 == 0, F.lit("p0"))
                     .otherwise(F.concat(F.lit("p"), (F.col("id") % 2999 + 1).cast("string")))
                     .alias("principal_name"),
                     F.concat(F.lit("r"), (F.col("id") % 5).cast("string")).alias("principal_role")))
    rc = spark.createDataFrame([("r1", "c1")], "principal_role string, catalog_role string")
    lookup = access.role_lookup(principals, roles, rc)
    plan = executed(lookup)
    assert "SortMergeJoin(skew=true)" in plan
    assert lookup.count() == 30000 + principals.join(roles, "principal_name", "left_anti").count()


def test_holdings_hot_user_is_split(skew_conf):
    from ledgerline.plans import marts

    spark = skew_conf
    n = 90000
    holdings = (spark.range(n)
                .select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1999 + 1).alias("user_id"),
                        (F.col("id") % 30011).alias("asset_id"),
                        F.lit(None).cast("string").alias("asset_sub_type"),
                        F.lit(1).cast("decimal(38,8)").alias("quantity"),
                        F.timestamp_seconds(F.lit(1_700_000_000)).alias("record_date")))
    users = spark.range(2000).select(F.col("id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"))
    assets = spark.range(30011).select(F.col("id").alias("asset_id"), F.lit("S").alias("asset_symbol"),
                                       F.lit("n").alias("asset_name"), F.lit("t").alias("asset_type"))
    out = marts.asset_holdings(holdings, users, assets, "2024-01-01")
    plan = executed(out)
    assert "SortMergeJoin(skew=true)" in plan
    total = out.agg(F.sum("total_quantity")).first()[0]
    assert int(total) == n


def test_cashflow_hot_expense_is_split(skew_conf):
    from ledgerline.plans import marts

    spark = skew_conf
    n = 60000
    day = F.timestamp_seconds(F.lit(1_705_320_000))            # 2024-01-15 12:00 UTC
    pay = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 4999 + 1).alias("expense_id"),
        day.alias("payment_date"), F.lit(1).cast("decimal(18,2)").alias("amount"))
    exp = spark.range(5000).select(F.col("id"), (F.col("id") % 700).alias("user_id"))
    users = spark.range(700).select(F.col("id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"))
    empty = spark.createDataFrame([], "user_id long, category_id int, date date, amount decimal(18,2)")
    out = marts.cashflow(users, empty.drop("category_id"), empty, pay, exp, "2024-01-15")
    plan = executed(out)
    assert "SortMergeJoin(skew=true)" in plan
    assert int(out.agg(F.sum("total_fixed_expense")).first()[0]) == n


def _split_joins(plan, key):
    """Sort-merge joins on this key that were split, in the final plan."""
    final = plan.split("+- == Initial Plan ==")[0]
    return [line for line in final.split("\n") if "SortMergeJoin(skew=true)" in line and key in line]


def _tables(spark, hot_customer):
    n = 60000
    cust = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1999 + 1) if hot_customer else F.col("id") % 2000
    orders = spark.range(n).select(
        F.col("id").alias("o_orderkey"), cust.alias("o_custkey"), F.lit("5-LOW").alias("o_orderpriority"),
        F.lit(10.5).alias("o_totalprice"), F.lit("1998-06-03").cast("timestamp_ntz").alias("o_orderdate"), F.lit("O").alias("o_orderstatus"))
    customer = spark.range(2000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), F.col("id")).alias("c_name"),
                                        (F.col("id") % 25).alias("c_nationkey"), F.lit(3.0).alias("c_acctbal"))
    nation = spark.range(25).select(F.col("id").alias("n_nationkey"), F.concat(F.lit("n"), F.col("id")).alias("n_name"))
    frames = {"orders": orders, "customer": customer, "nation": nation}
    return lambda name: frames[name]


def test_hot_customer_is_split_in_the_mapping_joins(skew_conf):
    from ledgerline.operators import aggregates, filters, joins
    from ledgerline.plans import marts
    from ledgerline.sources import finance

    t = _tables(skew_conf, hot_customer=True)
    per = aggregates.sum_by(finance.category_expenses(t), ["user_id", "category_id"], "amount", "s")
    assert _split_joins(executed(per), "c_custkey")
    assert per.count() == 2000
    budget = marts.budget_performance(finance.budgets(t), finance.expense_categories(t), finance.category_expenses(t), "1998-06-15")
    assert _split_joins(executed(budget), "c_custkey")
    spent = aggregates.sum_by(filters.month_to_date(finance.category_expenses(t), "date", "1998-06-15"),
                              ["user_id", "category_id"], "amount", "actual_spent")
    both = joins.join_using(finance.budgets(t).select("user_id", "category_id"), spent, ["user_id", "category_id"], "left")
    assert _split_joins(executed(both), "c_custkey")
    goals = marts.goal_progress(finance.goals(t), finance.users(t), "1998-06-15")
    plan = executed(goals)
    assert len(_split_joins(plan, "")) == 2 and goals.count() == 60000      # mapping join and users join


def test_holdings_hot_asset_is_split(skew_conf):
    from ledgerline.plans import marts

    spark = skew_conf
    n = 90000
    holdings = spark.range(n).select(
        F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1999 + 1).alias("asset_id"),
        F.lit("x").alias("asset_sub_type"), F.lit(1).cast("decimal(38,8)").alias("quantity"),
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("record_date"))
    users = spark.range(n).select("id", F.concat(F.lit("u"), F.col("id")).alias("name"))
    assets = spark.range(2000).select(F.col("id").alias("asset_id"), F.lit("S").alias("asset_symbol"),
                                      F.lit("n").alias("asset_name"), F.lit("t").alias("asset_type"))
    out = marts.asset_holdings(holdings, users, assets, "2024-01-01")
    assert _split_joins(executed(out), "asset_id")
    assert int(out.agg(F.sum("total_quantity")).first()[0]) == n


def test_hot_catalog_role_is_split(skew_conf):
    spark = skew_conf
    principals = spark.range(60000).select(F.concat(F.lit("p"), F.col("id")).alias("principal_name"))
    roles = principals.select("principal_name", F.concat(F.lit("r"), F.pmod(F.xxhash64("principal_name"), F.lit(60))).alias("principal_role"))
    rc = spark.range(60).select(F.concat(F.lit("r"), F.col("id")).alias("principal_role"),
                                F.when(F.col("id") % 3 == 0, F.lit("c0")).otherwise(F.concat(F.lit("c"), F.col("id"))).alias("catalog_role"))
    grants = spark.range(600).select(F.concat(F.lit("c"), F.col("id") % 60).alias("catalog_role"), F.lit("table").alias("grant_type"),
                                     F.lit("READ").alias("privilege"), F.col("id").alias("grant_order"))
    out = access.access_matrix(principals, roles, rc, grants, "m", ordered=False)
    assert _split_joins(executed(out), "granted_role")
    assert out.count() == 60000


def test_unused_price_columns_are_not_read(spark):
    from ledgerline.plans import marts
    from ledgerline.session import fresh_path
    from ledgerline.sources import finance

    path = fresh_path(spark, "prices")
    spark.range(10).selectExpr("id asset_id", "timestamp'2024-01-15 10:00:00' timestamp", "1.5 alis_price", "2.5 satis_price",
                               "'wide' comment", "id other").write.parquet(path)
    src = finance.from_named_tables(lambda name: spark.read.parquet(path) if name == "price_history" else _empty(spark, name))
    df = marts.price_summary(src.price_history, src.assets, "2024-01-15")
    scans = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert scans and all("comment" not in x.split("ReadSchema")[-1] and "other" not in x.split("ReadSchema")[-1] for x in scans)


def _empty(spark, name):
    columns = {"users": "id int, name string", "assets": "asset_id int, asset_symbol string, asset_name string, asset_type string",
               "portfolio_holdings": "user_id int, asset_id int, asset_sub_type string, quantity double, record_date timestamp",
               "portfolio_summary": "user_id int, timestamp timestamp, total_value double",
               "income_transactions": "user_id int, date date, amount double",
               "expense_transactions": "user_id int, category_id int, date date, amount double",
               "fixed_expense_payments": "expense_id int, payment_date timestamp, amount double",
               "fixed_expenses": "id int, user_id int", "budgets": "user_id int, category_id int, amount double",
               "expense_categories": "id int, name string",
               "goals": "id int, user_id int, title string, target_amount double, current_amount double, deadline date, status string"}
    return spark.createDataFrame([], columns[name])
