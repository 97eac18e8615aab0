"""Counts observed independently at sf0.01 when the reference was surveyed
(SURVEY §5.1) reproduced by the Spark queries."""

from pyspark.sql import functions as F

from conftest import SF_ORACLE
from ledgerline import registry


def q(spark, key):
    return registry.QUERIES[key](spark, SF_ORACLE)


def test_holdings_counts(spark):
    df = q(spark, "asset_holdings_asof")
    assert df.count() == 30471
    assert int(df.agg(F.sum("total_quantity")).first()[0]) == 779419


def test_portfolio_counts(spark):
    df = q(spark, "portfolio_day_stats")
    assert df.count() == 129
    assert df.agg(F.max("sample_count")).first()[0] == 7


def test_cashflow_counts(spark):
    df = q(spark, "user_cashflow")
    r = df.agg(F.count(F.lit(1)).alias("n"),
               F.count(F.when(F.col("total_income") > 0, 1)).alias("inc"),
               F.count(F.when(F.col("total_variable_expense") > 0, 1)).alias("var"),
               F.count(F.when(F.col("total_fixed_expense") > 0, 1)).alias("fix"),
               F.count(F.when((F.col("total_income") > 0) & (F.col("total_variable_expense") > 0), 1)).alias("both"),
               F.count(F.when(F.col("savings_rate_pct").isNull(), 1)).alias("overflow")).first()
    assert (r.n, r.inc, r["var"], r.fix, r.both, r.overflow) == (147, 53, 46, 67, 16, 2)


def test_budget_counts(spark):
    df = q(spark, "budget_performance")
    r = df.agg(F.count(F.lit(1)).alias("n"),
               F.count(F.when(F.col("actual_spent") > 0, 1)).alias("spend"),
               F.count(F.when(F.col("budget_amount") <= 0, 1)).alias("nonpos"),
               F.count(F.when(F.col("utilization_rate_pct").isNull(), 1)).alias("overflow"),
               F.count(F.when(F.col("is_over_budget"), 1)).alias("over")).first()
    assert (r.n, r.spend, r.nonpos, r.overflow, r.over) == (1500, 87, 122, 70, 199)


def test_price_counts(spark):
    df = q(spark, "asset_price_summary")
    assert df.count() == 129
    assert df.filter(F.col("sample_points") > 1).count() == 92


def test_goal_counts(spark):
    got = {r.status: r["count"] for r in q(spark, "goal_progress").groupBy("status").count().collect()}
    assert got == {"completed": 122, "behind_schedule": 7733, "P": 2387, "O": 2357, "F": 2401}


def test_upkeep_counts(spark):
    assert q(spark, "orphan_files").count() == 132
    assert q(spark, "snapshot_retention").count() == 9006
    plan = {r.source: r for r in q(spark, "compaction_plan").collect()}
    assert len(plan) == 20
    src0 = plan["src0"]
    assert (src0.small_files, src0.total_files, src0.small_bytes, src0.target_files) == (42, 50, 72903, 19)
