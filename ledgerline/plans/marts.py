"""The six dated finance marts as pure DataFrame functions.

Shape of the plans: filter the fact table to the report period (day, month to
date, or everything up to the day; pushed to the scan as a range), aggregate
it by its own keys first (map-side combine), and only then join the
dimensions, so the joins see one row per key instead of every fact row. Goal
progress has no aggregation and is a single join. Output columns follow the
mart DDL in ``plans.schemas``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import as_date
from ledgerline.functions.money import MONEY, PORTFOLIO, PRICE, QUANTITY, safe_pct, spark_avg, times
from ledgerline.operators import filters
from ledgerline.plans.schemas import MART_COLUMNS


def audit_time(run_ts=None):
    """Audit timestamp: ``run_ts`` pins it, else the query's current time."""
    return (F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")).alias("created_at")


def report_date(name: str, day):
    return F.lit(as_date(day)).cast("date").alias(name)


def stamp(df: DataFrame, date_col: str, day, run_ts=None) -> DataFrame:
    """Constant report date plus audit time."""
    return df.select("*", report_date(date_col, day), audit_time(run_ts))


def user_names(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))


def asset_holdings(holdings: DataFrame, users: DataFrame, assets: DataFrame, as_of,
                   run_ts=None) -> DataFrame:
    """Cumulative quantity per user x asset x sub-type over all records up to ``as_of``.

    Unknown users/assets drop out (inner joins); a NULL sub-type is its own group.
    """
    per_key = (filters.on_or_before_day(holdings, "record_date", as_date(as_of))
               .groupBy("user_id", "asset_id", "asset_sub_type")
               .agg(F.sum("quantity").alias("quantity")))
    return holdings_from_sums(per_key, users, assets, as_of, run_ts)


def holdings_from_sums(per_key: DataFrame, users: DataFrame, assets: DataFrame, as_of, run_ts=None) -> DataFrame:
    """The holdings mart from one quantity per user, asset and sub-type."""
    d = as_date(as_of)
    # duplicate dimension rows multiply exactly as a join-first plan would: they are counted
    # here, where they are few, so that the wide joined rows need no grouping of their own
    u = user_names(users).groupBy("user_id", "user_name").agg(F.count(F.lit(1)).alias("__users"))
    a = (assets.groupBy("asset_id", "asset_symbol", "asset_name", "asset_type")
         .agg(F.count(F.lit(1)).alias("__assets")))
    quantity = times("quantity", F.col("__users") * F.col("__assets")).cast(QUANTITY)
    out = per_key.join(u, "user_id").join(a, "asset_id").withColumn("total_quantity", quantity)
    return stamp(out, "snapshot_date", d, run_ts).select(*MART_COLUMNS["daily_user_asset_holdings"])


def portfolio_stats(summary: DataFrame, users: DataFrame, day, run_ts=None) -> DataFrame:
    """avg/min/max and count of non-NULL portfolio values per user on ``day``."""
    d = as_date(day)
    per_user = (filters.on_day(summary, "timestamp", d)
                .groupBy("user_id")
                .agg(F.sum("total_value").alias("s"), F.count("total_value").alias("c"),
                     F.min("total_value").alias("lo"), F.max("total_value").alias("hi")))
    out = (per_user.join(user_names(users), "user_id")
           .groupBy("user_id", "user_name")
           .agg(F.sum("s").alias("s"), F.sum("c").alias("c"),
                F.min("lo").alias("lo"), F.max("hi").alias("hi"))
           .select("user_id", "user_name",
                   spark_avg("s", "c").cast(PORTFOLIO).alias("avg_portfolio_value"),
                   F.col("lo").cast(PORTFOLIO).alias("min_portfolio_value"),
                   F.col("hi").cast(PORTFOLIO).alias("max_portfolio_value"),
                   F.col("c").alias("sample_count")))
    return stamp(out, "snapshot_date", d, run_ts).select(*MART_COLUMNS["daily_user_portfolio_stats"])


def cashflow(users: DataFrame, income: DataFrame, expense: DataFrame, fixed_payments: DataFrame,
             fixed_expenses: DataFrame, day, run_ts=None) -> DataFrame:
    """Income, variable and fixed expense, net and savings rate per user on ``day``.

    Users with no positive amount that day are absent. Instead of left-joining
    every user with three aggregates, the day's rows of the three sources are
    unioned and summed per user in one aggregation; only active users meet
    the users table.
    """
    d = as_date(day)
    amt = income.schema["amount"].dataType
    none = F.lit(None).cast(amt)
    inc = filters.equals_raw(income, "date", d).select(
        "user_id", F.col("amount").alias("inc"), none.alias("exp"), none.alias("fix"))
    exp = filters.equals_raw(expense, "date", d).select(
        "user_id", none.alias("inc"), F.col("amount").alias("exp"), none.alias("fix"))
    owners = fixed_expenses.select(F.col("id").alias("expense_id"), "user_id")
    fix = (filters.on_day(fixed_payments, "payment_date", d)
           .join(owners, "expense_id", "inner")
           .select("user_id", none.alias("inc"), none.alias("exp"), F.col("amount").alias("fix")))
    per_user = (inc.unionByName(exp).unionByName(fix)
                .groupBy("user_id")
                .agg(F.sum("inc").alias("inc_amt"), F.sum("exp").alias("exp_amt"),
                     F.sum("fix").alias("fix_amt"))
                .na.fill(0, subset=["inc_amt", "exp_amt", "fix_amt"]))
    active = filters.any_positive(per_user, ["inc_amt", "exp_amt", "fix_amt"])
    inc_amt, exp_amt, fix_amt = F.col("inc_amt"), F.col("exp_amt"), F.col("fix_amt")
    net = (inc_amt - (exp_amt + fix_amt)).cast(MONEY)
    return active.join(user_names(users), "user_id").select(
        report_date("summary_date", d), "user_id", "user_name",
        inc_amt.cast(MONEY).alias("total_income"),
        exp_amt.cast(MONEY).alias("total_variable_expense"),
        fix_amt.cast(MONEY).alias("total_fixed_expense"),
        net.alias("net_cashflow"),
        safe_pct(net, inc_amt).alias("savings_rate_pct"),     # ratio of the rounded net
        audit_time(run_ts))


def budget_performance(budgets: DataFrame, categories: DataFrame, expense: DataFrame, day,
                       run_ts=None) -> DataFrame:
    """Month-to-date spend per user x category against each budget row.

    Duplicate budgets each get the full spend; spend without a budget or with
    an unknown category is dropped; a NULL budget gives 0.00 % utilisation.
    """
    d = as_date(day)
    spent = (filters.month_to_date(expense, "date", d)
             .groupBy("user_id", "category_id")
             .agg(F.sum("amount").alias("actual_spent")))
    b = budgets.select("user_id", "category_id", F.col("amount").alias("budget_amount"))
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    budget = F.col("budget_amount").cast(MONEY)
    used = F.coalesce(F.col("actual_spent"), F.lit(0)).cast(MONEY)
    return (b.join(cats, "category_id", "inner")
            .join(spent, ["user_id", "category_id"], "left")
            .select(report_date("budget_month", d.replace(day=1)), "user_id", "category_id",
                    "category_name", budget.alias("budget_amount"), used.alias("actual_spent"),
                    (budget - used).cast(MONEY).alias("remaining_amount"),
                    safe_pct(used, budget).alias("utilization_rate_pct"),
                    (used > budget).alias("is_over_budget"),
                    audit_time(run_ts)))


def price_summary(prices: DataFrame, assets: DataFrame, day, run_ts=None) -> DataFrame:
    """Open/close/min/max buy price, average spread and samples per asset on ``day``.

    Open and close are the buy price of the first and last sample in
    (timestamp, price_id) order, taken inside the same grouped aggregation as
    the other measures (no window sort). A NULL first price gives a NULL open;
    the spread average skips samples missing either price.
    """
    d = as_date(day)
    order = F.struct(F.col("timestamp"), F.col("price_id"))
    per_asset = (filters.on_day(prices, "timestamp", d)
                 .groupBy("asset_id")
                 .agg(F.min_by("buy_price", order).cast(PRICE).alias("open_buy_price"),
                      F.max_by("buy_price", order).cast(PRICE).alias("close_buy_price"),
                      F.min("buy_price").cast(PRICE).alias("min_buy_price"),
                      F.max("buy_price").cast(PRICE).alias("max_buy_price"),
                      F.avg(F.col("sell_price") - F.col("buy_price")).cast(PRICE).alias("avg_spread"),
                      F.count("timestamp").alias("sample_points")))
    a = assets.select("asset_id", "asset_symbol", "asset_type")
    out = per_asset.join(a, "asset_id", "inner")
    return stamp(out, "price_date", d, run_ts).select(*MART_COLUMNS["daily_asset_price_summary"])


def goal_status(current, target, days_remaining, status):
    """completed if reached; else behind_schedule if overdue; else the stored status."""
    return (F.when(current >= target, F.lit("completed"))
            .when(days_remaining < 0, F.lit("behind_schedule"))
            .otherwise(status))


def goal_progress(goals: DataFrame, users: DataFrame, day, run_ts=None) -> DataFrame:
    """Completion rate, days to deadline and derived status per goal."""
    d = as_date(day)
    target = F.col("target_amount").cast(MONEY)
    current = F.coalesce(F.col("current_amount"), F.lit(0)).cast(MONEY)
    deadline = F.col("deadline").cast("date")
    days_left = F.datediff(deadline, F.lit(d))
    return goals.join(user_names(users), "user_id", "inner").select(
        report_date("snapshot_date", d), F.col("id").alias("goal_id"), "user_id", "user_name",
        F.col("title").alias("goal_title"), target.alias("target_amount"),
        current.alias("current_amount"), safe_pct(current, target).alias("completion_rate_pct"),
        deadline.alias("deadline"), days_left.alias("days_remaining"),
        goal_status(current, target, days_left, F.col("status")).alias("status"),
        audit_time(run_ts))


def previous_day(day) -> _dt.date:
    return as_date(day) - _dt.timedelta(days=1)
