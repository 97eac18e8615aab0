"""Hand-written edge rows for each mart (NULLs, zero denominators, overflow, ties)."""

import datetime as dt
from decimal import Decimal as D
from decimal import localcontext

from pyspark.sql import functions as F

from ledgerline.plans import marts

DAY = dt.date(2024, 3, 15)
TS = dt.datetime


def users(spark):
    return spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cid"), (4, "dee")], "id long, name string")


def test_holdings_asof_drops_future_and_unknown_and_groups_null(spark):
    assets = spark.createDataFrame([(10, "AAA", "Alpha", "stock")],
                                   "asset_id long, asset_symbol string, asset_name string, asset_type string")
    h = spark.createDataFrame([
        (1, 10, None, D("1.5"), TS(2024, 3, 15, 23, 59)),
        (1, 10, None, D("2.25"), TS(2024, 1, 1)),
        (1, 10, "x", D("1"), TS(2024, 3, 16, 0, 0)),       # day after: not counted
        (9, 10, None, D("5"), TS(2024, 3, 1)),              # unknown user
    ], "user_id long, asset_id long, asset_sub_type string, quantity decimal(38,8), record_date timestamp")
    out = marts.asset_holdings(h, users(spark), assets, DAY).collect()
    assert len(out) == 1
    r = out[0]
    assert r.asset_sub_type is None and r.total_quantity == D("3.75") and r.user_name == "ann"
    assert r.snapshot_date == DAY


def test_holdings_of_duplicate_dimension_rows_without_a_wide_regroup(spark):
    twice = spark.createDataFrame([(1, "ann"), (1, "ann"), (1, "ann"), (1, None), (1, None), (2, "bob")], "id long, name string")
    assets = spark.createDataFrame([(10, "AAA", "Alpha", "stock"), (10, "AAA", "Alpha", "stock"), (10, "AAA", None, "stock"), (11, "B", "Beta", "fund")],
                                   "asset_id long, asset_symbol string, asset_name string, asset_type string")
    most = D("9" * 27 + ".99999999")
    h = spark.createDataFrame([(1, 10, None, most, DAY), (1, 11, None, D("-0.00000001"), DAY), (2, 10, "x", None, DAY), (2, 11, "x", D("1"), DAY)],
                              "user_id long, asset_id long, asset_sub_type string, quantity decimal(38,8), record_date date")
    out = marts.asset_holdings(h, twice, assets, DAY)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert [p for p in plan if "RepartitionByExpression" in p or "Aggregate [" in p and "user_name" in p and "asset_name" in p] == []
    got = {(r.user_name, r.asset_id, r.asset_name): r.total_quantity for r in out.collect()}
    with localcontext(prec=60):
        want = {("ann", 10, "Alpha"): 6 * most, ("ann", 10, None): 3 * most, (None, 10, "Alpha"): 4 * most, (None, 10, None): 2 * most,
                ("ann", 11, "Beta"): D("-0.00000003"), (None, 11, "Beta"): D("-0.00000002"), ("bob", 10, "Alpha"): None, ("bob", 10, None): None, ("bob", 11, "Beta"): D(1)}
    assert got == want


def test_portfolio_only_null_values(spark):
    s = spark.createDataFrame([(1, TS(2024, 3, 15, 9), None), (2, TS(2024, 3, 15, 9), D("10.00005")),
                               (2, TS(2024, 3, 15, 10), D("11")), (2, TS(2024, 3, 14, 10), D("99"))],
                              "user_id long, timestamp timestamp, total_value decimal(38,4)")
    rows = {r.user_id: r for r in marts.portfolio_stats(s, users(spark), DAY).collect()}
    assert rows[1].avg_portfolio_value is None and rows[1].sample_count == 0
    assert rows[1].min_portfolio_value is None and rows[1].max_portfolio_value is None
    assert rows[2].sample_count == 2 and rows[2].max_portfolio_value == D("11.0000")
    assert rows[2].avg_portfolio_value == D("10.5001")   # 10.50005 -> HALF_UP


def test_portfolio_avg_matches_spark_avg(spark):
    vals = [D(f"{i * 7919 % 100003}.{i * 31 % 10000:04d}") for i in range(1, 400)]
    s = spark.createDataFrame([(1 + i % 3, TS(2024, 3, 15, 1), v) for i, v in enumerate(vals)],
                              "user_id long, timestamp timestamp, total_value decimal(38,4)")
    ours = {r.user_id: r.avg_portfolio_value for r in marts.portfolio_stats(s, users(spark), DAY).collect()}
    ref = {r.user_id: r.a for r in s.groupBy("user_id").agg(F.avg("total_value").cast("decimal(38,4)").alias("a")).collect()}
    assert ours == ref


def _cashflow(spark, inc, exp, fix_pay, fix_exp):
    inc_df = spark.createDataFrame(inc, "user_id long, date date, amount decimal(18,2)")
    exp_df = spark.createDataFrame(exp, "user_id long, category_id int, date date, amount decimal(18,2)")
    fp = spark.createDataFrame(fix_pay, "expense_id long, payment_date timestamp, amount decimal(18,2)")
    fe = spark.createDataFrame(fix_exp, "id long, user_id long")
    return {r.user_id: r for r in marts.cashflow(users(spark), inc_df, exp_df, fp, fe, DAY).collect()}


def test_cashflow_edges(spark):
    rows = _cashflow(
        spark,
        inc=[(2, DAY, D("-5.00")), (3, DAY, D("0.00")), (4, DAY, D("1.00"))],
        exp=[(3, None, DAY, D("7.00")), (4, None, DAY, D("20.00")), (1, None, DAY + dt.timedelta(days=1), D("3"))],
        fix_pay=[(100, TS(2024, 3, 15, 12), D("2.50"))],
        fix_exp=[(100, 3)],
    )
    assert 1 not in rows            # activity only on another day
    assert 2 not in rows            # only negative amounts
    assert rows[3].savings_rate_pct == D("0.00") and rows[3].total_fixed_expense == D("2.50")
    assert rows[3].net_cashflow == D("-9.50")
    assert rows[4].net_cashflow == D("-19.00") and rows[4].savings_rate_pct is None   # -1900 % overflows


def test_budget_edges(spark):
    budgets = spark.createDataFrame([
        (1, 1, D("0.00")), (2, 1, None), (3, 1, D("100.00")), (3, 1, D("100.00")), (4, 99, D("5.00")),
        (1, 2, D("10.00")),
    ], "user_id long, category_id int, amount decimal(18,2)")
    cats = spark.createDataFrame([(1, "food"), (2, "rent")], "id int, name string")
    exp = spark.createDataFrame([
        (3, 1, dt.date(2024, 3, 1), D("30.00")), (3, 1, DAY, D("20.00")),
        (3, 1, DAY + dt.timedelta(days=1), D("1000.00")), (3, 1, dt.date(2024, 2, 29), D("1000.00")),
        (1, 2, DAY, D("1000.00")),
    ], "user_id long, category_id int, date date, amount decimal(18,2)")
    rows = marts.budget_performance(budgets, cats, exp, DAY).collect()
    assert all(r.budget_month == dt.date(2024, 3, 1) for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.user_id, r.category_id), []).append(r)
    assert (4, 99) not in by                                   # unknown category dropped
    assert by[(1, 1)][0].utilization_rate_pct == D("0.00")     # budget 0
    assert by[(2, 1)][0].utilization_rate_pct == D("0.00") and by[(2, 1)][0].is_over_budget is None
    assert len(by[(3, 1)]) == 2 and all(r.actual_spent == D("50.00") for r in by[(3, 1)])
    assert by[(3, 1)][0].utilization_rate_pct == D("50.00") and by[(3, 1)][0].remaining_amount == D("50.00")
    assert by[(1, 2)][0].utilization_rate_pct is None and by[(1, 2)][0].is_over_budget is True  # 10000 %


def test_price_summary_edges(spark):
    assets = spark.createDataFrame([(1, "A", "x"), (2, "B", "y"), (3, "C", "z")],
                                   "asset_id long, asset_symbol string, asset_type string")
    t9 = TS(2024, 3, 15, 9)
    prices = spark.createDataFrame([
        (1, 1, t9, None, D("5")), (2, 1, TS(2024, 3, 15, 10), D("10"), D("12")),
        (3, 1, TS(2024, 3, 15, 11), D("8"), None),
        (5, 2, t9, D("7"), D("8")), (4, 2, t9, D("6"), D("8")),           # tied timestamps
        (6, 3, TS(2024, 3, 16, 9), D("1"), D("1")),                        # other day only
    ], "price_id long, asset_id long, timestamp timestamp, buy_price decimal(18,4), sell_price decimal(18,4)")
    rows = {r.asset_id: r for r in marts.price_summary(prices, assets, DAY).collect()}
    assert 3 not in rows
    a = rows[1]
    assert a.open_buy_price is None and a.close_buy_price == D("8.0000")
    assert a.min_buy_price == D("8.0000") and a.max_buy_price == D("10.0000")
    assert a.avg_spread == D("2.0000") and a.sample_points == 3
    b = rows[2]
    assert b.open_buy_price == D("6.0000") and b.close_buy_price == D("7.0000")   # tie broken by id


def test_goal_edges(spark):
    goals = spark.createDataFrame([
        (1, 1, "a", D("100"), None, dt.date(2024, 4, 1), "active"),
        (2, 1, "b", D("0"), D("5"), dt.date(2024, 4, 1), "active"),
        (3, 1, "c", D("100"), D("10"), None, "paused"),
        (4, 1, "d", D("100"), D("100"), dt.date(2024, 1, 1), "active"),
        (5, 1, "e", D("100"), D("10"), dt.date(2024, 3, 1), "active"),
        (6, 1, "f", None, D("10"), dt.date(2024, 4, 1), "active"),
        (7, 9, "g", D("1"), D("1"), dt.date(2024, 4, 1), "active"),          # unknown user
    ], "id long, user_id long, title string, target_amount decimal(18,2), current_amount decimal(18,2), "
       "deadline date, status string")
    rows = {r.goal_id: r for r in marts.goal_progress(goals, users(spark), DAY).collect()}
    assert 7 not in rows
    assert rows[1].current_amount == D("0.00") and rows[1].completion_rate_pct == D("0.00")
    assert rows[2].completion_rate_pct == D("0.00") and rows[2].status == "completed"
    assert rows[3].days_remaining is None and rows[3].status == "paused"
    assert rows[4].status == "completed" and rows[4].days_remaining < 0
    assert rows[5].status == "behind_schedule" and rows[5].days_remaining == -14
    assert rows[6].status == "active" and rows[6].completion_rate_pct == D("0.00")
