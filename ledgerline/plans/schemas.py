"""Mart table definitions (name -> ordered columns, partition column, DDL).

Identifiers are BIGINT (the supplied keys are BIGINT and would overflow INT
at scale); the other types are those of the original marts.
"""

from __future__ import annotations

# Mart table names, column names/order and types of the original marts
# (identifiers widened to BIGINT as noted above).
MART_DDL = {
    "daily_user_asset_holdings": (
        "snapshot_date DATE, user_id BIGINT, user_name STRING, asset_id BIGINT, "
        "asset_symbol STRING, asset_name STRING, asset_type STRING, asset_sub_type STRING, "
        "total_quantity DECIMAL(38,8), created_at TIMESTAMP", "snapshot_date"),
    "daily_user_portfolio_stats": (
        "snapshot_date DATE, user_id BIGINT, user_name STRING, "
        "avg_portfolio_value DECIMAL(38,4), min_portfolio_value DECIMAL(38,4), "
        "max_portfolio_value DECIMAL(38,4), sample_count BIGINT, created_at TIMESTAMP",
        "snapshot_date"),
    "daily_user_cashflow": (
        "summary_date DATE, user_id BIGINT, user_name STRING, total_income DECIMAL(18,2), "
        "total_variable_expense DECIMAL(18,2), total_fixed_expense DECIMAL(18,2), "
        "net_cashflow DECIMAL(18,2), savings_rate_pct DECIMAL(5,2), created_at TIMESTAMP",
        "summary_date"),
    "monthly_budget_performance": (
        "budget_month DATE, user_id BIGINT, category_id INT, category_name STRING, "
        "budget_amount DECIMAL(18,2), actual_spent DECIMAL(18,2), remaining_amount DECIMAL(18,2), "
        "utilization_rate_pct DECIMAL(5,2), is_over_budget BOOLEAN, created_at TIMESTAMP",
        "budget_month"),
    "daily_asset_price_summary": (
        "price_date DATE, asset_id BIGINT, asset_symbol STRING, asset_type STRING, "
        "open_buy_price DECIMAL(18,4), close_buy_price DECIMAL(18,4), min_buy_price DECIMAL(18,4), "
        "max_buy_price DECIMAL(18,4), avg_spread DECIMAL(18,4), sample_points BIGINT, "
        "created_at TIMESTAMP", "price_date"),
    "daily_goal_progress_stats": (
        "snapshot_date DATE, goal_id BIGINT, user_id BIGINT, user_name STRING, goal_title STRING, "
        "target_amount DECIMAL(18,2), current_amount DECIMAL(18,2), completion_rate_pct DECIMAL(5,2), "
        "deadline DATE, days_remaining INT, status STRING, created_at TIMESTAMP", "snapshot_date"),
}

MART_COLUMNS = {
    name: [part.strip().split(" ")[0] for part in ddl.split(", ") if part.strip()]
    for name, (ddl, _) in MART_DDL.items()
}

MART_PARTITION = {name: part for name, (_, part) in MART_DDL.items()}
