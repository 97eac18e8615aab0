"""The twelve source tables of the finance marts, with their build types.

``from_tables`` maps the supplied star-schema tables onto those sources
(test-data adapter); production code passes JDBC or catalog reads of the
real tables instead. Money is normalised to DECIMAL on read so that every
later sum is exact; date columns are cast to DATE once, here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import MONEY, PORTFOLIO, PRICE, QUANTITY
from ledgerline.sources.tables import TableSet


@dataclass
class FinanceSources:
    users: DataFrame                 # id, name
    assets: DataFrame                # asset_id, asset_symbol, asset_name, asset_type
    portfolio_holdings: DataFrame    # user_id, asset_id, asset_sub_type, quantity, record_date
    portfolio_summary: DataFrame     # user_id, timestamp, total_value
    income_transactions: DataFrame   # user_id, date, amount
    expense_transactions: DataFrame  # user_id, category_id, date, amount (cash-flow view)
    fixed_expense_payments: DataFrame  # expense_id, payment_date, amount
    fixed_expenses: DataFrame        # id, user_id
    budgets: DataFrame               # user_id, category_id, amount
    expense_categories: DataFrame    # id, name
    category_expenses: DataFrame     # user_id, category_id, date, amount (budget view)
    price_history: DataFrame         # price_id, asset_id, timestamp, buy_price, sell_price
    goals: DataFrame                 # id, user_id, title, target_amount, current_amount, deadline, status


def users(t: TableSet) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def assets(t: TableSet) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("asset_id"),
                            F.col("p_brand").alias("asset_symbol"),
                            F.col("p_name").alias("asset_name"),
                            F.col("p_type").alias("asset_type"))


def portfolio_holdings(t: TableSet) -> DataFrame:
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity", "l_shipdate")
    o = t("orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")
            .select(F.col("o_custkey").alias("user_id"),
                    F.col("l_partkey").alias("asset_id"),
                    F.col("l_returnflag").alias("asset_sub_type"),
                    F.col("l_quantity").cast(QUANTITY).alias("quantity"),
                    F.col("l_shipdate").alias("record_date")))


def _events(t: TableSet, event_type: str | None = None) -> DataFrame:
    ev = t("events")
    return ev if event_type is None else ev.filter(F.col("event_type") == event_type)


def portfolio_summary(t: TableSet) -> DataFrame:
    return _events(t).select("user_id", F.col("ts").alias("timestamp"),
                             F.col("value").cast(PORTFOLIO).alias("total_value"))


def income_transactions(t: TableSet) -> DataFrame:
    return _events(t, "purchase").select("user_id", F.to_date("ts").alias("date"),
                                         F.col("value").cast(MONEY).alias("amount"))


def expense_transactions(t: TableSet) -> DataFrame:
    return _events(t, "click").select("user_id", F.lit(None).cast("int").alias("category_id"),
                                      F.to_date("ts").alias("date"),
                                      F.col("value").cast(MONEY).alias("amount"))


def fixed_expense_payments(t: TableSet) -> DataFrame:
    return _events(t, "error").select(F.col("event_id").alias("expense_id"),
                                      F.col("ts").alias("payment_date"),
                                      F.col("value").cast(MONEY).alias("amount"))


def fixed_expenses(t: TableSet) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))


def budgets(t: TableSet) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("user_id"),
                                F.col("c_nationkey").alias("category_id"),
                                F.col("c_acctbal").cast(MONEY).alias("amount"))


def expense_categories(t: TableSet) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def category_expenses(t: TableSet) -> DataFrame:
    o = t("orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = t("customer").select("c_custkey", "c_nationkey")
    # null-safe keys (c_custkey is never NULL, so the rows are the same): a grouping
    # by customer then has its own exchange and AQE can split a hot customer here
    return (o.join(c, o["o_custkey"].eqNullSafe(c["c_custkey"]), "inner")
            .select(F.col("o_custkey").alias("user_id"),
                    F.col("c_nationkey").alias("category_id"),
                    F.to_date("o_orderdate").alias("date"),
                    F.col("o_totalprice").cast(MONEY).alias("amount")))


def price_history(t: TableSet) -> DataFrame:
    return _events(t).select(F.col("event_id").alias("price_id"),
                             F.col("user_id").alias("asset_id"),
                             F.col("ts").alias("timestamp"),
                             F.col("value").cast(PRICE).alias("buy_price"),
                             F.get_json_object("props", "$.k").cast(PRICE).alias("sell_price"))


def goals(t: TableSet) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice",
                           "o_orderdate", "o_orderstatus")
    c = t("customer").select("c_custkey", "c_acctbal")
    return (o.join(c, o["o_custkey"].eqNullSafe(c["c_custkey"]), "left")      # splittable, as above
            .select(F.col("o_orderkey").alias("id"),
                    F.col("o_custkey").alias("user_id"),
                    F.col("o_orderpriority").alias("title"),
                    F.col("o_totalprice").cast(MONEY).alias("target_amount"),
                    F.col("c_acctbal").cast(MONEY).alias("current_amount"),
                    F.to_date("o_orderdate").alias("deadline"),
                    F.col("o_orderstatus").alias("status")))


def from_tables(t: TableSet) -> FinanceSources:
    return FinanceSources(
        users=users(t), assets=assets(t), portfolio_holdings=portfolio_holdings(t),
        portfolio_summary=portfolio_summary(t), income_transactions=income_transactions(t),
        expense_transactions=expense_transactions(t),
        fixed_expense_payments=fixed_expense_payments(t), fixed_expenses=fixed_expenses(t),
        budgets=budgets(t), expense_categories=expense_categories(t),
        category_expenses=category_expenses(t), price_history=price_history(t), goals=goals(t),
    )


# ---- the real source tables ---------------------------------------------------------

# Names of the twelve source tables and of the two price columns
# (buy, sell) in the original schema.
SOURCE_TABLE_NAMES = [
    "users", "assets", "portfolio_holdings", "portfolio_summary", "income_transactions",
    "expense_transactions", "fixed_expense_payments", "fixed_expenses", "budgets",
    "expense_categories", "price_history", "goals",
]
BUY_PRICE_COLUMN = "alis_price"
SELL_PRICE_COLUMN = "satis_price"

# Numeric column each source table is range-split on for parallel JDBC reads.
JDBC_SPLIT_COLUMN = {
    "users": "id", "assets": "asset_id", "portfolio_holdings": "user_id",
    "portfolio_summary": "user_id", "income_transactions": "user_id",
    "expense_transactions": "user_id", "fixed_expense_payments": "expense_id",
    "fixed_expenses": "id", "budgets": "user_id", "expense_categories": None,
    "price_history": "asset_id", "goals": "id",
}


def _ids(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def from_named_tables(read) -> FinanceSources:
    """Sources from the original tables; ``read(name) -> DataFrame`` may be a
    JDBC scan, a catalog read or a Parquet path read.

    Types are normalised once here: identifiers BIGINT, money DECIMAL(18,2),
    quantities DECIMAL(38,8), portfolio values DECIMAL(38,4), prices
    DECIMAL(18,4), income/expense/goal dates DATE. ``price_history`` has no id
    column, so (buy, sell) orders equal timestamps: rows that tie on it give
    the same prices, and no other column is read.
    """
    t = {n: read(n) for n in SOURCE_TABLE_NAMES}
    prices = t["price_history"]
    return FinanceSources(
        users=_ids(t["users"].select("id", "name"), "id"),
        assets=_ids(t["assets"].select("asset_id", "asset_symbol", "asset_name", "asset_type"), "asset_id"),
        portfolio_holdings=_ids(t["portfolio_holdings"].select(
            "user_id", "asset_id", "asset_sub_type", F.col("quantity").cast(QUANTITY).alias("quantity"),
            "record_date"), "user_id", "asset_id"),
        portfolio_summary=_ids(t["portfolio_summary"].select(
            "user_id", "timestamp", F.col("total_value").cast(PORTFOLIO).alias("total_value")), "user_id"),
        income_transactions=_ids(t["income_transactions"].select(
            "user_id", F.col("date").cast("date").alias("date"),
            F.col("amount").cast(MONEY).alias("amount")), "user_id"),
        expense_transactions=_ids(t["expense_transactions"].select(
            "user_id", F.col("category_id").cast("int").alias("category_id"),
            F.col("date").cast("date").alias("date"), F.col("amount").cast(MONEY).alias("amount")), "user_id"),
        fixed_expense_payments=_ids(t["fixed_expense_payments"].select(
            "expense_id", "payment_date", F.col("amount").cast(MONEY).alias("amount")), "expense_id"),
        fixed_expenses=_ids(t["fixed_expenses"].select("id", "user_id"), "id", "user_id"),
        budgets=_ids(t["budgets"].select(
            "user_id", F.col("category_id").cast("int").alias("category_id"),
            F.col("amount").cast(MONEY).alias("amount")), "user_id"),
        expense_categories=t["expense_categories"].select(F.col("id").cast("int").alias("id"), "name"),
        category_expenses=_ids(t["expense_transactions"].select(
            "user_id", F.col("category_id").cast("int").alias("category_id"),
            F.col("date").cast("date").alias("date"), F.col("amount").cast(MONEY).alias("amount")), "user_id"),
        price_history=_ids(prices.select(
            F.struct(F.col(BUY_PRICE_COLUMN).cast(PRICE).alias("buy"),
                     F.col(SELL_PRICE_COLUMN).cast(PRICE).alias("sell")).alias("price_id"),
            "asset_id", "timestamp",
            F.col(BUY_PRICE_COLUMN).cast(PRICE).alias("buy_price"),
            F.col(SELL_PRICE_COLUMN).cast(PRICE).alias("sell_price")), "asset_id"),
        goals=_ids(t["goals"].select(
            "id", "user_id", "title", F.col("target_amount").cast(MONEY).alias("target_amount"),
            F.col("current_amount").cast(MONEY).alias("current_amount"),
            F.col("deadline").cast("date").alias("deadline"), "status"), "id", "user_id"),
    )


def export_named_tables(src: FinanceSources, write) -> None:
    """Inverse of ``from_named_tables`` for the mapped test data: ``write(name, df)``
    receives each source table under its original name and columns."""
    write("users", src.users)
    write("assets", src.assets)
    write("portfolio_holdings", src.portfolio_holdings)
    write("portfolio_summary", src.portfolio_summary)
    write("income_transactions", src.income_transactions)
    write("expense_transactions", src.category_expenses)
    write("fixed_expense_payments", src.fixed_expense_payments)
    write("fixed_expenses", src.fixed_expenses)
    write("budgets", src.budgets)
    write("expense_categories", src.expense_categories)
    write("price_history", src.price_history.select(
        "asset_id", "timestamp", F.col("buy_price").alias(BUY_PRICE_COLUMN),
        F.col("sell_price").alias(SELL_PRICE_COLUMN)))
    write("goals", src.goals)
