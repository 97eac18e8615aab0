"""Named queries over a data directory: ``QUERIES[name](spark, sf_dir) -> DataFrame``.

Each query reads the supplied tables (or data Spark derives from them), so
its work grows with them. Audit timestamps are left out of the returned
columns because they differ per run.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import functions as fn
from ledgerline.functions.dates import as_date
from ledgerline.functions.money import MONEY, PORTFOLIO, PRICE, QUANTITY
from ledgerline.operators import aggregates, columns, filters, joins, sorting, windows
from ledgerline.oracle import D_EVENTS, D_ORDERS, FIXED_RUN_TS, GIVEN_TABLES, MART_DIGEST, TABLE_KEYS
from ledgerline.plans import access, daily_run, holdings_state, maintenance, marts, run_ledger
from ledgerline.plans.schemas import MART_DDL, MART_PARTITION
from ledgerline.session import fresh_path
from ledgerline.sources import audit, catalog, finance, jdbc, sinks
from ledgerline.sources import files as file_source
from ledgerline.sources.tables import TableSet, rows_with_schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(query):
        QUERIES[name] = query
        return query
    return deco


def _no_audit(df: DataFrame) -> DataFrame:
    return df.drop("created_at")


@register("asset_holdings_asof")
def q_asset_holdings(spark, sf_dir):
    """Holdings = lineitem x orders (user = customer, asset = part); as of 1998-06-15."""
    t = TableSet(spark, sf_dir)
    return _no_audit(marts.asset_holdings(finance.portfolio_holdings(t), finance.users(t),
                                          finance.assets(t), D_ORDERS))


@register("holdings_incremental")
def q_holdings_incremental(spark, sf_dir):
    """The holdings mart from stored daily sums, in one folder a month: the records of some pairs of user and
    asset come late, one month is rewritten, and every refresh recomputes the changed folders only."""
    t = TableSet(spark, sf_dir)
    src = finance.from_tables(t)
    records = src.portfolio_holdings.withColumn("late", F.pmod(F.xxhash64("user_id", "asset_id"), F.lit(7)) == 0)
    source, state = fresh_path(spark, "holdings"), fresh_path(spark, "holdings-state")
    holdings_state.store_by_day(records.where("not late").drop("late"), source, grain="month")
    holdings_state.refresh(spark, source, state)
    holdings_state.store_by_day(records.where("late").drop("late"), source, grain="month")          # late rows
    month = F.trunc("record_date", "month") == F.trunc(F.lit(D_ORDERS).cast("date"), "month")
    holdings_state.store_by_day(src.portfolio_holdings.where(month), source, "overwrite", "month")   # a correction
    holdings_state.refresh(spark, source, state)
    if holdings_state.refresh(spark, source, state):
        raise RuntimeError("a refresh without changes must find none")
    return _no_audit(holdings_state.asset_holdings(spark, state, src.users, src.assets, D_ORDERS, FIXED_RUN_TS))


@register("portfolio_day_stats")
def q_portfolio(spark, sf_dir):
    """Portfolio values = events (user, ts, value); day 2024-01-15."""
    t = TableSet(spark, sf_dir)
    return _no_audit(marts.portfolio_stats(finance.portfolio_summary(t), finance.users(t), D_EVENTS))


@register("user_cashflow")
def q_cashflow(spark, sf_dir):
    """Income = purchase, expense = click, fixed payments = error events (owner via orders)."""
    t = TableSet(spark, sf_dir)
    return _no_audit(marts.cashflow(finance.users(t), finance.income_transactions(t),
                                    finance.expense_transactions(t), finance.fixed_expense_payments(t),
                                    finance.fixed_expenses(t), D_EVENTS))


@register("budget_performance")
def q_budget(spark, sf_dir):
    """Budgets = customer balances per nation; spend = orders in June 1998 up to the 15th."""
    t = TableSet(spark, sf_dir)
    return _no_audit(marts.budget_performance(finance.budgets(t), finance.expense_categories(t),
                                              finance.category_expenses(t), D_ORDERS))


@register("asset_price_summary")
def q_price(spark, sf_dir):
    """Prices = events (asset = user_id, buy = value, sell = props.k); day 2024-01-15."""
    t = TableSet(spark, sf_dir)
    return _no_audit(marts.price_summary(finance.price_history(t), finance.assets(t), D_EVENTS))


@register("goal_progress")
def q_goal(spark, sf_dir):
    """Goals = orders (target = total price, deadline = order date, current = balance)."""
    t = TableSet(spark, sf_dir)
    return _no_audit(marts.goal_progress(finance.goals(t), finance.users(t), D_ORDERS))


# ---------------------------------------------------------------------------
# single operators (one step each over the mapped tables)
# ---------------------------------------------------------------------------


@register("filter_asof_day")
def q_filter_asof(spark, sf_dir):
    li = TableSet(spark, sf_dir)("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    return filters.on_or_before_day(li, "l_shipdate", D_ORDERS)


@register("filter_on_day")
def q_filter_on_day(spark, sf_dir):
    ev = TableSet(spark, sf_dir)("events").select("event_id", "user_id", "event_type", "value", "ts")
    return filters.on_day(ev, "ts", D_EVENTS)


@register("filter_raw_date")
def q_filter_raw(spark, sf_dir):
    o = TableSet(spark, sf_dir)("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return filters.equals_raw(o, "o_orderdate", D_ORDERS)


@register("filter_month_to_date")
def q_filter_mtd(spark, sf_dir):
    o = TableSet(spark, sf_dir)("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return filters.month_to_date(o, "o_orderdate", D_ORDERS)


@register("filter_any_positive")
def q_filter_any_positive(spark, sf_dir):
    li = TableSet(spark, sf_dir)("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return filters.any_positive(li, ["l_discount", "l_tax"])


@register("project_rename")
def q_project_rename(spark, sf_dir):
    return marts.user_names(finance.users(TableSet(spark, sf_dir)))


@register("stamp_columns")
def q_stamp(spark, sf_dir):
    u = marts.user_names(finance.users(TableSet(spark, sf_dir)))
    return marts.stamp(u, "snapshot_date", D_ORDERS, FIXED_RUN_TS)


@register("fill_nulls")
def q_fill_nulls(spark, sf_dir):
    t = TableSet(spark, sf_dir)
    d = t("documents").select("doc_id")
    return columns.fill_missing(d.join(t("labels"), "doc_id", "left"), 0, ["quality", "toxic"])


@register("derive_flag")
def q_derive_flag(spark, sf_dir):
    li = TableSet(spark, sf_dir)("lineitem")
    return columns.flag_greater(li, ["l_orderkey", "l_linenumber"], "l_tax", "l_discount", "tax_over_discount")


@register("join_inner_expr")
def q_join_inner_expr(spark, sf_dir):
    t = TableSet(spark, sf_dir)
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = t("orders").select("o_orderkey", "o_custkey")
    p = t("part").select("p_partkey", "p_brand")
    j = joins.join_inner_expr(joins.join_inner_expr(li, o, "l_orderkey", "o_orderkey"), p,
                              "l_partkey", "p_partkey")
    return j.select("l_orderkey", "l_linenumber", "o_custkey", "p_brand")


@register("join_inner_using")
def q_join_inner_using(spark, sf_dir):
    t = TableSet(spark, sf_dir)
    b = finance.budgets(t)
    cats = finance.expense_categories(t).select(F.col("id").alias("category_id"),
                                                F.col("name").alias("category_name"))
    return joins.join_using(b, cats, "category_id").select("user_id", "category_id",
                                                           "category_name", "amount")


def _per_user_totals(t: TableSet):
    inc = aggregates.sum_by(finance.income_transactions(t), ["user_id"], "amount", "inc_amt")
    exp = aggregates.sum_by(finance.expense_transactions(t), ["user_id"], "amount", "exp_amt")
    fix = joins.header_detail_sum(finance.fixed_expense_payments(t), finance.fixed_expenses(t),
                                  "expense_id", "id", "user_id", "amount", "fix_amt")
    return inc, exp, fix


@register("join_bucketed")
def q_join_bucketed(spark, sf_dir):
    """Orders and customers stored in buckets of the customer key, joined and summed per customer without an exchange."""
    t, ns = TableSet(spark, sf_dir), _namespace(spark)
    stored = {"customers": (t("customer").select("c_custkey", "c_name"), "c_custkey", "c_custkey BIGINT, c_name STRING"),
              "orders": (t("orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast(MONEY).alias("o_totalprice")),
                         "o_custkey", "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DECIMAL(18,2)")}
    for name, (df, key, ddl) in stored.items():
        catalog.create_bucketed_table(spark, f"{ns}.{name}", ddl, [key], 16, fresh_path(spark, name), [key])
        catalog.write_bucketed(df, f"{ns}.{name}")
    joined = joins.join_inner_expr(spark.table(f"{ns}.orders"), spark.table(f"{ns}.customers"), "o_custkey", "c_custkey")
    return joined.groupBy("o_custkey", "c_name").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))


@register("jdbc_splits")
def q_jdbc_splits(spark, sf_dir):
    """Rows of lineitem in each of the predicates of an equi-depth split of a skewed column (the order key
    squared), every row counted once: parts, all rows, and whether the parts are within a factor of 2."""
    lines = TableSet(spark, sf_dir)("lineitem").select((F.col("l_orderkey") * F.col("l_orderkey")).alias("k"), "l_linenumber")
    low, high = lines.agg(F.min("k"), F.max("k")).first()
    predicates = jdbc.equi_depth_predicates(jdbc.frame_histogram(lines, "k"), "k", low, high, 16, "l_linenumber")
    counts = lines.agg(*[F.count_if(F.expr(p)).alias(f"n{i}") for i, p in enumerate(predicates)])
    parts = counts.select(F.explode(F.array(*counts.columns)).alias("n"))
    return parts.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 2 * F.min("n")).alias("even"), (F.count(F.lit(1)) >= 16).alias("enough"))


@register("join_left_chain")
def q_join_left_chain(spark, sf_dir):
    t = TableSet(spark, sf_dir)
    inc, exp, fix = _per_user_totals(t)
    return joins.left_chain(marts.user_names(finance.users(t)), [inc, exp, fix], "user_id")


@register("join_left_composite")
def q_join_left_composite(spark, sf_dir):
    t = TableSet(spark, sf_dir)
    spent = aggregates.sum_by(filters.month_to_date(finance.category_expenses(t), "date", D_ORDERS),
                              ["user_id", "category_id"], "amount", "actual_spent")
    b = finance.budgets(t).select("user_id", "category_id", F.col("amount").alias("budget_amount"))
    return joins.join_using(b, spent, ["user_id", "category_id"], "left")


@register("join_header_detail")
def q_join_header_detail(spark, sf_dir):
    t = TableSet(spark, sf_dir)
    return joins.header_detail_sum(finance.fixed_expense_payments(t), finance.fixed_expenses(t),
                                   "expense_id", "id", "user_id", "amount", "fix_amt")


def _audit_inputs(spark, sf_dir):
    t = TableSet(spark, sf_dir)
    return (audit.principals(t), audit.principal_roles(t), audit.role_catalog_roles(spark),
            audit.grants(t))


@register("join_lookup_default")
def q_join_lookup_default(spark, sf_dir):
    p, pr, rc, _ = _audit_inputs(spark, sf_dir)
    return access.lookup_with_defaults(access.role_lookup(p, pr, rc))


@register("orphan_files")
def q_orphan_files(spark, sf_dir):
    """Files = orders (modified = order date), references = lineitem keys; now = 1998-06-15."""
    t = TableSet(spark, sf_dir)
    files = t("orders").select(F.col("o_orderkey").alias("file_id"),
                               F.col("o_orderdate").alias("modified_at"))
    refs = t("lineitem").select("l_orderkey")
    return maintenance.orphan_files(files, refs, "file_id", "l_orderkey", "modified_at",
                                    now=D_ORDERS)


@register("anti_join_prefiltered")
def q_anti_join_prefiltered(spark, sf_dir):
    """As orphan_files: old orders without lines, the lines cut down by a bitmap of those orders' keys first."""
    t = TableSet(spark, sf_dir)
    old = filters.on_or_before_day(t("orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").alias("modified_at")),
                                   "modified_at", as_date(D_ORDERS) - _dt.timedelta(days=2))
    return joins.left_anti_prefiltered(old, t("lineitem").select("l_orderkey"), "file_id", "l_orderkey")


def _spelt(key, turn):
    """The address of file ``key``, spelt as one of five kinds of listing would."""
    name = F.concat(F.lit("store/part="), F.pmod(key, F.lit(50)).cast("string"))
    plain = F.concat(name, F.lit("/day=a b%c/file-"), key.cast("string"))
    escaped = F.concat(name, F.lit("/day=a%20b%25c/file-"), key.cast("string"))
    kinds = [F.concat(F.lit("/"), plain), F.concat(F.lit("file:/"), plain), F.concat(F.lit("file:///"), escaped),
             F.concat(F.lit("FILE:///./"), plain), F.concat(F.lit("file://///"), escaped)]
    kind, spelt = F.pmod(key + turn, F.lit(5)), kinds[-1]
    for k, other in enumerate(kinds[:-1]):                 # only the kind that is wanted is put together
        spelt = F.when(kind == k, other).otherwise(spelt)
    return spelt


@register("orphan_addresses")
def q_orphan_addresses(spark, sf_dir):
    """As orphan_files, by address: inventory and references spell each file differently."""
    t = TableSet(spark, sf_dir)
    files = t("orders").select(_spelt(F.col("o_orderkey"), F.lit(0)).alias("path"), F.col("o_orderkey").alias("file_id"),
                               F.col("o_orderdate").alias("modified_at"))
    refs = t("lineitem").select(_spelt(F.col("l_orderkey"), F.col("l_linenumber")).alias("ref"))
    return maintenance.orphan_files(files, refs, "path", "ref", "modified_at", now=D_ORDERS).select("file_id", "modified_at")


@register("agg_sum_by_key")
def q_agg_sum_by_key(spark, sf_dir):
    return aggregates.sum_by(finance.income_transactions(TableSet(spark, sf_dir)), ["user_id"],
                             "amount", "total_income")


@register("agg_sum_composite")
def q_agg_sum_composite(spark, sf_dir):
    return aggregates.sum_by(finance.category_expenses(TableSet(spark, sf_dir)),
                             ["user_id", "category_id"], "amount", "total_spent", MONEY)


@register("agg_stats")
def q_agg_stats(spark, sf_dir):
    return aggregates.stats_by(finance.portfolio_summary(TableSet(spark, sf_dir)), ["user_id"],
                               "total_value", PORTFOLIO)


@register("agg_first_constant")
def q_agg_first_constant(spark, sf_dir):
    t = TableSet(spark, sf_dir)
    c = t("customer").select("c_custkey", "c_nationkey")
    n = t("nation").select("n_nationkey", "n_name")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "inner")
    return aggregates.first_constant(j, ["c_nationkey"], "n_name", "nation_name", "n_customers")


@register("agg_privilege_list")
def q_agg_privilege_list(spark, sf_dir):
    return access.privilege_lists(audit.grants(TableSet(spark, sf_dir)))


@register("compaction_plan")
def q_compaction_plan(spark, sf_dir):
    """Files = documents per source, size = n_chars; threshold and target 4,000."""
    docs = TableSet(spark, sf_dir)("documents").select("source", "n_chars")
    return maintenance.compaction_plan(docs, "source", "n_chars", 4000, 4000)


@register("compaction_bins")
def q_compaction_bins(spark, sf_dir):
    """Files = documents per source, size = n_chars, small under 4,000; bins of about 16,000."""
    docs = TableSet(spark, sf_dir)("documents").select("source", "n_chars", "doc_id")
    return maintenance.compaction_bins(docs, "source", "doc_id", "n_chars", 4000, 16000).select(
        "source", "doc_id", "n_chars", "bin", "bin_files", "bin_bytes")


def _daily_prices(spark, sf_dir):
    return finance.price_history(TableSet(spark, sf_dir)).withColumn(
        "price_day", F.to_date("timestamp"))


@register("window_first_asc")
def q_window_first_asc(spark, sf_dir):
    """Open (first buy price) of every (asset, day), attached to each price row."""
    p = _daily_prices(spark, sf_dir)
    out = windows.first_by_time(p, ["asset_id", "price_day"], "timestamp", "buy_price", "price_id",
                                "open_buy_price")
    return out.select("price_id", "asset_id", "price_day", "open_buy_price")


@register("window_first_desc")
def q_window_first_desc(spark, sf_dir):
    """Close (last buy price) of every (asset, day), attached to each price row."""
    p = _daily_prices(spark, sf_dir)
    out = windows.first_by_time(p, ["asset_id", "price_day"], "timestamp", "buy_price", "price_id",
                                "close_buy_price", descending=True)
    return out.select("price_id", "asset_id", "price_day", "close_buy_price")


@register("snapshot_retention")
def q_snapshot_retention(spark, sf_dir):
    """Snapshots = events (table = user, snapshot = event, committed = ts); now given: the newest ts."""
    ev = TableSet(spark, sf_dir)("events").select(
        F.col("user_id").alias("table_name"), F.col("event_id").alias("snapshot_id"),
        F.col("ts").alias("committed_at"))
    return maintenance.snapshot_retention(ev, now=ev.select(F.max("committed_at")).scalar())


def _event_snapshots(spark, sf_dir):
    """Snapshots = events (table = user), each holding one file for its own day and each
    of the four days before (so neighbouring snapshots share files) and one of its own."""
    ev = TableSet(spark, sf_dir)("events").select(
        F.col("user_id").alias("table_name"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("committed_at"))
    days = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.date_sub(F.col("committed_at").cast("date"), k).cast("string"))
    names = F.concat(days, F.array(F.concat(F.lit("own-"), F.col("snapshot_id").cast("string"))))
    manifest = ev.select("table_name", "snapshot_id", F.explode(names).alias("name")).select(
        "table_name", "snapshot_id", F.concat(F.lit("/wh/"), F.col("table_name").cast("string"), F.lit("/"), F.col("name")).alias("path"),
        (F.length("name") * 100).cast("bigint").alias("length"))
    return ev, manifest, maintenance.snapshot_retention(ev, now=ev.select(F.max("committed_at")).scalar())


@register("expired_files")
def q_expired_files(spark, sf_dir):
    """Files that only expired snapshots hold."""
    _, manifest, expired = _event_snapshots(spark, sf_dir)
    return maintenance.expired_files(manifest, expired)


@register("snapshot_expiry")
def q_snapshot_expiry(spark, sf_dir):
    """Per table: snapshots, expired ones, files and bytes that go, files that are shared and stay."""
    return maintenance.expiry_summary(*_event_snapshots(spark, sf_dir))


@register("sort_multi_key")
def q_sort_multi_key(spark, sf_dir):
    c = TableSet(spark, sf_dir)("customer").select("c_nationkey", "c_mktsegment", "c_name", "c_custkey")
    return sorting.sort_multi_key(c, ["c_nationkey", "c_mktsegment", "c_name"])


@register("limit_rows")
def q_limit_rows(spark, sf_dir):
    o = TableSet(spark, sf_dir)("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sorting.top_rows(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


# ---- scalar functions ------------------------------------------------------

@register("fn_to_date")
def q_fn_to_date(spark, sf_dir):
    ev = TableSet(spark, sf_dir)("events")
    return ev.select("event_id", fn.to_day("ts").alias("event_day"))


@register("fn_datediff")
def q_fn_datediff(spark, sf_dir):
    o = TableSet(spark, sf_dir)("orders")
    return o.select("o_orderkey", fn.datediff_days(fn.to_day("o_orderdate"),
                                                   F.lit(_dt.date.fromisoformat(D_ORDERS)))
                    .alias("days_from_report"))


@register("fn_month_start")
def q_fn_month_start(spark, sf_dir):
    o = TableSet(spark, sf_dir)("orders")
    return o.select("o_orderkey", fn.month_start("o_orderdate").alias("order_month"))


@register("fn_parse_date")
def q_fn_parse_date(spark, sf_dir):
    o = TableSet(spark, sf_dir)("orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", fn.parse_day(text).alias("order_day"))


@register("fn_now")
def q_fn_now(spark, sf_dir):
    """The query time: one value for the whole query, and not before any event."""
    ev = TableSet(spark, sf_dir)("events")
    stamped = ev.select("event_id", fn.now().alias("a"), fn.now().alias("b"), F.col("ts").cast("timestamp").alias("ts"))
    return stamped.select("event_id", (F.col("a") == F.col("b")).alias("one_value"),
                          (F.col("a") >= F.col("ts")).alias("not_before_event"))


@register("fn_coalesce")
def q_fn_coalesce(spark, sf_dir):
    g = finance.goals(TableSet(spark, sf_dir))
    return g.select(F.col("id").alias("goal_id"),
                    F.coalesce(F.col("current_amount"), F.lit(0)).cast(MONEY).alias("current_amount"))


@register("fn_when_chain")
def q_fn_when_chain(spark, sf_dir):
    g = finance.goals(TableSet(spark, sf_dir))
    days = fn.datediff_days("deadline", F.lit(_dt.date.fromisoformat(D_ORDERS)))
    return g.select(F.col("id").alias("goal_id"),
                    marts.goal_status(F.coalesce("current_amount", F.lit(0)).cast(MONEY),
                                      F.col("target_amount"), days, F.col("status")).alias("status"))


def _money_lines(spark, sf_dir):
    li = TableSet(spark, sf_dir)("lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.col("l_extendedprice").cast(MONEY).alias("price"),
                     F.col("l_quantity").cast(MONEY).alias("qty"),
                     F.col("l_discount").cast(MONEY).alias("discount"),
                     F.col("l_tax").cast(MONEY).alias("tax"))


@register("fn_safe_pct")
def q_fn_safe_pct(spark, sf_dir):
    m = _money_lines(spark, sf_dir)
    return m.select("l_orderkey", "l_linenumber", fn.safe_pct("tax", "discount").alias("tax_pct"))


@register("fn_decimal_cast")
def q_fn_decimal_cast(spark, sf_dir):
    m = _money_lines(spark, sf_dir)
    # the exact product once (decimal(37,4)), then each rounding of it
    amounts = m.select("l_orderkey", "l_linenumber", "price",
                       (F.col("price") * F.col("discount")).alias("amount"))
    amount = F.col("amount")
    return amounts.select("l_orderkey", "l_linenumber",
                          amount.cast(MONEY).alias("disc_money"),
                          amount.cast(PRICE).alias("disc_price"),
                          amount.cast(QUANTITY).alias("disc_quantity"),
                          amount.cast(PORTFOLIO).alias("disc_portfolio"),
                          F.col("price").try_cast("decimal(5,2)").alias("price_pct_type"))


@register("fn_arithmetic")
def q_fn_arithmetic(spark, sf_dir):
    return columns.price_arithmetic(_money_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"],
                                    "price", "discount", "tax", "qty")


@register("fn_concat_colon")
def q_fn_concat_colon(spark, sf_dir):
    g = audit.grants(TableSet(spark, sf_dir))
    return g.select("grant_order", fn.concat_colon("grant_type", "privilege").alias("grant_entry"))


# The three list keys of a role payload, in lookup order.
ROLE_LIST_KEYS = ("principalRoles", "roles", "entities")


def role_payloads(t: TableSet):
    """One JSON role listing per customer, built from its order priorities;
    the list sits under a different key per customer (and sometimes behind an
    empty first list), as listings of different service versions do."""
    o = t("orders").select("o_custkey", "o_orderpriority").distinct()
    per = (o.groupBy("o_custkey")
           .agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderpriority").alias("name"))))
                .alias("items")))
    c = t("customer").select("c_custkey")
    j = c.join(per, c["c_custkey"] == per["o_custkey"], "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<struct<name:string>>"))
    empty = F.array().cast("array<struct<name:string>>")
    variant = F.pmod(F.col("c_custkey"), F.lit(4))
    doc = (F.when(variant == 0, F.to_json(F.struct(items.alias("principalRoles"))))
           .when(variant == 1, F.to_json(F.struct(items.alias("roles"))))
           .when(variant == 2, F.to_json(F.struct(items.alias("entities"))))
           .otherwise(F.to_json(F.struct(empty.alias("principalRoles"), items.alias("roles")))))
    return j.select(F.col("c_custkey").alias("principal_id"), doc.alias("payload"))


@register("fn_json_fallback")
def q_fn_json_fallback(spark, sf_dir):
    """Role names parsed back from per-customer JSON role listings."""
    p = role_payloads(TableSet(spark, sf_dir))
    return p.select("principal_id",
                    F.explode_outer(fn.first_present_names("payload", ROLE_LIST_KEYS))
                    .alias("principal_role"))


@register("fn_bytes_to_kb")
def q_fn_bytes_to_kb(spark, sf_dir):
    d = TableSet(spark, sf_dir)("documents")
    return d.select("doc_id", fn.bytes_to_kb("n_chars").alias("size_kb"))


# ---- access audit ------------------------------------------------------------

@register("access_matrix")
def q_access_matrix(spark, sf_dir):
    """Principals = customers and suppliers, roles from all orders, catalog roles fixed, grants = nations."""
    p, pr, rc, g = _audit_inputs(spark, sf_dir)
    return access.access_matrix(p, pr, rc, g, audit.CATALOG_NAME)


# ---- sources, sinks and DDL (write under the session's work root, read back) ----


def _read_mart(spark, name: str, path: str):
    return spark.read.schema(MART_DDL[name][0]).parquet(path)


def _goal_mart(spark, sf_dir, day=D_ORDERS):
    t = TableSet(spark, sf_dir)
    return marts.goal_progress(finance.goals(t), finance.users(t), day, FIXED_RUN_TS)


def _price_mart(spark, sf_dir, day):
    t = TableSet(spark, sf_dir)
    return marts.price_summary(finance.price_history(t), finance.assets(t), day, FIXED_RUN_TS)


def _namespace(spark) -> str:
    ns = f"ll_{uuid.uuid4().hex[:12]}"
    catalog.create_namespace(spark, ns, fresh_path(spark, ns))
    return ns


def _register_given(spark, sf_dir, ns):
    t = TableSet(spark, sf_dir)
    for name in GIVEN_TABLES:
        catalog.register_external(spark, f"{ns}.{name}", t.path(name))


@register("table_scan")
def q_table_scan(spark, sf_dir):
    """Catalog table over the customer file, read back whole."""
    ns = _namespace(spark)
    catalog.register_external(spark, f"{ns}.customer", TableSet(spark, sf_dir).path("customer"))
    return spark.read.table(f"{ns}.customer")


@register("rows_with_schema")
def q_rows_with_schema(spark, sf_dir):
    """Part names and sizes under an explicit non-nullable schema."""
    schema = T.StructType([T.StructField("ITEM_NAME", T.StringType(), False),
                           T.StructField("QUANTITY", T.IntegerType(), False)])
    p = TableSet(spark, sf_dir)("part").select(F.col("p_name").alias("ITEM_NAME"),
                                               F.col("p_size").alias("QUANTITY"))
    return rows_with_schema(p, schema)


@register("file_inventory")
def q_file_inventory(spark, sf_dir):
    """Every file of the supplied tables: its key, the rows a scan finds in it, and
    whether the listed size is the one the reader saw."""
    return file_source.table_files(spark, sf_dir, GIVEN_TABLES)


@register("create_namespace")
def q_create_namespace(spark, sf_dir):
    """Namespace created twice (idempotent) holding the supplied tables, which are
    read through it: rows and distinct keys of every table."""
    ns = _namespace(spark)
    catalog.create_namespace(spark, ns)            # second call is a no-op
    _register_given(spark, sf_dir, ns)
    out = None
    for name, key in TABLE_KEYS.items():
        part = spark.read.table(f"{ns}.{name}").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys")).select(
            F.lit(name).alias("table_name"), "n_rows", "n_keys")
        out = part if out is None else out.unionByName(part)
    return out


@register("catalog_listing")
def q_catalog_listing(spark, sf_dir):
    """The supplied tables registered in a namespace, listed with their row counts,
    and whether the namespace itself is listed."""
    ns = _namespace(spark)
    _register_given(spark, sf_dir, ns)
    listed = catalog.list_namespaces(spark).filter(F.col("namespace") == ns).count() == 1
    names = [r.tableName for r in catalog.list_tables(spark, ns).filter(~F.col("isTemporary")).collect()]
    counts = [spark.read.table(f"{ns}.{n}").select(F.lit(n).alias("table_name"),
                                                   F.count(F.lit(1)).alias("n_rows"))
              .groupBy("table_name").agg(F.sum("n_rows").alias("n_rows")) for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.withColumn("namespace_listed", F.lit(listed))


def _mart_table(spark, ns, name):
    ddl, part = MART_DDL[name]
    full = f"{ns}.{name}"
    return full, catalog.create_table_sql(full, ddl, part, fresh_path(spark, name))


@register("create_table")
def q_create_table(spark, sf_dir):
    """Partitioned mart table created twice (idempotent), goal mart inserted, read back."""
    ns = _namespace(spark)
    full, sql = _mart_table(spark, ns, "daily_goal_progress_stats")
    spark.sql(sql)
    spark.sql(sql)                                 # IF NOT EXISTS: second call is a no-op
    sinks.append_table(_goal_mart(spark, sf_dir), full)
    return _no_audit(spark.read.table(full))


@register("ensure_table")
def q_ensure_table(spark, sf_dir):
    """ensure_table creates once then finds the table; goal mart appended, read back."""
    ns = _namespace(spark)
    full, sql = _mart_table(spark, ns, "daily_goal_progress_stats")
    created = catalog.ensure_table(spark, full, sql)
    again = catalog.ensure_table(spark, full, sql)
    if not created or again:
        raise RuntimeError("ensure_table must create once and then find the table")
    sinks.append_table(_goal_mart(spark, sf_dir), full)
    return _no_audit(spark.read.table(full))


@register("insert_values")
def q_insert_values(spark, sf_dir):
    """INSERT INTO ... SELECT from the customer table and INSERT INTO ... VALUES, read back."""
    ns = _namespace(spark)
    catalog.register_external(spark, f"{ns}.customer", TableSet(spark, sf_dir).path("customer"))
    catalog.create_table(spark, f"{ns}.users", "id BIGINT, name STRING, job STRING",
                         location=fresh_path(spark, "users"))
    catalog.insert_values(spark, f"{ns}.users",
                          f"SELECT c_custkey, c_name, c_mktsegment FROM {ns}.customer")
    catalog.insert_values(spark, f"{ns}.users", "VALUES (-1, 'Ann', 'Engineer'), (-2, 'Bob', NULL)")
    return spark.read.table(f"{ns}.users")


@register("append_sink")
def q_append_sink(spark, sf_dir):
    """Goal mart appended twice: every row twice."""
    name = "daily_goal_progress_stats"
    path = fresh_path(spark, name)
    batch = _goal_mart(spark, sf_dir)
    sinks.append(batch, path, MART_PARTITION[name])
    sinks.append(batch, path, MART_PARTITION[name])  # not idempotent: stored twice
    return _no_audit(_read_mart(spark, name, path))


@register("partition_overwrite_sink")
def q_partition_overwrite_sink(spark, sf_dir):
    """Two days written, the second rewritten and an empty batch written: each day once."""
    name = "daily_asset_price_summary"
    path, part = fresh_path(spark, name), MART_PARTITION[name]
    before, day = marts.previous_day(D_EVENTS), D_EVENTS
    sinks.overwrite_partitions(_price_mart(spark, sf_dir, before), path, part)
    sinks.overwrite_partitions(_price_mart(spark, sf_dir, day), path, part)
    sinks.overwrite_partitions(_price_mart(spark, sf_dir, day), path, part)   # rerun: replaced
    sinks.overwrite_partitions(_price_mart(spark, sf_dir, day).filter(F.lit(False)), path, part)
    return _no_audit(_read_mart(spark, name, path))


@register("overwrite_sink")
def q_overwrite_sink(spark, sf_dir):
    """Goal mart overwritten twice: once."""
    name = "daily_goal_progress_stats"
    path = fresh_path(spark, name)
    sinks.overwrite(_goal_mart(spark, sf_dir), path, MART_PARTITION[name])
    sinks.overwrite(_goal_mart(spark, sf_dir), path, MART_PARTITION[name])
    return _no_audit(_read_mart(spark, name, path))


@register("compact_table")
def q_compact_table(spark, sf_dir):
    """Documents written as many small files per source, compacted, read back whole: per
    source the rows, ids, text lengths, distinct texts and the extreme row digests."""
    path = fresh_path(spark, "documents")
    docs = TableSet(spark, sf_dir)("documents")
    # many small files per partition: every task writes into every source folder
    docs.repartition(8, "doc_id").write.partitionBy("source").parquet(path)
    maintenance.compact_table(spark, path, "source")
    back = spark.read.parquet(path)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                      F.sum("n_chars").alias("total_chars"),
                                      F.count_distinct("doc_id").alias("n_ids"),
                                      F.sum(F.length("text")).cast("bigint").alias("text_chars"),
                                      F.count_distinct(F.md5("text")).alias("n_texts"),
                                      F.min(F.md5(F.concat_ws("|", "doc_id", "lang", "text"))).alias("least_row"),
                                      F.max(F.md5(F.concat_ws("|", "doc_id", "lang", "text"))).alias("greatest_row"))


@register("daily_marts_run")
def q_daily_marts_run(spark, sf_dir):
    """All six marts for two days (one of them twice, idempotent mode): rows per mart and day."""
    root = fresh_path(spark, "marts")
    src = finance.from_tables(TableSet(spark, sf_dir))
    for day in (D_ORDERS, D_EVENTS, D_EVENTS):     # the repeated day must not duplicate rows
        daily_run.run_daily(src, root, day, FIXED_RUN_TS, idempotent=True)
    return _mart_digest({name: _read_mart(spark, name, f"{root}/{name}") for name in MART_DDL})


@register("daily_marts_published")
def q_daily_marts_published(spark, sf_dir):
    """All six marts for two days through the run ledger, appending: one day's fourth mart fails
    its audit, the day is repeated, and repeated once more: rows per mart and day."""
    root = fresh_path(spark, "published")
    src = finance.from_tables(TableSet(spark, sf_dir))
    broken = run_ledger.Audit(("user_id",), {"stop": "true"})
    run_ledger.publish_day(src, root, D_ORDERS, FIXED_RUN_TS)
    try:
        run_ledger.publish_day(src, root, D_EVENTS, FIXED_RUN_TS, audits={"monthly_budget_performance": broken})
    except run_ledger.AuditFailed:
        pass
    for _ in range(2):
        run_ledger.publish_day(src, root, D_EVENTS, FIXED_RUN_TS)
    return _mart_digest({name: _read_mart(spark, name, f"{root}/{name}") for name in MART_DDL})


def _mart_digest(tables):
    """Rows, distinct keys and exact sums of the decimal columns per mart and day."""
    out = None
    for name, (key, sums) in MART_DIGEST.items():
        totals = [F.sum(F.col(c).cast("decimal(28,8)")).alias(f"sum_{k}") for k, c in enumerate(sums)]
        part = (tables[name].groupBy(F.col(MART_PARTITION[name]).alias("report_date"))
                .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), *totals)
                .select(F.lit(name).alias("mart"), "*"))
        out = part if out is None else out.unionByName(part)
    return out


@register("daily_marts_tables")
def q_daily_marts_tables(spark, sf_dir):
    """The daily job into the six catalog tables of the mart DDL: one day appended,
    one day written by partition overwrite twice; digest of what the tables hold."""
    ns = _namespace(spark)
    tables = {}
    for name in MART_DDL:
        tables[name], sql = _mart_table(spark, ns, name)
        catalog.ensure_table(spark, tables[name], sql)
    src = finance.from_tables(TableSet(spark, sf_dir))
    daily_run.run_into_tables(src, tables, D_ORDERS, FIXED_RUN_TS)
    for _ in range(2):
        daily_run.run_into_tables(src, tables, D_EVENTS, FIXED_RUN_TS, idempotent=True)
    return _mart_digest({name: spark.read.table(full) for name, full in tables.items()})


@register("access_matrix_from_listings")
def q_access_matrix_from_listings(spark, sf_dir):
    """The matrix through the listing-response path: the audit listings are
    rendered as JSON documents (as the catalog service returns them, one per
    principal / principal role / catalog role) and parsed back."""
    p, pr, rc, g = _audit_inputs(spark, sf_dir)
    roles = pr.groupBy("principal_name").agg(
        F.array_sort(F.collect_list(F.struct(F.col("principal_role").alias("name")))).alias("items"))
    principal_docs = (p.join(roles, "principal_name", "left")
                      .select("principal_name",
                              F.to_json(F.struct(F.coalesce("items", F.array().cast("array<struct<name:string>>"))
                                                 .alias("principalRoles"))).alias("payload")))
    role_docs = (rc.groupBy("principal_role")
                 .agg(F.to_json(F.struct(F.array_sort(F.collect_list(
                     F.struct(F.col("catalog_role").alias("name")))).alias("catalogRoles"))).alias("payload")))
    grant_docs = (g.groupBy("catalog_role")
                  .agg(F.to_json(F.struct(F.transform(
                      F.array_sort(F.collect_list(F.struct("grant_order", "grant_type", "privilege"))),
                      lambda x: F.struct(x["grant_type"].alias("type"), x["privilege"].alias("privilege")))
                      .alias("grants"))).alias("payload")))
    listings = access.listings_from_payloads(principal_docs, role_docs, grant_docs)
    return access.access_matrix(*listings, audit.CATALOG_NAME)
