"""Independent DuckDB SQL for every registered query (correctness oracle).

DuckDB divides decimals in DOUBLE, so Spark's exact decimal quotients are
rebuilt in integer units: ``half_up(n, d)`` rounds ``n / d`` half away from
zero like Spark's HALF_UP, and every rounding step of Spark's decimal
type rules (quotient scale, product scale, final cast) is applied in turn.
"""

from __future__ import annotations

D_ORDERS = "1998-06-15"   # report day for the order-dated sources
D_EVENTS = "2024-01-15"   # report day for the event-dated sources


def pow10(k: int) -> str:
    """10^k as an exact HUGEINT literal (DuckDB's ``**`` is DOUBLE)."""
    return f"CAST('{10 ** k}' AS HUGEINT)"


def half_up(n: str, d: str) -> str:
    """Integer ``n / d`` rounded half away from zero (d > 0)."""
    return f"(sign({n}) * ((abs({n}) * 2 + ({d})) // (2 * ({d}))))"


def units(x: str, scale: int) -> str:
    """Decimal with ``scale`` digits -> HUGEINT count of 10^-scale."""
    return f"CAST(CAST({x} AS DECIMAL(38,{scale})) * {10 ** scale} AS HUGEINT)"


def from_units(n: str, scale: int, prec: int = 38) -> str:
    """HUGEINT count of 10^-scale -> DECIMAL(prec, scale)."""
    if scale == 0:
        return f"CAST({n} AS DECIMAL({prec},0))"
    one = "0." + "0" * (scale - 1) + "1"
    return f"CAST(CAST({n} AS DECIMAL(38,0)) * {one} AS DECIMAL({prec},{scale}))"


def pct_units2(num_cents: str, den_cents: str) -> str:
    """Spark's ``(a / b * 100)`` for two 2-scale decimals (quotient scale 20,
    product scale 16), then rounded to 2 decimals; result in 10^-2 units."""
    q20 = half_up(f"({num_cents}) * {pow10(20)}", den_cents)
    p16 = half_up(f"{q20} * 100", pow10(4))
    return half_up(p16, pow10(14))


def safe_pct_sql(num: str, den: str) -> str:
    """SQL twin of ``functions.money.safe_pct`` for DECIMAL(x,2) operands."""
    inner = from_units(pct_units2(units(num, 2), units(den, 2)), 2)
    return (f"CASE WHEN {den} > 0 THEN TRY_CAST({inner} AS DECIMAL(5,2)) "
            f"ELSE CAST(0 AS DECIMAL(5,2)) END")


# ---- source mappings (same as ledgerline.sources.finance) -----------------

SRC = {
    "users": "SELECT c_custkey AS id, c_name AS name FROM customer",
    "assets": ("SELECT p_partkey AS asset_id, p_brand AS asset_symbol, p_name AS asset_name, "
               "p_type AS asset_type FROM part"),
    "holdings": ("SELECT o.o_custkey AS user_id, l.l_partkey AS asset_id, l.l_returnflag AS asset_sub_type, "
                 "CAST(l.l_quantity AS DECIMAL(38,8)) AS quantity, l.l_shipdate AS record_date "
                 "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"),
    "summary": ("SELECT user_id, ts AS \"timestamp\", CAST(value AS DECIMAL(38,4)) AS total_value "
                "FROM events"),
    "income": ("SELECT user_id, CAST(ts AS DATE) AS date, CAST(value AS DECIMAL(18,2)) AS amount "
               "FROM events WHERE event_type = 'purchase'"),
    "expense": ("SELECT user_id, CAST(ts AS DATE) AS date, CAST(value AS DECIMAL(18,2)) AS amount "
                "FROM events WHERE event_type = 'click'"),
    "fixed_pay": ("SELECT event_id AS expense_id, ts AS payment_date, CAST(value AS DECIMAL(18,2)) AS amount "
                  "FROM events WHERE event_type = 'error'"),
    "fixed_exp": "SELECT o_orderkey AS id, o_custkey AS user_id FROM orders",
    "budgets": ("SELECT c_custkey AS user_id, c_nationkey AS category_id, "
                "CAST(c_acctbal AS DECIMAL(18,2)) AS amount FROM customer"),
    "categories": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "cat_expense": ("SELECT o.o_custkey AS user_id, c.c_nationkey AS category_id, "
                    "CAST(o.o_orderdate AS DATE) AS date, CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount "
                    "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
    "prices": ("SELECT event_id AS price_id, user_id AS asset_id, ts AS \"timestamp\", "
               "CAST(value AS DECIMAL(18,4)) AS buy_price, "
               "CAST(json_extract_string(props, '$.k') AS DECIMAL(18,4)) AS sell_price FROM events"),
    "goals": ("SELECT o.o_orderkey AS id, o.o_custkey AS user_id, o.o_orderpriority AS title, "
              "CAST(o.o_totalprice AS DECIMAL(18,2)) AS target_amount, "
              "CAST(c.c_acctbal AS DECIMAL(18,2)) AS current_amount, "
              "CAST(o.o_orderdate AS DATE) AS deadline, o.o_orderstatus AS status "
              "FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"),
}


def with_sources(*names: str, src: dict | None = None) -> str:
    """CTEs for the named finance sources; ``src`` overrides the mapping
    (e.g. ``{"users": "SELECT * FROM my_users"}`` for hand-made tables)."""
    src = {**SRC, **(src or {})}
    return "WITH " + ",\n".join(f"{n} AS ({src[n]})" for n in names) + "\n"


def asset_holdings_sql(day: str = D_ORDERS, src: dict | None = None) -> str:
    return with_sources("users", "assets", "holdings", src=src) + f"""
SELECT DATE '{day}' AS snapshot_date, u.id AS user_id, u.name AS user_name, a.asset_id,
       a.asset_symbol, a.asset_name, a.asset_type, h.asset_sub_type,
       CAST(sum(h.quantity) AS DECIMAL(38,8)) AS total_quantity
FROM holdings h JOIN users u ON h.user_id = u.id JOIN assets a ON h.asset_id = a.asset_id
WHERE CAST(h.record_date AS DATE) <= DATE '{day}'
GROUP BY u.id, u.name, a.asset_id, a.asset_symbol, a.asset_name, a.asset_type, h.asset_sub_type"""


def portfolio_stats_sql(day: str = D_EVENTS, src: dict | None = None) -> str:
    s = "sum(" + units("s.total_value", 4) + ")"
    c = "count(s.total_value)"
    avg6 = half_up(f"{s} * 100", c)
    avg4 = half_up(avg6, "100")
    return with_sources("users", "summary", src=src) + f"""
SELECT DATE '{day}' AS snapshot_date, u.id AS user_id, u.name AS user_name,
       CASE WHEN {c} > 0 THEN {from_units(avg4, 4)} END AS avg_portfolio_value,
       CAST(min(s.total_value) AS DECIMAL(38,4)) AS min_portfolio_value,
       CAST(max(s.total_value) AS DECIMAL(38,4)) AS max_portfolio_value,
       {c} AS sample_count
FROM summary s JOIN users u ON s.user_id = u.id
WHERE CAST(s."timestamp" AS DATE) = DATE '{day}'
GROUP BY u.id, u.name"""


def cashflow_sql(day: str = D_EVENTS, src: dict | None = None) -> str:
    return with_sources("users", "income", "expense", "fixed_pay", "fixed_exp", src=src) + f""",
inc AS (SELECT user_id, sum(amount) AS inc_amt FROM income WHERE date = DATE '{day}' GROUP BY user_id),
exp AS (SELECT user_id, sum(amount) AS exp_amt FROM expense WHERE date = DATE '{day}' GROUP BY user_id),
fix AS (SELECT f.user_id, sum(p.amount) AS fix_amt FROM fixed_pay p JOIN fixed_exp f ON p.expense_id = f.id
        WHERE CAST(p.payment_date AS DATE) = DATE '{day}' GROUP BY f.user_id),
j AS (SELECT u.id AS user_id, u.name AS user_name,
             coalesce(inc.inc_amt, 0) AS inc_amt, coalesce(exp.exp_amt, 0) AS exp_amt,
             coalesce(fix.fix_amt, 0) AS fix_amt
      FROM users u LEFT JOIN inc ON u.id = inc.user_id LEFT JOIN exp ON u.id = exp.user_id
                   LEFT JOIN fix ON u.id = fix.user_id),
k AS (SELECT *, CAST(inc_amt - (exp_amt + fix_amt) AS DECIMAL(18,2)) AS net_cashflow FROM j
      WHERE inc_amt > 0 OR exp_amt > 0 OR fix_amt > 0)
SELECT DATE '{day}' AS summary_date, user_id, user_name,
       CAST(inc_amt AS DECIMAL(18,2)) AS total_income,
       CAST(exp_amt AS DECIMAL(18,2)) AS total_variable_expense,
       CAST(fix_amt AS DECIMAL(18,2)) AS total_fixed_expense,
       net_cashflow,
       {safe_pct_sql('net_cashflow', 'inc_amt')} AS savings_rate_pct
FROM k"""


def budget_sql(day: str = D_ORDERS, src: dict | None = None) -> str:
    month = day[:8] + "01"
    return with_sources("budgets", "categories", "cat_expense", src=src) + f""",
spent AS (SELECT user_id, category_id, sum(amount) AS actual_spent FROM cat_expense
          WHERE date >= DATE '{month}' AND date <= DATE '{day}' GROUP BY user_id, category_id),
j AS (SELECT b.user_id, b.category_id, c.name AS category_name,
             CAST(b.amount AS DECIMAL(18,2)) AS budget_amount,
             CAST(coalesce(s.actual_spent, 0) AS DECIMAL(18,2)) AS actual_spent
      FROM budgets b JOIN categories c ON b.category_id = c.id
      LEFT JOIN spent s ON b.user_id = s.user_id AND b.category_id = s.category_id)
SELECT DATE '{month}' AS budget_month, user_id, category_id, category_name, budget_amount, actual_spent,
       CAST(budget_amount - actual_spent AS DECIMAL(18,2)) AS remaining_amount,
       {safe_pct_sql('actual_spent', 'budget_amount')} AS utilization_rate_pct,
       actual_spent > budget_amount AS is_over_budget
FROM j"""


def price_summary_sql(day: str = D_EVENTS, src: dict | None = None) -> str:
    """Aggregate per asset first, then join the asset table (as the original does:
    a duplicated asset row duplicates the summary row)."""
    spread = "(p.sell_price - p.buy_price)"
    s = "sum(" + units(spread, 4) + ")"
    c = f"count({spread})"
    a13 = half_up(f"{s} * {pow10(9)}", c)
    a8 = half_up(a13, "100000")
    a4 = half_up(a8, "10000")
    return with_sources("assets", "prices", src=src) + f""",
agg AS (
  SELECT p.asset_id,
         CAST(first(p.buy_price ORDER BY p."timestamp", p.price_id) AS DECIMAL(18,4)) AS open_buy_price,
         CAST(first(p.buy_price ORDER BY p."timestamp" DESC, p.price_id DESC) AS DECIMAL(18,4)) AS close_buy_price,
         CAST(min(p.buy_price) AS DECIMAL(18,4)) AS min_buy_price,
         CAST(max(p.buy_price) AS DECIMAL(18,4)) AS max_buy_price,
         CASE WHEN {c} > 0 THEN {from_units(a4, 4, 18)} END AS avg_spread,
         count(p."timestamp") AS sample_points
  FROM prices p
  WHERE CAST(p."timestamp" AS DATE) = DATE '{day}'
  GROUP BY p.asset_id)
SELECT DATE '{day}' AS price_date, a.asset_id, a.asset_symbol, a.asset_type, g.open_buy_price,
       g.close_buy_price, g.min_buy_price, g.max_buy_price, g.avg_spread, g.sample_points
FROM agg g JOIN assets a ON g.asset_id = a.asset_id"""


def goal_sql(day: str = D_ORDERS, src: dict | None = None) -> str:
    return with_sources("users", "goals", src=src) + f""",
j AS (SELECT g.id AS goal_id, g.user_id, u.name AS user_name, g.title AS goal_title,
             CAST(g.target_amount AS DECIMAL(18,2)) AS target_amount,
             CAST(coalesce(g.current_amount, 0) AS DECIMAL(18,2)) AS current_amount,
             g.deadline, CAST(date_diff('day', DATE '{day}', g.deadline) AS INTEGER) AS days_remaining,
             g.status
      FROM goals g JOIN users u ON g.user_id = u.id)
SELECT DATE '{day}' AS snapshot_date, goal_id, user_id, user_name, goal_title, target_amount,
       current_amount, {safe_pct_sql('current_amount', 'target_amount')} AS completion_rate_pct,
       deadline, days_remaining,
       CASE WHEN current_amount >= target_amount THEN 'completed'
            WHEN days_remaining < 0 THEN 'behind_schedule' ELSE status END AS status
FROM j"""


def mart_sql() -> dict[str, str]:
    return {
        "asset_holdings_asof": asset_holdings_sql(),
        "holdings_incremental": asset_holdings_sql(),
        "portfolio_day_stats": portfolio_stats_sql(),
        "user_cashflow": cashflow_sql(),
        "budget_performance": budget_sql(),
        "asset_price_summary": price_summary_sql(),
        "goal_progress": goal_sql(),
    }


# ---- single operators --------------------------------------------------------

FIXED_RUN_TS = "2024-01-15 21:00:00"
MONEY_LINES = ("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, "
               "CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_discount AS DECIMAL(18,2)) AS discount, "
               "CAST(l_tax AS DECIMAL(18,2)) AS tax FROM lineitem")
AUDIT_SRC = {
    "principals": ("SELECT c_name AS principal_name FROM customer UNION ALL "
                   "SELECT s_name AS principal_name FROM supplier"),
    "principal_roles": ("SELECT c.c_name AS principal_name, r.o_orderpriority AS principal_role FROM "
                        "(SELECT DISTINCT o_custkey, o_orderpriority FROM orders) r "
                        "JOIN customer c ON r.o_custkey = c.c_custkey"),
    "role_catalog_roles": ("SELECT * FROM (VALUES ('1-URGENT', 'AFRICA'), ('1-URGENT', 'ASIA'), "
                           "('2-HIGH', 'EUROPE'), ('3-MEDIUM', 'GHOST')) v(principal_role, catalog_role)"),
    "grants": ("SELECT r.r_name AS catalog_role, 'namespace' AS grant_type, n.n_name AS privilege, "
               "n.n_nationkey AS grant_order FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
}
AUDIT_WITH = "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in AUDIT_SRC.items()) + ",\n" + """
privs AS (SELECT catalog_role,
                 string_agg(coalesce(grant_type, 'None') || ':' || coalesce(privilege, 'None'), ', '
                            ORDER BY grant_order) AS privileges
          FROM grants GROUP BY catalog_role),
lookup AS (SELECT p.principal_name, pr.principal_role, rc.catalog_role
           FROM principals p LEFT JOIN principal_roles pr ON p.principal_name = pr.principal_name
           LEFT JOIN role_catalog_roles rc ON pr.principal_role = rc.principal_role)
"""

PRICE_ROWS = ("SELECT event_id AS price_id, user_id AS asset_id, ts AS \"timestamp\", "
              "CAST(ts AS DATE) AS price_day, CAST(value AS DECIMAL(18,4)) AS buy_price FROM events")


def single_operator_sql() -> dict[str, str]:
    d_o, d_e = D_ORDERS, D_EVENTS
    q = {}
    q["filter_asof_day"] = (f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem "
                            f"WHERE CAST(l_shipdate AS DATE) <= DATE '{d_o}'")
    q["filter_on_day"] = (f"SELECT event_id, user_id, event_type, value, ts FROM events "
                          f"WHERE CAST(ts AS DATE) = DATE '{d_e}'")
    q["filter_raw_date"] = (f"SELECT o_orderkey, o_custkey, o_orderdate FROM orders "
                            f"WHERE o_orderdate = TIMESTAMP '{d_o} 00:00:00'")
    q["filter_month_to_date"] = (f"SELECT o_orderkey, o_custkey, o_orderdate FROM orders "
                                 f"WHERE o_orderdate >= TIMESTAMP '{d_o[:8]}01 00:00:00' "
                                 f"AND o_orderdate <= TIMESTAMP '{d_o} 00:00:00'")
    q["filter_any_positive"] = ("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem "
                                "WHERE l_discount > 0 OR l_tax > 0")
    q["project_rename"] = "SELECT c_custkey AS user_id, c_name AS user_name FROM customer"
    q["stamp_columns"] = (f"SELECT c_custkey AS user_id, c_name AS user_name, DATE '{d_o}' AS snapshot_date, "
                          f"TIMESTAMP '{FIXED_RUN_TS}' AS created_at FROM customer")
    q["fill_nulls"] = ("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic "
                       "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
    q["derive_flag"] = "SELECT l_orderkey, l_linenumber, l_tax > l_discount AS tax_over_discount FROM lineitem"
    q["join_inner_expr"] = ("SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, p.p_brand FROM lineitem l "
                            "JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey")
    q["join_inner_using"] = (with_sources("budgets", "categories") +
                             "SELECT b.user_id, b.category_id, c.name AS category_name, b.amount "
                             "FROM budgets b JOIN categories c ON b.category_id = c.id")
    totals = (with_sources("users", "income", "expense", "fixed_pay", "fixed_exp") + """,
inc AS (SELECT user_id, CAST(sum(amount) AS DECIMAL(28,2)) AS inc_amt FROM income GROUP BY user_id),
exp AS (SELECT user_id, CAST(sum(amount) AS DECIMAL(28,2)) AS exp_amt FROM expense GROUP BY user_id),
fix AS (SELECT f.user_id, CAST(sum(p.amount) AS DECIMAL(28,2)) AS fix_amt
        FROM fixed_pay p JOIN fixed_exp f ON p.expense_id = f.id GROUP BY f.user_id)
""")
    q["join_left_chain"] = totals + (
        "SELECT u.id AS user_id, u.name AS user_name, inc.inc_amt, exp.exp_amt, fix.fix_amt FROM users u "
        "LEFT JOIN inc ON u.id = inc.user_id LEFT JOIN exp ON u.id = exp.user_id "
        "LEFT JOIN fix ON u.id = fix.user_id")
    q["join_header_detail"] = totals + "SELECT user_id, fix_amt FROM fix"
    q["join_left_composite"] = with_sources("budgets", "cat_expense") + f""",
spent AS (SELECT user_id, category_id, CAST(sum(amount) AS DECIMAL(28,2)) AS actual_spent FROM cat_expense
          WHERE date >= DATE '{d_o[:8]}01' AND date <= DATE '{d_o}' GROUP BY user_id, category_id)
SELECT b.user_id, b.category_id, b.amount AS budget_amount, s.actual_spent FROM budgets b
LEFT JOIN spent s ON b.user_id = s.user_id AND b.category_id = s.category_id"""
    q["join_lookup_default"] = AUDIT_WITH + (
        "SELECT principal_name, coalesce(principal_role, 'NONE') AS principal_role, "
        "coalesce(catalog_role, 'NONE') AS catalog_role FROM lookup")
    q["access_matrix"] = AUDIT_WITH + """
SELECT l.principal_name, coalesce(l.principal_role, 'NONE') AS principal_role,
       'main' AS catalog_name, coalesce(l.catalog_role, 'NONE') AS catalog_role,
       CASE WHEN l.principal_role IS NULL OR l.catalog_role IS NULL THEN 'NULL'
            ELSE coalesce(p.privileges, 'NO_GRANTS') END AS privileges
FROM lookup l LEFT JOIN privs p ON l.catalog_role = p.catalog_role"""
    q["access_matrix_from_listings"] = q["access_matrix"]
    q["agg_privilege_list"] = AUDIT_WITH + "SELECT catalog_role, privileges FROM privs"
    q["orphan_files"] = (f"SELECT o_orderkey AS file_id, o_orderdate AS modified_at FROM orders "
                         f"WHERE o_orderdate < TIMESTAMP '{d_o} 00:00:00' - INTERVAL 1 DAY "
                         f"AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
    q["orphan_addresses"] = q["orphan_files"]
    q["anti_join_prefiltered"] = q["orphan_files"]
    q["join_bucketed"] = ("SELECT o_custkey, c_name, count(*) AS n_orders, "
                          "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total "
                          "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_name")
    q["jdbc_splits"] = "SELECT count(*) AS n_rows, true AS even, true AS enough FROM lineitem"
    q["agg_sum_by_key"] = with_sources("income") + (
        "SELECT user_id, CAST(sum(amount) AS DECIMAL(28,2)) AS total_income FROM income GROUP BY user_id")
    q["agg_sum_composite"] = with_sources("cat_expense") + (
        "SELECT user_id, category_id, CAST(sum(amount) AS DECIMAL(18,2)) AS total_spent "
        "FROM cat_expense GROUP BY user_id, category_id")
    s = "sum(" + units("total_value", 4) + ")"
    c = "count(total_value)"
    avg4 = half_up(half_up(f"{s} * 100", c), "100")
    q["agg_stats"] = with_sources("summary") + f"""
SELECT user_id, CASE WHEN {c} > 0 THEN {from_units(avg4, 4)} END AS avg_total_value,
       CAST(min(total_value) AS DECIMAL(38,4)) AS min_total_value,
       CAST(max(total_value) AS DECIMAL(38,4)) AS max_total_value, {c} AS count_total_value
FROM summary GROUP BY user_id"""
    q["agg_first_constant"] = ("SELECT c.c_nationkey, any_value(n.n_name) AS nation_name, count(*) AS n_customers "
                               "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
                               "GROUP BY c.c_nationkey")
    q["compaction_plan"] = """
SELECT source, count(*) AS total_files, count(*) FILTER (WHERE n_chars < 4000) AS small_files,
       CAST(coalesce(sum(n_chars) FILTER (WHERE n_chars < 4000), 0) AS BIGINT) AS small_bytes,
       CAST(ceil(coalesce(sum(n_chars) FILTER (WHERE n_chars < 4000), 0) / 4000) AS BIGINT) AS target_files
FROM documents GROUP BY source HAVING count(*) FILTER (WHERE n_chars < 4000) > 1"""
    q["compaction_bins"] = """
WITH small AS (SELECT source, doc_id, n_chars FROM documents WHERE n_chars < 4000),
line AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING
                AND 1 PRECEDING), 0) AS before FROM small),
bins AS (SELECT *, CAST(before // 16000 AS BIGINT) AS bin FROM line),
packs AS (SELECT source, bin, count(*) AS bin_files, CAST(sum(n_chars) AS BIGINT) AS bin_bytes FROM bins GROUP BY source, bin)
SELECT b.source, b.doc_id, b.n_chars, b.bin, p.bin_files, p.bin_bytes
FROM bins b JOIN packs p ON b.source IS NOT DISTINCT FROM p.source AND b.bin = p.bin WHERE p.bin_files > 1"""
    for key, alias, order in (("window_first_asc", "open_buy_price", "\"timestamp\", price_id"),
                              ("window_first_desc", "close_buy_price",
                               "\"timestamp\" DESC, price_id DESC")):
        q[key] = (f"SELECT price_id, asset_id, price_day, first_value(buy_price) OVER "
                  f"(PARTITION BY asset_id, price_day ORDER BY {order} "
                  f"ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS {alias} "
                  f"FROM ({PRICE_ROWS})")
    q["snapshot_retention"] = """
WITH s AS (SELECT user_id AS table_name, event_id AS snapshot_id, ts AS committed_at FROM events),
cur AS (SELECT table_name, first(snapshot_id ORDER BY committed_at DESC, snapshot_id DESC) AS snapshot_id
        FROM s GROUP BY table_name)
SELECT s.table_name, s.snapshot_id, s.committed_at FROM s
WHERE s.committed_at < (SELECT max(committed_at) FROM s) - INTERVAL 3 DAY
  AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.table_name = s.table_name AND cur.snapshot_id = s.snapshot_id)"""
    expiry = """
WITH s AS (SELECT user_id AS table_name, event_id AS snapshot_id, ts AS committed_at FROM events),
m AS (SELECT table_name, snapshot_id, unnest([CAST(CAST(committed_at AS DATE) - CAST(k AS INTEGER) AS VARCHAR) FOR k IN range(0, 5)]
             || ['own-' || CAST(snapshot_id AS VARCHAR)]) AS name FROM s),
files AS (SELECT table_name, snapshot_id, '/wh/' || CAST(table_name AS VARCHAR) || '/' || name AS path,
                 CAST(length(name) * 100 AS BIGINT) AS length FROM m),
old AS (SELECT s.* FROM s WHERE committed_at < (SELECT max(committed_at) FROM s) - INTERVAL 3 DAY
        AND snapshot_id <> (SELECT first(x.snapshot_id ORDER BY x.committed_at DESC, x.snapshot_id DESC) FROM s x
                            WHERE x.table_name = s.table_name)),
dead AS (SELECT f.table_name, f.path, max(f.length) AS length, count(DISTINCT f.snapshot_id) AS held_by
         FROM files f JOIN old USING (table_name, snapshot_id)
         WHERE f.path NOT IN (SELECT path FROM files g WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.snapshot_id = g.snapshot_id))
         GROUP BY f.table_name, f.path)"""
    q["expired_files"] = expiry + " SELECT table_name, path, length, held_by FROM dead"
    q["snapshot_expiry"] = expiry + """
SELECT s.table_name, count(DISTINCT s.snapshot_id) AS n_snapshots, count(DISTINCT old.snapshot_id) AS n_expired,
       coalesce(any_value(d.n), 0) AS files_freed, CAST(coalesce(any_value(d.b), 0) AS BIGINT) AS bytes_freed,
       coalesce(any_value(t.n), 0) - coalesce(any_value(d.n), 0) AS files_shared
FROM s LEFT JOIN old USING (snapshot_id)
LEFT JOIN (SELECT table_name, count(*) AS n, sum(length) AS b FROM dead GROUP BY table_name) d ON d.table_name = s.table_name
LEFT JOIN (SELECT f.table_name, count(DISTINCT f.path) AS n FROM files f JOIN old USING (table_name, snapshot_id) GROUP BY f.table_name) t
  ON t.table_name = s.table_name
GROUP BY s.table_name"""
    q["sort_multi_key"] = ("SELECT c_nationkey, c_mktsegment, c_name, c_custkey FROM customer "
                           "ORDER BY c_nationkey, c_mktsegment, c_name")
    q["limit_rows"] = ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
                       "ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
    q["fn_to_date"] = "SELECT event_id, CAST(ts AS DATE) AS event_day FROM events"
    q["fn_datediff"] = (f"SELECT o_orderkey, CAST(date_diff('day', DATE '{d_o}', CAST(o_orderdate AS DATE)) "
                        f"AS INTEGER) AS days_from_report FROM orders")
    q["fn_month_start"] = "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS order_month FROM orders"
    q["fn_parse_date"] = ("SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) "
                          "AS order_day FROM orders")
    q["fn_now"] = "SELECT event_id, true AS one_value, true AS not_before_event FROM events"
    q["fn_coalesce"] = with_sources("goals") + (
        "SELECT id AS goal_id, CAST(coalesce(current_amount, 0) AS DECIMAL(18,2)) AS current_amount FROM goals")
    q["fn_when_chain"] = with_sources("goals") + f"""
SELECT id AS goal_id,
       CASE WHEN CAST(coalesce(current_amount, 0) AS DECIMAL(18,2)) >= target_amount THEN 'completed'
            WHEN date_diff('day', DATE '{d_o}', deadline) < 0 THEN 'behind_schedule'
            ELSE status END AS status
FROM goals"""
    q["fn_safe_pct"] = (f"SELECT l_orderkey, l_linenumber, {safe_pct_sql('tax', 'discount')} AS tax_pct "
                        f"FROM ({MONEY_LINES})")
    amt = "CAST(price AS DECIMAL(38,2)) * CAST(discount AS DECIMAL(38,2))"
    q["fn_decimal_cast"] = f"""
SELECT l_orderkey, l_linenumber, CAST({amt} AS DECIMAL(18,2)) AS disc_money,
       CAST({amt} AS DECIMAL(18,4)) AS disc_price, CAST({amt} AS DECIMAL(38,8)) AS disc_quantity,
       CAST({amt} AS DECIMAL(38,4)) AS disc_portfolio, TRY_CAST(price AS DECIMAL(5,2)) AS price_pct_type
FROM ({MONEY_LINES})"""
    q20 = half_up(f"{units('price', 2)} * {pow10(20)}", units("qty", 2))
    unit4 = half_up(q20, pow10(16))
    q["fn_arithmetic"] = f"""
SELECT l_orderkey, l_linenumber,
       CAST({amt} AS DECIMAL(37,4)) AS disc_amount,
       CAST(CAST(price AS DECIMAL(38,4)) - {amt} AS DECIMAL(38,4)) AS net_price,
       CAST(CAST(price AS DECIMAL(38,4)) + CAST(price AS DECIMAL(38,2)) * CAST(tax AS DECIMAL(38,2))
            AS DECIMAL(38,4)) AS gross_price,
       {from_units(unit4, 4, 18)} AS unit_price
FROM ({MONEY_LINES})"""
    q["fn_concat_colon"] = ("SELECT n_nationkey AS grant_order, 'namespace:' || n_name AS grant_entry FROM nation")
    q["fn_json_fallback"] = ("SELECT c.c_custkey AS principal_id, r.o_orderpriority AS principal_role "
                             "FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) r "
                             "ON c.c_custkey = r.o_custkey")
    q["fn_bytes_to_kb"] = "SELECT doc_id, round(n_chars / 1024, 2) AS size_kb FROM documents"
    return q


# ---- sinks, DDL and the daily run -------------------------------------------------

# supplied table -> its key column
TABLE_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
              "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id",
              "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
              "labels": "doc_id", "conversations": "conv_id"}
GIVEN_TABLES = list(TABLE_KEYS)

# mart -> its key column and the decimal columns whose exact sums are compared
MART_DIGEST = {
    "daily_user_asset_holdings": ("user_id", ["total_quantity", "total_quantity", "total_quantity"]),
    "daily_user_portfolio_stats": ("user_id", ["avg_portfolio_value", "min_portfolio_value", "max_portfolio_value"]),
    "daily_user_cashflow": ("user_id", ["total_income", "total_variable_expense", "net_cashflow"]),
    "monthly_budget_performance": ("user_id", ["actual_spent", "remaining_amount", "utilization_rate_pct"]),
    "daily_asset_price_summary": ("asset_id", ["open_buy_price", "close_buy_price", "avg_spread"]),
    "daily_goal_progress_stats": ("goal_id", ["target_amount", "current_amount", "completion_rate_pct"]),
}


def _prev(day: str) -> str:
    import datetime as _dt
    return (_dt.date.fromisoformat(day) - _dt.timedelta(days=1)).isoformat()


def sink_sql() -> dict[str, str]:
    q = {}
    goal = goal_sql()
    q["table_scan"] = "SELECT * FROM customer"
    q["rows_with_schema"] = "SELECT p_name AS ITEM_NAME, p_size AS QUANTITY FROM part"
    q["create_namespace"] = " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, count(DISTINCT {key}) AS n_keys FROM {n}"
        for n, key in TABLE_KEYS.items())
    q["file_inventory"] = " UNION ALL ".join(
        f"SELECT '{n}.parquet' AS key, count(*) AS n_rows, true AS sizes_agree FROM {n}" for n in GIVEN_TABLES)
    q["catalog_listing"] = " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, true AS namespace_listed FROM {n}" for n in GIVEN_TABLES)
    q["create_table"] = goal
    q["ensure_table"] = goal
    q["insert_values"] = ("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS job FROM customer UNION ALL "
                          "VALUES (-1, 'Ann', 'Engineer'), (-2, 'Bob', NULL)")
    q["append_sink"] = f"({goal}) UNION ALL ({goal})"
    q["partition_overwrite_sink"] = (f"({price_summary_sql(_prev(D_EVENTS))}) UNION ALL "
                                     f"({price_summary_sql(D_EVENTS)})")
    q["overwrite_sink"] = goal
    q["compact_table"] = ("SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS total_chars, "
                          "count(DISTINCT doc_id) AS n_ids, CAST(sum(length(text)) AS BIGINT) AS text_chars, "
                          "count(DISTINCT md5(text)) AS n_texts, min(md5(concat_ws('|', doc_id, lang, text))) AS least_row, "
                          "max(md5(concat_ws('|', doc_id, lang, text))) AS greatest_row FROM documents GROUP BY source")
    builders = [("daily_user_asset_holdings", asset_holdings_sql, "snapshot_date"),
                ("daily_user_portfolio_stats", portfolio_stats_sql, "snapshot_date"),
                ("daily_user_cashflow", cashflow_sql, "summary_date"),
                ("monthly_budget_performance", budget_sql, "budget_month"),
                ("daily_asset_price_summary", price_summary_sql, "price_date"),
                ("daily_goal_progress_stats", goal_sql, "snapshot_date")]
    parts = []
    for name, build, date_col in builders:
        for day in (D_ORDERS, D_EVENTS):
            key, sums = MART_DIGEST[name]
            totals = ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(28,8))) AS DECIMAL(38,8)) AS sum_{k}"
                               for k, c in enumerate(sums))
            parts.append(f"SELECT '{name}' AS mart, {date_col} AS report_date, count(*) AS n_rows, "
                         f"count(DISTINCT {key}) AS n_keys, {totals} FROM ({build(day)}) GROUP BY {date_col}")
    q["daily_marts_run"] = " UNION ALL ".join(f"({p})" for p in parts)
    q["daily_marts_tables"] = q["daily_marts_run"]
    q["daily_marts_published"] = q["daily_marts_run"]
    return q


def oracle_sql() -> dict[str, str]:
    out = mart_sql()
    out.update(single_operator_sql())
    out.update(sink_sql())
    return out
