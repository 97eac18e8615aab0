"""One dated run of all six marts into Parquet tables below ``root``.

Default write modes follow the original job: five marts append, the price
summary replaces its day's partition. ``idempotent=True`` replaces the
day's partition for every mart, so a rerun of the same day stores it once.
"""

from __future__ import annotations

import datetime as _dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ledgerline.functions.dates import as_date
from ledgerline.plans import marts
from ledgerline.plans.schemas import MART_PARTITION
from ledgerline.sources import sinks
from ledgerline.sources.finance import FinanceSources

OVERWRITES_BY_DEFAULT = {"daily_asset_price_summary"}


def build_marts(src: FinanceSources, day, run_ts=None) -> dict[str, DataFrame]:
    d = as_date(day)
    return {
        "daily_user_asset_holdings": marts.asset_holdings(
            src.portfolio_holdings, src.users, src.assets, d, run_ts),
        "daily_user_portfolio_stats": marts.portfolio_stats(
            src.portfolio_summary, src.users, d, run_ts),
        "daily_user_cashflow": marts.cashflow(
            src.users, src.income_transactions, src.expense_transactions,
            src.fixed_expense_payments, src.fixed_expenses, d, run_ts),
        "monthly_budget_performance": marts.budget_performance(
            src.budgets, src.expense_categories, src.category_expenses, d, run_ts),
        "daily_asset_price_summary": marts.price_summary(src.price_history, src.assets, d, run_ts),
        "daily_goal_progress_stats": marts.goal_progress(src.goals, src.users, d, run_ts),
    }


def run_daily(src: FinanceSources, root: str, target_date=None, run_ts=None,
              idempotent: bool = False, parallel: bool = True,
              persist_dimensions: bool = False, marts: list[str] | None = None) -> dict[str, str]:
    """Write every mart for ``target_date`` (default: today); returns mart -> path.

    With ``parallel`` the six writes are submitted as concurrent Spark jobs
    (from driver threads, no data passes through them), so small marts fill
    the slots a large one leaves idle. A failure of any mart is raised after
    the others have finished; each write is atomic per partition.

    ``persist_dimensions`` keeps users and assets (read by four and two marts)
    for the run: worth it for JDBC sources, where every re-read is a full
    remote scan; pointless for column-pruned Parquet. Lost cached blocks are
    recomputed from the source. ``marts`` restricts the run to some marts
    (e.g. only holdings and portfolio stats, as the original's second job).
    """
    d = as_date(target_date or _dt.date.today())
    root = root.rstrip("/")
    if persist_dimensions:
        users = src.users.persist(StorageLevel.MEMORY_AND_DISK)
        assets = src.assets.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return run_daily(replace(src, users=users, assets=assets), root, d, run_ts,
                             idempotent, parallel, persist_dimensions=False, marts=marts)
        finally:
            users.unpersist()
            assets.unpersist()
    jobs = []
    built = build_marts(src, d, run_ts)
    unknown = set(marts or []) - set(built)
    if unknown:
        raise ValueError(f"unknown marts: {sorted(unknown)}")
    for name, df in built.items():
        if marts and name not in marts:
            continue
        path, part = f"{root}/{name}", MART_PARTITION[name]
        if idempotent or name in OVERWRITES_BY_DEFAULT:
            jobs.append((name, path, lambda df=df, path=path, part=part:
                         sinks.overwrite_partitions(df, path, part)))
        else:
            jobs.append((name, path, lambda df=df, path=path, part=part: sinks.append(df, path, part)))
    if parallel:
        with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
            futures = [pool.submit(write) for _, _, write in jobs]
        errors = [f.exception() for f in futures if f.exception() is not None]
        if errors:
            raise errors[0]
    else:
        for _, _, write in jobs:
            write()
    return {name: path for name, path, _ in jobs}


def run_into_tables(src: FinanceSources, tables: dict[str, str], target_date, run_ts=None,
                    idempotent: bool = False) -> None:
    """Write every mart for one day into its catalog table (mart -> table name)."""
    for name, df in build_marts(src, target_date, run_ts).items():
        if idempotent or name in OVERWRITES_BY_DEFAULT:
            sinks.overwrite_table_partitions(df, tables[name])
        else:
            sinks.append_table(df, tables[name])


def register_marts(spark, namespace: str, paths: dict[str, str]) -> None:
    """Expose written marts as catalog tables ``<namespace>.<mart>`` for SQL
    (``SHOW TABLES IN ns``, ``SELECT ... FROM ns.daily_user_cashflow``)."""
    from ledgerline.plans.schemas import MART_DDL
    from ledgerline.sources import catalog

    from ledgerline.session import fresh_path

    catalog.create_namespace(spark, namespace, fresh_path(spark, namespace))   # no local warehouse dir
    for name, path in paths.items():
        ddl, part = MART_DDL[name]
        catalog.register_partitioned(spark, f"{namespace}.{name}", ddl, part, path)
        spark.sql(f"REFRESH TABLE {namespace}.{name}")


def main(argv=None) -> dict[str, str]:
    """spark-submit entry: ``python -m ledgerline.plans.daily_run --target-root PATH
    [--target-date YYYY-MM-DD] [--idempotent] (--tables-dir DIR | --jdbc-url URL
    [--jdbc-partitions N])``.

    ``--tables-dir`` holds the twelve source tables as ``<name>`` Parquet folders;
    with ``--jdbc-url`` they are read from ``<schema>.<name>``, credentials from
    LEDGERLINE_JDBC_USER / LEDGERLINE_JDBC_PASSWORD.
    """
    import argparse
    import os

    from ledgerline.session import build_session, input_bytes, size_session
    from ledgerline.sources import finance, jdbc

    ap = argparse.ArgumentParser(description="Write the six daily marts for one date.")
    ap.add_argument("--target-date", default=str(_dt.date.today()))
    ap.add_argument("--target-root", required=True)
    ap.add_argument("--idempotent", action="store_true",
                    help="replace the day in every mart; recommended: without it, as in the original, five marts "
                         "append, so repeating a day that failed half way stores the others twice")
    ap.add_argument("--input-gb", type=float, default=None,
                    help="size of the source data, to size shuffles of JDBC runs (measured for --tables-dir)")
    ap.add_argument("--marts", help="comma-separated subset of the six marts (default: all)")
    ap.add_argument("--namespace", help="also register the marts as catalog tables <namespace>.<mart>")
    group = ap.add_mutually_exclusive_group(required=True)
    group.add_argument("--tables-dir")
    group.add_argument("--jdbc-url")
    ap.add_argument("--jdbc-schema", default="public")
    ap.add_argument("--jdbc-partitions", type=int, default=1,
                    help="parallel range reads per source table; with the default of 1 each table comes through one "
                         "connection and one task, so raise it for large tables")
    args, _ = ap.parse_known_args(argv)
    day = as_date(args.target_date)                  # malformed dates fail here
    spark = build_session()
    if args.input_gb or args.tables_dir:
        size_session(spark, int(args.input_gb * 1e9) if args.input_gb else input_bytes(spark, args.tables_dir))
    if args.tables_dir:
        def read(name):
            return spark.read.parquet(f"{args.tables_dir.rstrip('/')}/{name}")
    else:
        def read(name):
            return jdbc.jdbc_scan(spark, args.jdbc_url, f"{args.jdbc_schema}.{name}",
                                  partition_column=finance.JDBC_SPLIT_COLUMN.get(name),
                                  num_partitions=args.jdbc_partitions,
                                  user=os.environ.get("LEDGERLINE_JDBC_USER"),
                                  password=os.environ.get("LEDGERLINE_JDBC_PASSWORD"))
    paths = run_daily(finance.from_named_tables(read), args.target_root, day, idempotent=args.idempotent,
                      persist_dimensions=bool(args.jdbc_url),
                      marts=args.marts.split(",") if args.marts else None)
    if args.namespace:
        register_marts(spark, args.namespace, paths)
    return paths


if __name__ == "__main__":
    main()
