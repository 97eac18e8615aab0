"""Every registered query against its DuckDB oracle (order-insensitive multiset)."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_ORACLE, SF_SMALL
from ledgerline import oracle, registry
from ledgerline.typecheck import mismatched_types

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SQL = oracle.oracle_sql()
# heavier keys are checked at sf0.01 (the driver's scale), the rest at sf0.001
AT_SF001 = {"asset_holdings_asof", "user_cashflow", "budget_performance", "goal_progress",
            "access_matrix", "portfolio_day_stats", "asset_price_summary"}


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, float):
        return f"{v:.10g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


_cons = {}


def duck(sf_dir):
    if sf_dir not in _cons:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        _cons[sf_dir] = con
    return _cons[sf_dir]


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, key):
    sf_dir = SF_ORACLE if key in AT_SF001 else SF_SMALL
    df = entry.queries()[key](spark, sf_dir)
    srows = sorted(tuple(norm(x) for x in r) for r in df.collect())
    cur = duck(sf_dir).execute(SQL[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert mismatched_types(df.schema, cur.description) == []
    order = [dcols.index(c) for c in df.columns]
    drows = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    assert srows == drows


def test_every_query_has_oracle_or_is_listed(spark):
    assert set(registry.QUERIES) == set(oracle.oracle_sql())
    assert set(SQL) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["price_date", "asset_id"]
