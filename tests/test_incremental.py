"""Holdings from daily sums, and the run ledger (write, audit, publish)."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.oracle import D_EVENTS, FIXED_RUN_TS
from ledgerline.plans import holdings_state, marts, run_ledger
from ledgerline.plans.schemas import MART_DDL
from ledgerline.session import fresh_path
from ledgerline.sources import finance, storage
from ledgerline.sources.tables import TableSet

SCHEMA = "user_id long, asset_id long, asset_sub_type string, quantity decimal(38,8), record_date timestamp"


def records(seed, days, n=150):
    rng = random.Random(seed)
    return [(rng.randrange(6), rng.randrange(4), rng.choice(["a", "b", None]), Decimal(rng.randrange(-500, 900)) / 100,
             rng.choice([None] + [dt.datetime(2024, 1, d, rng.randrange(24)) for d in days] * 3)) for _ in range(n)]


@pytest.fixture(scope="module")
def dimensions(spark):
    return (spark.createDataFrame([(i, f"u{i}") for i in range(5)], "id long, name string"),
            spark.createDataFrame([(i, f"s{i}", f"n{i}", "t") for i in range(4)], "asset_id long, asset_symbol string, asset_name string, asset_type string"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def check(spark, dimensions, stored, state, days):
    for day in days:
        got = holdings_state.asset_holdings(spark, state, *dimensions, day, FIXED_RUN_TS)
        want = marts.asset_holdings(spark.createDataFrame(stored, SCHEMA), *dimensions, day, FIXED_RUN_TS)
        assert got.schema == want.schema and rows(got) == rows(want), day


@pytest.mark.parametrize("grain", ["day", "month"])
def test_state_equals_a_full_scan(spark, dimensions, grain):
    source, state = fresh_path(spark, "src"), fresh_path(spark, "state")
    stored = records(1, [1, 2, 3])
    put = lambda new, mode="append": holdings_state.store_by_day(
        spark.createDataFrame(new, SCHEMA), source, mode, grain)
    days = ["2023-12-31", "2024-01-02", "2024-01-20"]
    put(stored)
    first = holdings_state.refresh(spark, source, state)
    assert set(first.values()) == {"new"} and len(first) == (3 if grain == "day" else 1)
    check(spark, dimensions, stored, state, days)
    assert holdings_state.refresh(spark, source, state) == {}
    late = records(2, [2, 9])                              # late rows for a known day, and a new day
    put(late)
    stored += late
    changed = holdings_state.refresh(spark, source, state)
    assert changed == ({"2024-01-02": "changed", "2024-01-09": "new"} if grain == "day" else {"2024-01-01": "changed"})
    check(spark, dimensions, stored, state, days)
    if grain == "day":
        fixed = records(3, [3], 20)                        # a day is corrected, another one deleted
        put(fixed, "overwrite")
        fs, to_path = storage.filesystem(spark, source)
        fs.delete(to_path(f"{source}/record_day=2024-01-01"), True)
        gone = {dt.date(2024, 1, 1), dt.date(2024, 1, 3)}
        stored = [r for r in stored if r[4] is None or r[4].date() not in gone] + fixed
        assert holdings_state.refresh(spark, source, state) == {"2024-01-03": "changed", "2024-01-01": "removed"}
        check(spark, dimensions, stored, state, days)
        assert holdings_state.vacuum(spark, state, keep=1) >= 2
        check(spark, dimensions, stored, state, days)
    assert holdings_state.refresh(spark, source, state) == {}


def test_unchanged_days_are_not_read(spark, dimensions):
    source, state = fresh_path(spark, "src"), fresh_path(spark, "state")
    stored = records(4, [1, 2])
    holdings_state.store_by_day(spark.createDataFrame(stored, SCHEMA), source)
    holdings_state.refresh(spark, source, state)
    for name in os.listdir(f"{source}/record_day=2024-01-01"):         # unreadable, but of the same size and time
        path = f"{source}/record_day=2024-01-01/{name}"
        stat = os.stat(path)
        open(path, "wb").write(b"x" * stat.st_size)
        os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    late = records(5, [2])
    holdings_state.store_by_day(spark.createDataFrame(late, SCHEMA), source)
    assert holdings_state.refresh(spark, source, state) == {"2024-01-02": "changed"}
    check(spark, dimensions, stored + late, state, ["2024-01-05"])
    sums = holdings_state.daily_sums(spark, state, "2024-01-01")        # later days are not read either
    assert {f.rsplit("/", 2)[1] for f in sums.inputFiles()} == {"record_day=2024-01-01"}


def test_an_interrupted_refresh_leaves_the_state_alone(spark, dimensions, monkeypatch):
    source, state = fresh_path(spark, "src"), fresh_path(spark, "state")
    stored = records(6, [1, 2])
    holdings_state.store_by_day(spark.createDataFrame(stored, SCHEMA), source)
    holdings_state.refresh(spark, source, state)
    late = records(7, [1])
    holdings_state.store_by_day(spark.createDataFrame(late, SCHEMA), source)
    with monkeypatch.context() as m:
        m.setattr(holdings_state, "children", lambda *a: 1 / 0)          # after the sums were written
        with pytest.raises(ZeroDivisionError):
            holdings_state.refresh(spark, source, state)
    check(spark, dimensions, stored, state, ["2024-01-05"])
    assert holdings_state.refresh(spark, source, state) == {"2024-01-01": "changed"}
    check(spark, dimensions, stored + late, state, ["2024-01-05"])


def test_empty_state(spark, dimensions):
    state = fresh_path(spark, "state")
    assert holdings_state.asset_holdings(spark, state, *dimensions, "2024-01-01").collect() == []
    source = fresh_path(spark, "src")
    holdings_state.store_by_day(spark.createDataFrame(records(8, [1], 30), SCHEMA), source)
    holdings_state.refresh(spark, source, state)
    assert holdings_state.asset_holdings(spark, state, *dimensions, "2023-01-01").collect() == []


# ---------------------------------------------------------------- run ledger

@pytest.fixture(scope="module")
def sources(spark):
    return finance.from_tables(TableSet(spark, SF_SMALL))


def content(spark, root):
    out = {}
    for name in MART_DDL:
        path = f"{root}/{name}"
        if os.path.isdir(path):
            out[name] = rows(spark.read.schema(MART_DDL[name][0]).parquet(path))
    return out


@pytest.fixture(scope="module")
def whole(spark, sources):
    root = fresh_path(spark, "whole")
    assert set(run_ledger.publish_day(sources, root, D_EVENTS, FIXED_RUN_TS).values()) == {"published"}
    return content(spark, root)


def test_a_failed_mart_is_repeated_once(spark, sources, whole):
    root = fresh_path(spark, "ledger")
    stop = {"monthly_budget_performance": run_ledger.Audit(("user_id",), {"stop": "true"})}
    with pytest.raises(run_ledger.AuditFailed, match="monthly_budget_performance.*stop"):
        run_ledger.publish_day(sources, root, D_EVENTS, FIXED_RUN_TS, audits=stop)
    assert "monthly_budget_performance" not in content(spark, root)
    again = run_ledger.publish_day(sources, root, D_EVENTS, FIXED_RUN_TS)
    assert again.pop("monthly_budget_performance") == "published" and set(again.values()) == {"skipped"}
    assert content(spark, root) == whole
    assert set(run_ledger.publish_day(sources, root, D_EVENTS, FIXED_RUN_TS).values()) == {"skipped"}
    assert os.listdir(f"{root}/_staging") == []
    record = run_ledger.published(spark, root, D_EVENTS, "daily_user_cashflow")
    assert record["rows"] == len(whole["daily_user_cashflow"])
    assert run_ledger.published(spark, root, "1999-01-01", "daily_user_cashflow") is None


def test_replace_publishes_a_day_again(spark, sources, whole):
    root = fresh_path(spark, "replaced")
    some = ["daily_user_cashflow", "daily_asset_price_summary"]
    run_ledger.publish_day(sources, root, D_EVENTS, FIXED_RUN_TS, marts=some)
    other = content(spark, root)
    assert set(run_ledger.publish_day(sources, root, D_EVENTS, FIXED_RUN_TS, marts=some, replace=True).values()) == {"published"}
    assert content(spark, root) == other == {k: whole[k] for k in some}
    with pytest.raises(ValueError):
        run_ledger.publish_day(sources, root, D_EVENTS, marts=["nothing"])


class Killed(Exception):
    pass


def test_a_publication_killed_anywhere_is_finished(spark, sources, whole, monkeypatch):
    mart = "daily_user_portfolio_stats"
    steps = {"move": run_ledger.move, "write_text": run_ledger.write_text}
    outcomes, k = set(), 0
    while True:
        root, left = fresh_path(spark, "killed"), [k]

        def counted(real):
            def step(*args):
                if not left[0]:
                    raise Killed
                left[0] -= 1
                return real(*args)
            return step

        with monkeypatch.context() as m:
            for name, real in steps.items():
                m.setattr(run_ledger, name, counted(real))
            try:
                run_ledger.publish_day(sources, root, D_EVENTS, FIXED_RUN_TS, marts=[mart])
                break
            except Killed:
                pass
        outcomes |= set(run_ledger.publish_day(sources, root, D_EVENTS, FIXED_RUN_TS, marts=[mart]).values())
        assert content(spark, root) == {mart: whole[mart]}, k
        assert os.listdir(f"{root}/_staging") == []
        k += 1
    assert k >= 3 and outcomes == {"published", "finished"}


def test_audits_find_broken_rows(spark):
    ddl = MART_DDL["daily_user_cashflow"][0]
    day = dt.date(2024, 1, 2)
    good = (day, 1, "a", Decimal(10), Decimal(2), Decimal(3), Decimal(5), Decimal(50), None)
    bad = [(dt.date(2024, 1, 3), *good[1:]), (day, None, *good[2:]), (*good[:6], Decimal(6), *good[7:]),
           (day, 9, "z", Decimal(0), Decimal(0), Decimal(0), Decimal(0), None, None)]
    rules = run_ledger.AUDITS["daily_user_cashflow"]
    assert run_ledger.audit(spark.createDataFrame([good], ddl), "daily_user_cashflow", day, rules) == {}
    found = run_ledger.audit(spark.createDataFrame([good, *bad], ddl), "daily_user_cashflow", day, rules)
    assert found == {"report date": 1, "no key": 1, "net": 1, "activity": 1, "repeated key": 1}
    assert run_ledger.audit(spark.createDataFrame([], ddl), "daily_user_cashflow", day, rules) == {}
