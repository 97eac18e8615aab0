"""The daily run as write, audit, publish: every mart of a day is stored once.

The plain run appends, so a day that failed half way and is repeated stores the finished marts
twice. Here each mart is

1. *written* to a staging folder beside the marts,
2. *audited* there: columns, report date, keys and the mart's own rules,
3. *published*: the file moves are written down as a journal, carried out, and closed by a
   publish record of the (mart, day).

A repeated run skips what has a record, finishes what has a journal and starts the rest anew, whichever step an
earlier run stopped at. ``replace`` publishes a day again: exactly the files of its record go.
Five marts are added to their partition, as in the original; the price summary replaces it.
A failed audit publishes nothing of that mart and raises after the others.
Runs of the same day must not overlap. Folders below the target: one per mart, ``_ledger``, ``_staging``.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.dates import as_date
from ledgerline.plans.daily_run import OVERWRITES_BY_DEFAULT, build_marts
from ledgerline.plans.schemas import MART_COLUMNS, MART_DDL, MART_PARTITION
from ledgerline.sources.finance import FinanceSources
from ledgerline.sources.storage import children, data_files, filesystem, move, read_text, write_text


@dataclass(frozen=True)
class Audit:
    """``bad``: rule -> SQL condition that no row may meet. ``key``: columns that
    may not be NULL; ``unique``: whether no two rows may share them."""

    key: tuple[str, ...]
    bad: dict[str, str]
    unique: bool = True


AUDITS = {
    "daily_user_asset_holdings": Audit(("user_id", "asset_id"), {}, unique=False),      # per sub-type as well
    "daily_user_portfolio_stats": Audit(("user_id",), {
        "range": "min_portfolio_value > max_portfolio_value",
        "average": "avg_portfolio_value < min_portfolio_value - 0.0001 OR avg_portfolio_value > max_portfolio_value + 0.0001",
        "samples": "sample_count < 0 OR (sample_count = 0) <> (min_portfolio_value IS NULL)"}),
    "daily_user_cashflow": Audit(("user_id",), {
        "net": "net_cashflow <> total_income - total_variable_expense - total_fixed_expense",
        "activity": "NOT (total_income > 0 OR total_variable_expense > 0 OR total_fixed_expense > 0)"}),
    "monthly_budget_performance": Audit(("user_id", "category_id"), {
        "remaining": "remaining_amount <> budget_amount - actual_spent",
        "flag": "is_over_budget <> (actual_spent > budget_amount)"}, unique=False),         # budgets may repeat
    "daily_asset_price_summary": Audit(("asset_id",), {
        "range": "min_buy_price > max_buy_price",
        "open and close": "open_buy_price NOT BETWEEN min_buy_price AND max_buy_price OR close_buy_price NOT BETWEEN min_buy_price AND max_buy_price"}),
    "daily_goal_progress_stats": Audit(("goal_id",), {
        "status": "status = 'behind_schedule' AND NOT days_remaining < 0"}),
}


class AuditFailed(RuntimeError):
    """A staged mart breaks its rules; nothing of it was published."""


def audit(staged: DataFrame, mart: str, day, rules: Audit) -> dict[str, int]:
    """Rows that break each rule (only broken ones), from one pass over the
    staged mart and, for unique keys, one aggregation."""
    part = MART_PARTITION[mart]
    report_day = as_date(day).replace(day=1) if mart == "monthly_budget_performance" else as_date(day)
    rules_of_all = {"report date": F.coalesce(F.col(part) != F.lit(report_day), F.lit(True)),
                    "no key": F.greatest(*[F.col(k).isNull() for k in rules.key], F.lit(False))}
    found = rules_of_all | {name: F.coalesce(F.expr(sql), F.lit(False)) for name, sql in rules.bad.items()}
    row = staged.agg(*[F.count_if(c).alias(f"c{k}") for k, c in enumerate(found.values())]).first()
    broken = {name: row[f"c{k}"] for k, name in enumerate(found) if row[f"c{k}"]}
    if rules.unique:
        twice = staged.groupBy(*rules.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
        if twice:
            broken["repeated key"] = twice
    return broken


class DayLedger:
    """Publish records and journals of the marts below ``root``."""

    def __init__(self, spark: SparkSession, root: str, day):
        self.spark, self.root, self.day = spark, root.rstrip("/"), as_date(day)
        self.fs, self.to_path = filesystem(spark, self.root)

    def _path(self, mart: str, kind: str) -> str:
        return f"{self.root}/_ledger/{mart}/{self.day}.{kind}"

    def read(self, mart: str, kind: str) -> dict | None:
        path = self._path(mart, kind)
        return json.loads(read_text(self.fs, self.to_path, path)) if self.fs.exists(self.to_path(path)) else None

    def write(self, mart: str, kind: str, content: dict) -> None:
        write_text(self.fs, self.to_path, self._path(mart, kind), json.dumps(content))

    def close(self, mart: str, run: str) -> None:
        """The record stands: journal and staging folder of the run go."""
        self.fs.delete(self.to_path(self._path(mart, "journal")), False)
        self.fs.delete(self.to_path(self.staging(mart, run)), True)

    def staging(self, mart: str, run: str) -> str:
        return f"{self.root}/_staging/{mart}-{self.day}-{run}"

    def discard_staged(self, mart: str) -> None:
        """Folders of runs that stopped before their journal."""
        for name in children(self.fs, self.to_path, f"{self.root}/_staging"):
            if name.startswith(f"{mart}-{self.day}-"):
                self.fs.delete(self.to_path(f"{self.root}/_staging/{name}"), True)

    def finish(self, mart: str) -> bool:
        """Carry out the journal of an interrupted publication, if there is one."""
        journal, record = self.read(mart, "journal"), self.read(mart, "done")
        if journal is None:
            return False
        if record is None or record["run"] != journal["run"]:
            for source, target in journal["moves"]:
                move(self.fs, self.to_path(source), self.to_path(target))
            self.write(mart, "done", {k: journal[k] for k in ("run", "rows", "files")})
        self.close(mart, journal["run"])
        return True


def _publish(spark, book: DayLedger, mart: str, df: DataFrame, rules: Audit, replace: bool) -> str:
    if book.finish(mart) and not replace:
        return "finished"
    record = book.read(mart, "done")
    if record is not None and not replace:
        return "skipped"
    book.discard_staged(mart)
    run, part = uuid.uuid4().hex[:12], MART_PARTITION[mart]
    stage, home = book.staging(mart, run), f"{book.root}/{mart}"
    df.select(*MART_COLUMNS[mart]).write.partitionBy(part).parquet(f"{stage}/new")
    staged = spark.read.schema(MART_DDL[mart][0]).parquet(f"{stage}/new")
    broken = audit(staged, mart, book.day, rules)
    if broken:
        raise AuditFailed(f"{mart} of {book.day}: " + ", ".join(f"{k}: {n} rows" for k, n in broken.items()))
    old = list(record["files"]) if record else []
    files, moves = [], []
    for folder in (n for n in children(book.fs, book.to_path, f"{stage}/new") if n.startswith(f"{part}=")):
        if mart in OVERWRITES_BY_DEFAULT:
            old += [f"{home}/{folder}/{n}" for n in data_files(book.fs, book.to_path, f"{home}/{folder}")]
        for name in data_files(book.fs, book.to_path, f"{stage}/new/{folder}"):
            files.append(f"{home}/{folder}/{book.day}-{run}-{name}")
            moves.append([f"{stage}/new/{folder}/{name}", files[-1]])
    aside = [[p, f"{stage}/old/{k}"] for k, p in enumerate(dict.fromkeys(old))]
    book.write(mart, "journal", {"run": run, "rows": staged.count(), "files": files, "moves": aside + moves})
    book.finish(mart)
    return "published"


def publish_day(src: FinanceSources, root: str, target_date=None, run_ts=None, marts: list[str] | None = None,
                replace: bool = False, audits: dict[str, Audit] | None = None, parallel: bool = True) -> dict[str, str]:
    """Publish the marts of one day (default: today): mart -> published, finished
    (an interrupted run's publication was completed) or skipped (published before).

    ``audits`` replaces the rules of some marts. Errors of one mart do not keep the others from
    being published; the first is raised at the end.
    """
    spark, day = src.users.sparkSession, as_date(target_date or _dt.date.today())
    built = build_marts(src, day, run_ts)
    unknown = set(marts or []) - set(built)
    if unknown:
        raise ValueError(f"unknown marts: {sorted(unknown)}")
    rules = AUDITS | (audits or {})
    book = DayLedger(spark, root, day)
    jobs: dict[str, Callable[[], str]] = {
        name: lambda name=name, df=df: _publish(spark, book, name, df, rules[name], replace)
        for name, df in built.items() if not marts or name in marts}
    with ThreadPoolExecutor(max_workers=len(jobs) if parallel else 1) as pool:
        futures = {name: pool.submit(job) for name, job in jobs.items()}
    errors = [f.exception() for f in futures.values() if f.exception() is not None]
    for name in futures:
        spark.catalog.refreshByPath(f"{book.root}/{name}")
    if errors:
        raise errors[0]
    return {name: f.result() for name, f in futures.items()}


def published(spark: SparkSession, root: str, day, mart: str) -> dict | None:
    """Publish record of a mart's day: run, rows, files; None if it is not published."""
    return DayLedger(spark, root, day).read(mart, "done")
