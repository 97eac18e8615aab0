"""Relational sources over JDBC.

A bare JDBC read is one partition (one connection, one task). Given a
numeric or date ``partition_column`` with bounds, Spark issues
``num_partitions`` range queries in parallel instead. Filters and the
selected columns are pushed into the SQL sent to the database.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 driver: str | None = None, partition_column: str | None = None,
                 lower_bound=None, upper_bound=None, num_partitions: int | None = None,
                 fetch_size: int = 10000) -> dict:
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver:
        opts["driver"] = driver
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partitioned JDBC read needs lower_bound, upper_bound and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    return opts


def bounds_query(table: str, column: str) -> str:
    """One-row query for the range of ``column`` (evaluated by the database)."""
    return f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}"


def jdbc_scan(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              num_partitions: int | None = None, lower_bound=None, upper_bound=None,
              **kwargs) -> DataFrame:
    """Table scan; credentials come from the caller (never from code).

    With ``partition_column`` and ``num_partitions`` > 1 the scan is split into
    that many range queries. Missing bounds are read first with one aggregate
    query; the bounds only shape the ranges (rows outside them still land in
    the first/last range), so they need not be exact.
    """
    if partition_column and num_partitions and num_partitions > 1:
        if lower_bound is None or upper_bound is None:
            b = (spark.read.format("jdbc")
                 .options(**jdbc_options(url, f"({bounds_query(table, partition_column)}) b", **kwargs))
                 .load().first())
            if b is None or b[0] is None:            # empty table: one plain scan
                return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()
            lower_bound, upper_bound = b[0], b[1]
        opts = jdbc_options(url, table, partition_column=partition_column, lower_bound=lower_bound,
                            upper_bound=upper_bound, num_partitions=num_partitions, **kwargs)
    else:
        opts = jdbc_options(url, table, **kwargs)
    return spark.read.format("jdbc").options(**opts).load()


# ---------------------------------------------------------------- splits of equal size

STEP = 64                              # a cell is divided into so many finer ones
FIRST_CELLS = 4096                     # cells of the first, coarse histogram, at most
#: (low, high, width, heavy cells of STEP * width or None for all) -> {cell number: rows}, empty cells left out.
Histogram = Callable[[int, int, int, list[int] | None], dict[int, int]]


def histogram_query(table: str, column: str, low: int, high: int, width: int, heavy: list[int] | None) -> str:
    """Rows per cell of ``width`` values from low on (an integer column), counted
    by the database: one row per cell that is not empty."""
    cell = f"FLOOR(({column} - ({low})) / {float(width)})"
    where = f"{column} >= {low} AND {column} <= {high}"
    if heavy is not None:
        where += f" AND FLOOR(({column} - ({low})) / {float(width * STEP)}) IN ({', '.join(map(str, heavy))})"
    return f"SELECT {cell} AS cell, COUNT(*) AS n FROM {table} WHERE {where} GROUP BY {cell}"


def database_histogram(spark: SparkSession, url: str, table: str, column: str, **kwargs) -> Histogram:
    """Histograms of a database table's column."""
    def ask(low, high, width, heavy):
        query = f"({histogram_query(table, column, low, high, width, heavy)}) h"
        return {int(r[0]): int(r[1]) for r in spark.read.format("jdbc").options(**jdbc_options(url, query, **kwargs)).load().collect()}
    return ask


def frame_histogram(df: DataFrame, column: str) -> Histogram:
    """The same of a DataFrame's column."""
    def ask(low, high, width, heavy):
        cell = lambda w: F.floor((F.col(column).cast("decimal(38,0)") - F.lit(low)) / F.lit(w)).cast("long")
        rows = df.where(F.col(column).between(low, high))
        if heavy is not None:
            rows = rows.where(cell(width * STEP).isin(heavy))
        return {r[0]: r[1] for r in rows.groupBy(cell(width).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return ask


def _fine_cells(histogram: Histogram, low: int, high: int, parts: int) -> tuple[list[tuple[int, int, int]], float]:
    """((first value, values, rows) of cells in order, rows of a part). Cells that hold more than
    a 64th of a part are counted again, finer, down to single values: one question per level,
    answered with at most STEP * 64 * ``parts`` rows."""
    width = 1
    while (high - low) // width >= FIRST_CELLS:
        width *= STEP
    found = histogram(low, high, width, None)
    goal, fine = max(1.0, sum(found.values()) / parts), []
    while found:
        heavy = sorted(c for c, n in found.items() if n > goal / 64 and width > 1)
        fine += [(low + c * width, width, n) for c, n in found.items() if not (n > goal / 64 and width > 1)]
        width = max(1, width // STEP)
        found = histogram(low, high, width, heavy) if heavy else {}
    return sorted(fine), goal


def _pieces(rows: int, goal: float) -> int:
    """Parts to cut so many rows into, so that each is nearest to the goal as a ratio."""
    k = max(1, int(rows / goal))
    return k if rows * rows <= k * (k + 1) * goal * goal else k + 1


@dataclass(frozen=True)
class Part:
    """Values from ``first`` up to, not with, ``end``; the ``piece``-th of ``pieces`` of one hot value."""

    first: int
    end: int
    rows: float
    piece: int = 0
    pieces: int = 1


def equi_depth_parts(histogram: Histogram, low: int, high: int, parts: int, split_hot: bool = False) -> list[list[Part]]:
    """About ``parts`` groups of ranges that cover low to high, with about the same number of rows each.

    A value with more rows than a part stands alone (and is divided, with ``split_hot``); the
    stretches between such values are cut evenly, and short ones share a group. So groups are within about
    a factor of two of each other, whatever the skew, unless a hot value cannot be divided.
    """
    fine, goal = _fine_cells(histogram, low, high, parts)
    stretches, hot, open_ = [], [], []
    for at, width, n in fine:
        if width == 1 and n > goal:
            hot.append((at, n))
            stretches.append(open_)
            open_ = []
        else:
            open_.append((at, n))
    stretches.append(open_)
    edges = [low, *(v for at, _ in hot for v in (at, at + 1)), high + 1]
    done, short = [], []
    for k, members in enumerate(stretches):
        first, end, rows = edges[2 * k], edges[2 * k + 1], sum(n for _, n in members)
        if first >= end:
            continue
        many, cuts, filled = _pieces(rows, goal), [first], 0
        for at, n in members:
            if len(cuts) < many and filled + n / 2 >= rows * len(cuts) / many and at > cuts[-1]:
                cuts.append(at)
            filled += n
        for a, b in zip(cuts, [*cuts[1:], end]):
            part = Part(a, b, sum(n for at, n in members if a <= at < b))
            (short if part.rows * 2 * part.rows < goal * goal else done).append([part])
    for at, n in hot:
        many = _pieces(n, goal) if split_hot else 1
        done += [[Part(at, at + 1, n / many, k, many)] for k in range(many)]
    pool = []
    for group in short:
        pool += group
        if 2 * sum(p.rows for p in pool) ** 2 >= goal * goal:
            done.append(pool)
            pool = []
    if pool:
        (min(done, key=lambda g: sum(p.rows for p in g)) if done else done.append([]) or done[0]).extend(pool)
    return sorted(done, key=lambda g: (g[0].first, g[0].piece))


def part_predicates(column: str, groups: list[list[Part]], low: int, high: int, hot_split: str | None = None) -> list[str]:
    """SQL conditions, one per group, that every row meets exactly once; NULLs and values
    outside low to high (rows written since) are in the first. ``hot_split``: an integer column without NULLs."""
    out = []
    for group in groups:
        terms = []
        for p in group:
            term = f"{column} >= {p.first} AND {column} < {p.end}"
            terms.append(f"({term} AND MOD(ABS({hot_split}), {p.pieces}) = {p.piece})" if p.pieces > 1 else f"({term})")
        out.append(" OR ".join(terms))
    rest = f"{column} IS NULL OR {column} < {low} OR {column} > {high}"
    return [f"{rest} OR {out[0]}", *out[1:]] if out else ["1 = 1"]


def equi_depth_predicates(histogram: Histogram, column: str, low: int, high: int, parts: int,
                          hot_split: str | None = None) -> list[str]:
    """About ``parts`` conditions of about equal row counts, where an even stride
    over a skewed column would put most rows into one range."""
    return part_predicates(column, equi_depth_parts(histogram, low, high, parts, hot_split is not None), low, high, hot_split)


def jdbc_scan_equi_depth(spark: SparkSession, url: str, table: str, column: str, parts: int,
                         hot_split: str | None = None, **kwargs) -> DataFrame:
    """Table scan in parts of about equal size, one query each; ``column`` is an integer."""
    options = jdbc_options(url, table, **kwargs)
    bounds = spark.read.format("jdbc").options(**jdbc_options(url, f"({bounds_query(table, column)}) b", **kwargs)).load().first()
    if bounds is None or bounds[0] is None:
        return spark.read.format("jdbc").options(**options).load()
    ask = database_histogram(spark, url, table, column, **kwargs)
    predicates = equi_depth_predicates(ask, column, int(bounds[0]), int(bounds[1]), parts, hot_split)
    properties = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
