"""Equi-depth splits of skewed columns and bucketed tables."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline import registry
from ledgerline.session import fresh_path
from ledgerline.sources import catalog, jdbc


def counting(values):
    def ask(low, high, width, heavy):
        cells = {}
        for v in values:
            if low <= v <= high and (heavy is None or (v - low) // (width * jdbc.STEP) in heavy):
                cells[(v - low) // width] = cells.get((v - low) // width, 0) + 1
        return cells
    return ask


SHAPES = {
    "even": lambda r: r.randrange(-5000, 5000),
    "powers": lambda r: int(10 ** (r.random() * 12)),
    "one hot": lambda r: 77 if r.random() < 0.4 else r.randrange(1000),
    "two hot": lambda r: r.choice([5, 6, 6, 6, r.randrange(10**9)]),
    "few values": lambda r: r.randrange(3),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_parts_are_even_and_cover_every_row_once(spark, shape):
    rng = random.Random(shape)
    values = [SHAPES[shape](rng) for _ in range(20_000)]
    low, high, parts = min(values), max(values), 12
    groups = jdbc.equi_depth_parts(counting(values), low, high, parts, split_hot=True)
    rows = [sum(p.rows for p in g) for g in groups]
    assert abs(sum(rows) - len(values)) < 1e-6 and max(rows) <= 2.15 * min(rows)
    assert parts / 2 <= len(groups) <= 2 * parts
    predicates = jdbc.part_predicates("v", groups, low, high, "pk")
    df = spark.createDataFrame([(v, i) for i, v in enumerate([*values, None, low - 5, high + 5])], "v long, pk int")
    hits = df.select(sum(F.when(F.coalesce(F.expr(p), F.lit(False)), 1).otherwise(0) for p in predicates).alias("n"))
    assert [tuple(r) for r in hits.groupBy("n").count().collect()] == [(1, len(values) + 3)]
    sizes = df.agg(*[F.count_if(F.expr(p)).alias(f"c{k}") for k, p in enumerate(predicates)]).first()
    assert max(sizes) <= 2.3 * min(sizes)                  # hot values are divided by the key, about evenly


def test_hot_values_stay_whole_without_a_key():
    groups = jdbc.equi_depth_parts(counting([7] * 900 + list(range(100))), 0, 99, 10)
    assert [[(p.first, p.end) for p in g] for g in groups if any(p.rows > 500 for p in g)] == [[(7, 8)]]
    assert jdbc.part_predicates("k", [], 0, 0) == ["1 = 1"]
    assert jdbc.equi_depth_predicates(counting([3]), "k", 3, 3, 4) == ["k IS NULL OR k < 3 OR k > 3 OR (k >= 3 AND k < 4)"]


def test_frame_histogram_counts_cells(spark):
    df = spark.createDataFrame([(v,) for v in (-7, -1, 0, 4, 5, 9, 100, None)], "v long")
    assert jdbc.frame_histogram(df, "v")(-10, 9, 5, None) == {0: 1, 1: 1, 2: 2, 3: 2}
    assert jdbc.frame_histogram(df, "v")(-10, 200, 1, [1]) == {110: 1}
    query = jdbc.histogram_query("t", "v", -10, 9, 5, [0, 3])
    assert query.endswith("IN (0, 3) GROUP BY FLOOR((v - (-10)) / 5.0)") and "v >= -10 AND v <= 9" in query


def test_bucketed_join_has_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.QUERIES["join_bucketed"](spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert df.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_bucketed_table_has_one_file_per_bucket(spark):
    path = fresh_path(spark, "bucketed")
    spark.sql("CREATE DATABASE IF NOT EXISTS splits")
    spark.sql("DROP TABLE IF EXISTS splits.b")
    for _ in range(2):
        catalog.create_bucketed_table(spark, "splits.b", "k BIGINT, v STRING", ["k"], 4, path)
    catalog.write_bucketed(spark.range(1000).selectExpr("'x' v", "id k").repartition(7), "splits.b")
    assert spark.table("splits.b").count() == 1000
    assert len(spark.table("splits.b").inputFiles()) == 4
    with pytest.raises(ValueError):
        catalog.create_bucketed_table(spark, "splits.c", "k BIGINT", [], 4)
