"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class TableSet:
    """``<root>/<name>.parquet`` tables; columns are pruned by Catalyst.

    The schema of each table is inferred once per ``TableSet`` and then given
    to the reader, which saves the footer-reading job Spark runs for every
    schema-less Parquet read (catalog tables carry their schema already).
    Make a new ``TableSet`` after tables were rewritten with other columns.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._schemas: dict = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        path = self.path(name)
        schema = self._schemas.get(name)
        if schema is not None:
            return self.spark.read.schema(schema).parquet(path)
        df = self.spark.read.parquet(path)
        self._schemas[name] = df.schema
        return df


def rows_with_schema(df: DataFrame, schema) -> DataFrame:
    """Impose an explicit schema: field order, names and types; a NULL in a
    field declared non-nullable fails the job, as ``createDataFrame`` does for
    literal rows. (Spark keeps computed columns nullable in the plan.)"""
    from pyspark.sql import functions as F

    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"NULL in non-nullable field {f.name}"))).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)
