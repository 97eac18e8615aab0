"""Spark <-> DuckDB column type correspondence (used by the oracle checks)."""

from __future__ import annotations

from pyspark.sql import types as T


def spark_type_name(dt: T.DataType) -> str:
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    return {
        T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.ByteType: "TINYINT",
        T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN",
        T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP",
    }.get(type(dt), dt.simpleString().upper())


def duck_type_name(t) -> str:
    s = str(t).upper()
    return "TIMESTAMP" if s.startswith("TIMESTAMP") else s


def mismatched_types(spark_schema: T.StructType, duck_description) -> list[tuple[str, str, str]]:
    duck = {d[0]: duck_type_name(d[1]) for d in duck_description}
    out = []
    for f in spark_schema.fields:
        s = spark_type_name(f.dataType)
        if f.name in duck and duck[f.name] != s:
            out.append((f.name, s, duck[f.name]))
    return out
