"""Access-audit listings as tables, mapped from the supplied tables (test-data adapter).

principals          customers and suppliers (name); suppliers have no order, so no role
principal_roles     distinct (customer, order priority) of all orders
role_catalog_roles  the fixed mapping below
grants              one grant per nation, held by the catalog role named after its region
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.tables import TableSet

CATALOG_NAME = "main"

# Principal role -> catalog role (GHOST is a catalog role without grants).
ROLE_TO_CATALOG_ROLE = [
    ("1-URGENT", "AFRICA"),
    ("1-URGENT", "ASIA"),
    ("2-HIGH", "EUROPE"),
    ("3-MEDIUM", "GHOST"),
]
GRANT_TYPE = "namespace"


def principals(t: TableSet) -> DataFrame:
    return (t("customer").select(F.col("c_name").alias("principal_name"))
            .unionAll(t("supplier").select(F.col("s_name").alias("principal_name"))))


def principal_roles(t: TableSet) -> DataFrame:
    o = t("orders").select("o_custkey", "o_orderpriority").distinct()
    c = t("customer").select("c_custkey", "c_name")
    return (o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
            .select(F.col("c_name").alias("principal_name"),
                    F.col("o_orderpriority").alias("principal_role")))


def role_catalog_roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROLE_TO_CATALOG_ROLE, "principal_role string, catalog_role string")


def grants(t: TableSet) -> DataFrame:
    n = t("nation")
    r = t("region")
    return (n.join(r, n["n_regionkey"] == r["r_regionkey"], "inner")
            .select(F.col("r_name").alias("catalog_role"),
                    F.lit(GRANT_TYPE).alias("grant_type"),
                    F.col("n_name").alias("privilege"),
                    F.col("n_nationkey").alias("grant_order")))
