"""Access audit: principal x principal role x catalog role with privileges.

The original audit walks the catalog's REST listings in driver loops; here
the listings are tables and the walk is a chain of joins (principal -> role
as inner + anti join, then left lookups of catalog roles and privilege
lists), so the matrix is built by executors however many principals there are.

Inputs
  principals          principal_name
  principal_roles     principal_name, principal_role
  role_catalog_roles  principal_role, catalog_role
  grants              catalog_role, grant_type, privilege, grant_order
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ledgerline.functions.text import concat_colon
from ledgerline.operators.aggregates import ordered_string_agg
from ledgerline.sources.tables import rows_with_schema

# Fixed values of the audit output.
NO_ROLE = "NONE"          # principal without role / role without catalog role
NO_PRIVILEGES = "NULL"    # the text NULL, written when no catalog role applies
NO_GRANTS = "NO_GRANTS"   # catalog role that holds no grant
MATRIX_ORDER = ["principal_name", "principal_role", "catalog_role"]
# Output schema: every field but the privilege list is required.
MATRIX_SCHEMA = T.StructType([
    T.StructField("principal_name", T.StringType(), False),
    T.StructField("principal_role", T.StringType(), False),
    T.StructField("catalog_name", T.StringType(), False),
    T.StructField("catalog_role", T.StringType(), False),
    T.StructField("privileges", T.StringType(), True),
])


def privilege_lists(grants: DataFrame) -> DataFrame:
    """``type:privilege`` entries joined by ", " per catalog role, in grant order."""
    entries = grants.withColumn("entry", concat_colon("grant_type", "privilege"))
    return ordered_string_agg(entries, ["catalog_role"], "grant_order", "entry", "privileges")


def _with_role(principals: DataFrame, principal_roles: DataFrame, role_catalog_roles: DataFrame) -> DataFrame:
    """principal x role x catalog role (NULL if the role has none) of principals with a role."""
    # principals LEFT JOIN roles, written as inner join + anti join: in the
    # left-join form a principal holding a huge share of all role rows sits
    # on the unsplittable side; here both sides of the inner join can be split
    # by AQE and the anti join only sees distinct names.
    held = principals.select("principal_name").join(
        principal_roles.select("principal_name", "principal_role"), "principal_name", "inner")
    return (held.join(role_catalog_roles.select("principal_role", "catalog_role"), "principal_role", "left")
            .select("principal_name", "principal_role", "catalog_role"))


def _without_role(principals: DataFrame, principal_roles: DataFrame) -> DataFrame:
    """Principals without a role. They never travel through the role joins,
    where their NULL keys would meet in one partition."""
    missing = F.lit(None).cast("string")
    return (principals.select("principal_name")
            .join(principal_roles.select("principal_name").distinct(), "principal_name", "left_anti")
            .select("principal_name", missing.alias("principal_role"), missing.alias("catalog_role")))


def role_lookup(principals: DataFrame, principal_roles: DataFrame,
                role_catalog_roles: DataFrame) -> DataFrame:
    """principal -> principal role -> catalog role, NULL where a level is missing."""
    return _with_role(principals, principal_roles, role_catalog_roles).unionByName(
        _without_role(principals, principal_roles))


def lookup_with_defaults(lookup: DataFrame) -> DataFrame:
    """Missing role levels replaced by the ``NONE`` sentinel."""
    return lookup.select("principal_name",
                         F.coalesce("principal_role", F.lit(NO_ROLE)).alias("principal_role"),
                         F.coalesce("catalog_role", F.lit(NO_ROLE)).alias("catalog_role"))


def access_matrix(principals: DataFrame, principal_roles: DataFrame,
                  role_catalog_roles: DataFrame, grants: DataFrame,
                  catalog_name: str, ordered: bool = True) -> DataFrame:
    """One row per principal x role x catalog role with the privilege list.
    ``ordered`` sorts by principal, role, catalog role (the report's order; a
    range shuffle) - leave it off when the matrix is only stored."""
    lookup = _with_role(principals, principal_roles, role_catalog_roles)
    privs = privilege_lists(grants).withColumnRenamed("catalog_role", "granted_role")
    # null-safe keys: the join then shuffles both sides itself instead of reusing
    # the lists' grouping, so AQE can split a catalog role held by very many
    joined = lookup.join(privs, lookup["catalog_role"].eqNullSafe(privs["granted_role"]), "left").drop("granted_role")
    joined = joined.unionByName(_without_role(principals, principal_roles)
                                .withColumn("privileges", F.lit(None).cast("string")))
    privileges = (F.when(F.col("principal_role").isNull() | F.col("catalog_role").isNull(),
                         F.lit(NO_PRIVILEGES))
                  .otherwise(F.coalesce("privileges", F.lit(NO_GRANTS))))
    matrix = rows_with_schema(joined.select(
        "principal_name",
        F.coalesce("principal_role", F.lit(NO_ROLE)).alias("principal_role"),
        F.lit(catalog_name).alias("catalog_name"),
        F.coalesce("catalog_role", F.lit(NO_ROLE)).alias("catalog_role"),
        privileges.alias("privileges")), MATRIX_SCHEMA)      # a NULL principal name fails the job
    return matrix.orderBy(*MATRIX_ORDER) if ordered else matrix


# List keys of the catalog's REST listings, in lookup order.
PRINCIPAL_ROLE_KEYS = ("principalRoles", "roles", "entities")
CATALOG_ROLE_KEYS = ("catalogRoles", "roles", "entities")

_GRANTS = "struct<grants:array<struct<type:string,privilege:string>>>"


def listings_from_payloads(principal_docs: DataFrame, role_docs: DataFrame,
                           grant_docs: DataFrame):
    """Listing tables from captured listing responses (one JSON document per row).

    principal_docs  principal_name, payload  (roles of one principal)
    role_docs       principal_role, payload  (catalog roles of one principal role)
    grant_docs      catalog_role, payload    (``{"grants": [{type, privilege}]}``)

    Returns (principals, principal_roles, role_catalog_roles, grants) for
    ``access_matrix``. A NULL payload and an empty or missing list yield no
    rows, so the matrix falls back to its sentinels; a payload that does not
    parse fails the job. Grant order is the order in the document.
    """
    from ledgerline.functions.text import first_present_names

    principals = principal_docs.select("principal_name")
    principal_roles = (principal_docs
                       .select("principal_name",
                               F.explode(first_present_names("payload", PRINCIPAL_ROLE_KEYS))
                               .alias("principal_role")))
    role_catalog_roles = (role_docs
                          .select("principal_role",
                                  F.explode(first_present_names("payload", CATALOG_ROLE_KEYS))
                                  .alias("catalog_role")))
    grants = (grant_docs
              .select("catalog_role",
                      F.posexplode(F.from_json("payload", _GRANTS, {"mode": "FAILFAST"})["grants"]).alias("grant_order", "g"))
              .select("catalog_role", F.col("g.type").alias("grant_type"),
                      F.col("g.privilege").alias("privilege"), "grant_order"))
    return principals, principal_roles, role_catalog_roles, grants


def main(argv=None) -> DataFrame:
    """``python -m ledgerline.plans.access --principals P --roles R --grants G
    [--catalog NAME] [--out PATH]``: JSON-lines files of captured listing
    responses (fields principal_name|principal_role|catalog_role and payload)
    -> access matrix, printed like the original (first 20 rows, untruncated)
    and optionally written as Parquet."""
    import argparse

    from ledgerline.session import build_session, input_bytes, size_session

    ap = argparse.ArgumentParser(description="Principal / role / privilege matrix.")
    ap.add_argument("--principals", required=True)
    ap.add_argument("--roles", required=True)
    ap.add_argument("--grants", required=True)
    ap.add_argument("--catalog", default="main")
    ap.add_argument("--out")
    args = ap.parse_args(argv)
    spark = build_session()
    size_session(spark, input_bytes(spark, args.principals, args.roles, args.grants))
    docs = [spark.read.schema(f"{key} string, payload string").json(path)
            for key, path in (("principal_name", args.principals), ("principal_role", args.roles),
                              ("catalog_role", args.grants))]
    listings = listings_from_payloads(*docs)
    matrix = access_matrix(*listings, args.catalog)
    matrix.show(20, truncate=False)
    if args.out:       # stored unsorted: no range shuffle just for file order
        access_matrix(*listings, args.catalog, ordered=False).write.mode("overwrite").parquet(args.out)
    return matrix


if __name__ == "__main__":
    main()
