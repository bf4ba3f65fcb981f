"""Queries on what is easily got wrong: extreme numbers, NaN, keys of other types, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cleanframe.operators import coalesce_columns, fix_dtypes, fix_nulls, map_values
from cleanframe.plans import quality as Q
from cleanframe.sources import load_variant, overwrite, replace_table, snapshot_once, upsert_partitions, write_upsert
from cleanframe.sources.tables import shared_folder

from .dirt import for_duck
from .registry import query

EXTREME = {
    "nr": "o_orderkey",
    "n": (
        "CASE o_orderkey % 6 WHEN 0 THEN repeat('9', 400) WHEN 1 THEN '1e250' WHEN 2 THEN '-2.5E-250' "
        "WHEN 3 THEN '5d' WHEN 4 THEN '.5' ELSE CAST(o_orderkey AS STRING) || '.' END"
    ),
}


def _duck(columns):
    return for_duck(columns).replace("AS STRING", "AS VARCHAR")


@query(
    "dtypes_extreme",
    f"WITH x AS (SELECT {_duck(EXTREME)} FROM orders) SELECT nr, CASE WHEN nr % 6 = 0 THEN NULL ELSE TRY_CAST(rtrim(n, '.') AS DOUBLE) END AS n FROM x",
)
def _(t):
    return fix_dtypes(t.dirty(t.orders, EXTREME), {"n": "float"})


@query(
    "rule_ratios_two_keys",
    "WITH x AS (SELECT l_quantity, l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0) AS p, "
    "l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0) AS s FROM lineitem), "
    "r AS (SELECT count(*) AS row_count, avg(p::INT)::DOUBLE AS part, avg(s::INT)::DOUBLE AS supplier, avg((l_quantity > 10)::INT)::DOUBLE AS amount FROM x) "
    "SELECT row_count, round(part, 9) AS part, round(supplier, 9) AS supplier, round(amount, 9) AS amount, "
    "round(0.5 * part + 0.3 * supplier + 0.2 * amount, 6) AS score FROM r",
)
def _(t):
    rules = [
        Q.ForeignKey("part", "l_partkey", t.part.filter("p_partkey % 3 <> 0"), "p_partkey", 0.5),
        Q.ForeignKey("supplier", "l_suppkey", t.supplier.filter("s_suppkey % 5 <> 0"), "s_suppkey", 0.3),
        Q.Rule("amount", F.col("l_quantity") > 10, 0.2),
    ]
    out = Q.rule_ratios(t.lineitem, rules)
    return out.withColumns({c: F.round(c, 9) for c in ("part", "supplier", "amount")})


@query(
    "map_numeric_codes",
    "SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS size FROM orders",
)
def _(t):
    sizes = t.orders.selectExpr("o_orderkey", "CAST(o_custkey % 5 AS DOUBLE) AS size")
    return map_values(sizes, "size", {0: "none", 1: "?", "1.0": "text", 1.0: "one", "2.0": "two"}, default="many")


@query(
    "nan_is_missing",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice::DOUBLE END ELSE o_custkey::DOUBLE END AS value FROM orders",
)
def _(t):
    nan = "CAST('NaN' AS DOUBLE)"
    sides = t.orders.selectExpr(
        "o_orderkey",
        f"CASE WHEN o_orderkey % 3 = 0 THEN {nan} ELSE CAST(o_custkey AS DOUBLE) END AS a",
        f"CASE WHEN o_orderkey % 2 = 0 THEN {nan} ELSE CAST(o_totalprice AS DOUBLE) END AS b",
    )
    return coalesce_columns(sides, "value", ["a", "b"]).select("o_orderkey", "value")


@query(
    "nulls_median_many",
    "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey::DOUBLE END AS a, "
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice::DOUBLE END AS b, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 11)::DOUBLE END AS c FROM orders) "
    "SELECT o_orderkey, round(coalesce(a, (SELECT median(a) FROM x)), 4) AS a, round(coalesce(b, (SELECT median(b) FROM x)), 4) AS b, coalesce(c, (SELECT median(c) FROM x)) AS c FROM x",
)
def _(t):
    holes = t.orders.selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS a",
        "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS b",
        "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 11 AS DOUBLE) END AS c",
    )
    return fix_nulls(holes, "median", ["a", "b", "c"]).withColumns({c: F.round(c, 4) for c in "ab"})


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/probe-{uuid.uuid4().hex}"


@query("overwrite_roundtrip", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    at = _folder(t)
    kept = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    old = overwrite(kept, f"{at}/all", partition_by=["o_orderstatus"])
    overwrite(old.limit(5), f"{at}/part")
    return overwrite(old.filter("o_orderstatus <> 'P'"), f"{at}/part").select("o_orderkey", "o_orderstatus", "o_custkey")


@query("snapshot_once", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    at = _folder(t)
    names = t.nation.select("n_nationkey", "n_name")
    snapshot_once(names, at)
    return snapshot_once(names.limit(1), at)


@query("load_variant", "SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def _(t):
    at = _folder(t)
    for variant, name in (("messy", "c_name"), ("clean", "upper(c_name) AS c_name")):
        overwrite(t.customer.selectExpr("c_custkey", name), f"{at}/{variant}/customer")
    load_variant(t.spark, at, "customer", "messy", into=f"{at}/now")
    return load_variant(t.spark, at, "customer", "clean", into=f"{at}/now")


@query(
    "upsert_written",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'moved' ELSE s_name END AS s_name FROM supplier",
)
def _(t):
    at = _folder(t)
    names = t.supplier.select("s_suppkey", "s_name")
    overwrite(names, f"{at}/old")
    moved = names.filter("s_suppkey % 4 = 0").withColumn("s_name", F.lit("moved"))
    return write_upsert(f"{at}/old", moved, "s_suppkey", f"{at}/new")


@query("replaced_versions", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'P'")
def _(t):
    at = _folder(t)
    first = replace_table(t.orders.select("o_orderkey", "o_orderstatus"), at)
    second = replace_table(first.filter("o_orderkey % 3 = 0"), at)  # reads the table it replaces
    return replace_table(second.filter("o_orderstatus <> 'P'"), at, keep=2)


@query(
    "upsert_partitioned",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 50 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, "
    "CASE WHEN o_orderstatus = 'P' OR o_orderkey % 50 = 0 THEN -1 ELSE o_custkey END AS o_custkey FROM orders "
    "UNION ALL SELECT -n_nationkey - 1, 'new', n_nationkey FROM nation",
)
def _(t):
    at = _folder(t)
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    overwrite(orders, at, partition_by=["o_orderstatus"])
    moved = orders.filter("o_orderstatus = 'P' OR o_orderkey % 50 = 0").selectExpr("o_orderkey", "'F' AS o_orderstatus", "CAST(-1 AS BIGINT) AS o_custkey")
    added = t.nation.selectExpr("CAST(-n_nationkey - 1 AS BIGINT)", "'new'", "CAST(n_nationkey AS BIGINT)")
    done = upsert_partitions(at, moved.union(added), "o_orderkey", "o_orderstatus")
    return done.select("o_orderkey", "o_orderstatus", "o_custkey")
