"""Queries for the cleaning operations."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from cleanframe.functions import values as V
from cleanframe.operators import (
    clean,
    coalesce_columns,
    copy_column,
    derive_column,
    fix_dtypes,
    fix_nulls,
    fix_unix_ms,
    map_values,
    normalize_strings,
    remove_duplicates,
    remove_outliers,
    rename_columns,
)
from cleanframe.functions.values import try_num
from cleanframe.operators.nulls import median_sketches, merged_medians
from cleanframe.plans.conform import WARD_CODE_UNITS

from .dirt import BEDS, FEED_A, FEED_B, IN_FEED_A, MEDICATIONS, ORDERS, REFERENCE_DAY, cased, for_duck
from .registry import query

NULL_LIKE = ["", "N/A", "n/a"]
ORDERS_SQL = f"WITH o AS (SELECT {for_duck(ORDERS)} FROM orders)"
# What Python's strip removes, as far as the dirty texts contain it.
BLANK = "chr(9) || ' '"
NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def _num(c):
    return f"CASE WHEN regexp_matches(trim({c}, {BLANK}), {NUMBER}) THEN CAST(trim({c}, {BLANK}) AS DOUBLE) END"


def _orders(t, *columns):
    picked = {c: ORDERS[c] for c in ("order_id", *columns)}
    return t.dirty(t.orders, picked)


@query(
    "dedupe_keep_first",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER "
    "(PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
)
def _(t):
    events = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return remove_duplicates(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "nulls_drop",
    f"{ORDERS_SQL} SELECT order_id, status, price FROM o WHERE status IS NOT NULL AND price IS NOT NULL "
    "AND status NOT IN ('', 'N/A') AND price NOT IN ('', 'N/A')",
)
def _(t):
    return fix_nulls(_orders(t, "status", "price"), "drop", ["status", "price"], NULL_LIKE)


@query(
    "nulls_mean",
    f"{ORDERS_SQL}, n AS (SELECT order_id, {_num('price')} AS x, {_num('halves')} AS h FROM o) "
    "SELECT order_id, round(coalesce(x, avg(x) OVER ()), 3) AS price, round(coalesce(h, avg(h) OVER ()), 3) AS halves FROM n",
)
def _(t):
    filled = fix_nulls(_orders(t, "price", "halves"), "mean", ["price", "halves"], NULL_LIKE)
    return filled.withColumns({c: F.round(c, 3) for c in ("price", "halves")})


@query(
    "nulls_median",
    f"{ORDERS_SQL}, n AS (SELECT order_id, {_num('price')} AS x FROM o) "
    "SELECT order_id, round(coalesce(x, (SELECT median(x) FROM n)), 3) AS price FROM n",
)
def _(t):
    filled = fix_nulls(_orders(t, "price"), "median", ["price"], NULL_LIKE)
    return filled.withColumn("price", F.round("price", 3))


@query(
    "nulls_median_sketch",
    f"{ORDERS_SQL}, n AS (SELECT order_id, {_num('price')} AS x FROM o) "
    "SELECT count(*) AS filled, count(x) AS given, true AS near_the_median FROM n",
)
def _(t):
    holes = _orders(t, "price")
    filled = fix_nulls(holes, "approximate_median", ["price"], NULL_LIKE)
    # the rank of the value filled in, among the cells that were given
    given = fix_nulls(holes, "drop", ["price"], NULL_LIKE).select(try_num(F.col("price"), T.StringType()).alias("x")).filter("x is not null")
    middle = merged_medians(median_sketches(given, ["x"]), ["x"])["x"]
    rank = given.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") < middle).alias("below"), F.count_if(F.col("x") <= middle).alias("upto"))
    told = rank.select(F.struct("n", ((F.col("below") <= F.col("n") * 0.51) & (F.col("upto") >= F.col("n") * 0.49)).alias("near")).alias("t")).scalar()
    return filled.agg(F.count("price").alias("filled")).select("filled", told["n"].alias("given"), told["near"].alias("near_the_median"))


@query(
    "nulls_mode",
    f"{ORDERS_SQL}, n AS (SELECT order_id, priority, CASE WHEN status IN ('', 'N/A') THEN NULL ELSE status END AS status FROM o), "
    "p AS (SELECT priority FROM n WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
    "s AS (SELECT status FROM n WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    "SELECT order_id, coalesce(priority, (FROM p)) AS priority, coalesce(status, (FROM s)) AS status FROM n",
)
def _(t):
    return fix_nulls(_orders(t, "priority", "status"), "mode", ["priority", "status"], NULL_LIKE)


HOLED = "CASE WHEN event_id % 3 = 0 THEN value END"


@query(
    "nulls_ffill_partitioned",
    f"SELECT event_id, user_id, last_value({HOLED} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events",
)
def _(t):
    events = t.events.selectExpr("event_id", "user_id", "ts", f"{HOLED} AS value")
    return fix_nulls(
        events, "forward_fill", ["value"], order_by=["ts", "event_id"], partition_by=["user_id"]
    ).drop("ts")


@query(
    "nulls_ffill_global",
    f"SELECT event_id, last_value({HOLED} IGNORE NULLS) OVER (ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events",
)
def _(t):
    events = t.events.selectExpr("event_id", "ts", f"{HOLED} AS value")
    return fix_nulls(events, "forward_fill", ["value"], order_by=["ts", "event_id"]).drop("ts")


@query("dtypes_float", f"{ORDERS_SQL} SELECT order_id, {_num('price')} AS price FROM o")
def _(t):
    return fix_dtypes(_orders(t, "price"), {"price": "float"})


@query(
    "dtypes_int",
    f"{ORDERS_SQL} SELECT order_id, CAST(round_even({_num('halves')}, 0) AS BIGINT) AS halves, "
    f"CAST(round_even({_num('price')}, 0) AS BIGINT) AS price FROM o",
)
def _(t):
    return fix_dtypes(_orders(t, "halves", "price"), {"halves": "int", "price": "int"})


@query(
    "dtypes_int_keep",
    f"{ORDERS_SQL} SELECT order_id, coalesce(CAST(CAST(trunc({_num('halves')}) AS BIGINT) AS VARCHAR), halves) AS halves FROM o",
)
def _(t):
    return fix_dtypes(_orders(t, "halves"), {"halves": "int"}, on_error="keep", int_mode="trunc")


@query(
    "dtypes_date",
    f"{ORDERS_SQL} SELECT order_id, strftime(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%Y/%m/%d'), "
    "try_strptime(day, '%d/%m/%Y')), '%Y-%m-%d') AS day FROM o",
)
def _(t):
    return fix_dtypes(_orders(t, "day"), {"day": "date"}, formats=["yyyy-MM-dd", "yyyy/MM/dd", "d/M/yyyy"], as_string=True)


@query("dtypes_string", f"{ORDERS_SQL} SELECT CAST(order_id AS VARCHAR) AS order_id, trim(status, {BLANK}) AS status FROM o")
def _(t):
    return fix_dtypes(_orders(t, "status"), {"order_id": "string", "status": "string"})


CUSTOMERS = {"id": "c_custkey", "segment": cased("c_mktsegment", "c_custkey")}
PARTS = {"id": "p_partkey", "name": cased("p_name || '''s ' || p_brand || '-x'", "p_partkey")}
for case in ("lower", "upper"):

    @query(
        f"strings_{case}",
        f"WITH c AS (SELECT {for_duck(CUSTOMERS)} FROM customer) SELECT id, {case}(trim(segment, {BLANK})) AS segment FROM c",
    )
    def _(t, case=case):
        return normalize_strings(t.dirty(t.customer, CUSTOMERS), ["segment"], case)


@query(
    "strings_title",
    f"WITH p AS (SELECT {for_duck(PARTS)} FROM part) SELECT id, array_to_string(list_transform(regexp_extract_all("
    f"lower(trim(name, {BLANK})), '(\\p{{L}}+|\\P{{L}}+)'), lambda r: upper(r[1]) || r[2:]), '') AS name FROM p",
)
def _(t):
    return normalize_strings(t.dirty(t.part, PARTS), ["name"], "title")


@query(
    "outliers_global",
    "WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS d FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem, s "
    "WHERE l_extendedprice BETWEEN m - 1.5 * d AND m + 1.5 * d",
)
def _(t):
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return remove_outliers(items, "l_extendedprice", 1.5)


@query(
    "outliers_grouped",
    "WITH s AS (SELECT event_type AS k, avg(value) AS m, stddev_pop(value) AS d FROM events GROUP BY 1) "
    "SELECT event_id, event_type, value FROM events JOIN s ON event_type = k WHERE value BETWEEN m - 2 * d AND m + 2 * d",
)
def _(t):
    events = t.events.select("event_id", "event_type", "value")
    return remove_outliers(events, "value", 2, partition_by=["event_type"])


MERGED = {
    "id": "o_orderkey",
    "code": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END",
    "old_code": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'old ' || o_orderstatus END",
    "amount": "o_totalprice",
}
MERGED_SQL = f"WITH m AS (SELECT {for_duck(MERGED)} FROM orders)"


@query("rename_merge", f"{MERGED_SQL} SELECT id, coalesce(code, old_code) AS code, amount AS price FROM m")
def _(t):
    merged = t.dirty(t.orders, MERGED)
    return rename_columns(merged, {"old_code": "code", "amount": "price", "absent": "x"})


@query(
    "coalesce_cols",
    f"{MERGED_SQL} SELECT id, coalesce(code, old_code, 'none') AS any_code, amount FROM m",
)
def _(t):
    merged = t.dirty(t.orders, MERGED)
    return coalesce_columns(merged, "any_code", ["code", "old_code"], fill_value="none", drop_sources=True)


@query("copy_fill", f"{MERGED_SQL} SELECT id, coalesce(code, old_code) AS code, old_code, amount FROM m")
def _(t):
    return copy_column(t.dirty(t.orders, MERGED), "old_code", "code", overwrite=False)


@query(
    "map_codes",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN NULL ELSE o_orderstatus END AS o_orderstatus, "
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' ELSE 'other' END AS level FROM orders",
)
def _(t):
    orders = t.orders.selectExpr("o_orderkey", "o_orderstatus", "CAST(substr(o_orderpriority, 1, 1) AS INT) AS level")
    mapped = map_values(orders, "o_orderstatus", {"F": "filled", "O": None})
    return map_values(mapped, "level", {1: "high", "2": "high"}, default="other")


@query(
    "map_many_codes",
    "SELECT event_id, CASE WHEN user_id % 2 = 0 AND user_id < 400 THEN 'U' || user_id ELSE CAST(user_id AS VARCHAR) END AS user_id FROM events",
)
def _(t):
    mapping = {u: f"U{u}" for u in range(0, 400, 2)}
    return map_values(t.events.select("event_id", "user_id"), "user_id", mapping)


@query("derive_constant", "SELECT o_orderkey, 'batch-1' AS batch FROM orders")
def _(t):
    return derive_column(t.orders.select("o_orderkey"), "batch", value="batch-1")


@query("derive_from_column", "SELECT o_orderkey, o_orderstatus, o_orderstatus AS state FROM orders")
def _(t):
    return derive_column(t.orders.select("o_orderkey", "o_orderstatus"), "state", "from_column", source_column="o_orderstatus")


@query(
    "derive_if_equals",
    f"{MERGED_SQL} SELECT id, code, CASE WHEN code = 'F' THEN 'done' ELSE 'open' END AS state FROM m",
)
def _(t):
    merged = t.dirty(t.orders, MERGED).select("id", "code")
    return derive_column(merged, "state", "if_equals", column="code", equals="F", then="done", **{"else": "open"})


@query(
    "derive_template",
    f"{MERGED_SQL} SELECT id, '[' || coalesce(code, '') || '] ' || CAST(id AS VARCHAR) || ': ' || "
    "CAST(amount AS VARCHAR) || ' {x}' || '' AS label FROM m",
)
def _(t):
    merged = t.dirty(t.orders, MERGED)
    template = "[{code}] {id}: {amount} {{x}}{unknown}"
    return derive_column(merged, "label", "template", template=template).select("id", "label")


LABELS = {"id": "s_suppkey", "label": "CASE WHEN s_suppkey % 9 = 0 THEN 'none' ELSE s_name || '/' || CAST(s_nationkey AS STRING) END"}
LABELS_SQL = f"WITH s AS (SELECT {for_duck(LABELS)} FROM supplier)"


@query(
    "derive_digits_first",
    f"{LABELS_SQL} SELECT id, label, coalesce(nullif(regexp_extract(label, '(\\d+)', 1), ''), 'UNKNOWN') AS digits FROM s",
)
def _(t):
    return derive_column(t.dirty(t.supplier, LABELS), "digits", "extract_digits", column="label")


@query(
    "derive_digits_all",
    f"{LABELS_SQL} SELECT id, label, coalesce(nullif(regexp_replace(label, '\\D', '', 'g'), ''), '-') AS digits FROM s",
)
def _(t):
    labels = t.dirty(t.supplier, LABELS)
    return derive_column(labels, "digits", "extract_digits", column="label", digits="all", fallback="-")


@query(
    "derive_within_days",
    f"{ORDERS_SQL} SELECT order_id, CASE WHEN try_strptime(day, '%Y-%m-%d') >= TIMESTAMP '1998-01-01' - INTERVAL 400 DAYS "
    "OR try_strptime(day, '%Y/%m/%d') >= TIMESTAMP '1998-01-01' - INTERVAL 400 DAYS THEN 'recent' ELSE 'old' END AS age FROM o",
)
def _(t):
    return derive_column(
        _orders(t, "day"),
        "age",
        "date_within_days",
        column="day",
        reference_date="1998-01-01",
        days=400,
        then="recent",
        **{"else": "old"},
    ).drop("day")


EPOCHS = {
    "event_id": "event_id",
    "at": "CASE event_id % 4 WHEN 0 THEN SECONDS(ts) WHEN 1 THEN ' ' || MILLIS(ts) WHEN 2 THEN STAMP(ts) ELSE 'at ' || ISO(ts) END",
}
EPOCHS["on_day"] = EPOCHS["at"]
_AT = (
    "CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) "
    "WHEN 2 THEN date_trunc('second', ts) END"
)


@query(
    "epoch_to_datetime",
    f"SELECT event_id, strftime({_AT}, '%Y-%m-%d %H:%M:%S') AS at, strftime({_AT}, '%Y-%m-%d') AS on_day FROM events",
)
def _(t):
    events = t.dirty(t.events, EPOCHS)
    return fix_unix_ms(fix_unix_ms(events, "at", "datetime"), ["on_day"], "date")


MEDICATIONS_SQL = f"WITH m AS (SELECT {for_duck(MEDICATIONS)} FROM lineitem)"
_DOSE = "CAST(nullif(regexp_extract(dosage_mg, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)"
_DAY = (
    "CAST(CASE WHEN regexp_matches(prescribed_date, '^\\d{10,13}$') THEN "
    "to_timestamp(CAST(prescribed_date AS DOUBLE) / CASE WHEN CAST(prescribed_date AS DOUBLE) > 1e10 THEN 1000 ELSE 1 END) "
    "AT TIME ZONE 'UTC' ELSE try_strptime(prescribed_date, '%Y-%m-%d') END AS DATE)"
)


@query(
    "scalar_values",
    f"{MEDICATIONS_SQL} SELECT medication_id, lower(trim(coalesce(drug_name, ''), {BLANK})) AS drug, {_DOSE} AS dose, "
    f"strftime({_DAY}, '%Y-%m-%d') AS day FROM m",
)
def _(t):
    medications = t.dirty(t.lineitem, MEDICATIONS)
    return medications.select(
        "medication_id",
        V.drug_name(F.col("drug_name")).alias("drug"),
        V.dosage(F.col("dosage_mg")).alias("dose"),
        F.date_format(V.mixed_timestamp(F.col("prescribed_date"), digits=r"^\d{10,13}$"), "yyyy-MM-dd").alias("day"),
    )


@query(
    "time_values",
    "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, "
    "strftime(time_bucket(INTERVAL 10 MINUTES, ts), '%Y-%m-%d %H:%M') AS bucket, "
    "CASE WHEN ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS THEN 'active' ELSE 'inactive' END AS status, "
    "'BED-' || CAST(user_id % 60 AS VARCHAR) AS bed FROM events",
)
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select(
        "event_id",
        F.date_format(F.date_trunc("minute", ts), "yyyy-MM-dd HH:mm").alias("minute"),
        F.date_format(V.time_bucket(ts, 10), "yyyy-MM-dd HH:mm").alias("bucket"),
        F.when(V.recent(ts, REFERENCE_DAY, 7), "active").otherwise("inactive").alias("status"),
        V.bed_label(F.concat(F.lit("Room 00"), (F.col("user_id") % 60).cast("string"))).alias("bed"),
    )


@query(
    "canonical_values",
    f"{ORDERS_SQL} SELECT order_id, CASE WHEN regexp_matches(trim(price, {BLANK}), {NUMBER}) THEN "
    f"regexp_replace(CAST(CAST(trim(price, {BLANK}) AS DECIMAL(38,18)) AS VARCHAR), '\\.?0+$', '') "
    f"ELSE lower(trim(price, {BLANK})) END AS price, lower(trim(status, {BLANK})) AS status FROM o",
)
def _(t):
    orders = _orders(t, "price", "status")
    return orders.select("order_id", *[V.canonical(F.col(c), orders.schema[c].dataType).alias(c) for c in ("price", "status")])


def feeds(t):
    a = t.dirty(t.events.filter(IN_FEED_A), FEED_A)
    b = t.dirty(t.events.filter(f"NOT {IN_FEED_A}"), FEED_B)
    return a, b


FEEDS_SQL = (
    f"WITH a AS (SELECT {for_duck(FEED_A)} FROM events WHERE {IN_FEED_A}), "
    f"b AS (SELECT {for_duck(FEED_B)} FROM events WHERE NOT {IN_FEED_A}), "
    f"beds AS (SELECT {for_duck(BEDS)} FROM supplier), "
    "codes(ward_code, icu_unit) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in WARD_CODE_UNITS.items()) + ")"
)


# One order book as it comes from two shops: the second writes its prices as text with a unit, and
# leaves out states that stay as they were.
BOOK = {
    "nr": "o_orderkey",
    "buyer": "o_custkey",
    "state": "CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 10 = 0 THEN NULL ELSE ' ' || lower(o_orderstatus) || ' ' END",
    "web_price": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS STRING) END",
    "shop_price": "CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_totalprice AS STRING) || ' EUR' ELSE CAST(o_totalprice AS STRING) END",
    "sent": "MILLIS(o_orderdate)",
    "rush": "o_orderpriority",
}

BOOK_STEPS = [
    {"operation": "fix_nulls", "strategy": "forward_fill", "columns": ["state"], "order_by": ["nr"], "null_like": [""]},
    {"operation": "coalesce_columns", "target_column": "price", "source_columns": ["web_price", "shop_price"], "drop_sources": True},
    {"operation": "fix_dtypes", "columns": {"price": "float"}},
    {"operation": "remove_outliers", "column": "price", "n_std": 1.5},
    {"operation": "fix_nulls", "strategy": "mean", "columns": ["price"]},
    {"operation": "map_values", "column": "state", "mapping": {" o ": "open", " f ": "filled"}, "default": "split"},
    {"operation": "normalize_strings", "columns": ["state"], "case": "title"},
    {"operation": "fix_unix_ms", "columns": ["sent"], "output": "date"},
    {"operation": "derive_column", "target_column": "level", "rule": "extract_digits", "column": "rush"},
    {"operation": "rename_columns", "mapping": {"rush": "level"}},
    {"operation": "derive_column", "target_column": "late", "rule": "date_within_days", "column": "sent", "reference_date": "1998-08-02", "days": 365, "then": "yes", "else": "no"},
    {"operation": "copy_column", "from_column": "sent", "to_column": "month"},
    {"operation": "derive_column", "target_column": "label", "rule": "template", "template": "{buyer} {level} {state}"},
    {"operation": "remove_duplicates", "columns": ["buyer", "state"], "order_by": ["sent", "nr"]},
]


@query(
    "clean_spec_feeds",
    f"WITH raw AS (SELECT {for_duck(BOOK)}, o_orderdate FROM orders), "
    "filled AS (SELECT *, last_value(nullif(state, '') IGNORE NULLS) OVER (ORDER BY nr ROWS UNBOUNDED PRECEDING) AS was, "
    "TRY_CAST(coalesce(web_price, shop_price) AS DOUBLE) AS p FROM raw), "
    "b AS (SELECT avg(p) - 1.5 * stddev_pop(p) AS low, avg(p) + 1.5 * stddev_pop(p) AS high FROM filled), "
    "near AS (SELECT filled.* FROM filled, b WHERE p IS NULL OR p BETWEEN low AND high), "
    "named AS (SELECT nr, buyer, CASE was WHEN ' o ' THEN 'Open' WHEN ' f ' THEN 'Filled' ELSE 'Split' END AS state, "
    "coalesce(p, (SELECT avg(p) FROM near)) AS p, strftime(o_orderdate, '%Y-%m-%d') AS sent, regexp_extract(rush, '[0-9]+') AS level, "
    "CASE WHEN o_orderdate >= DATE '1998-08-02' - 365 THEN 'yes' ELSE 'no' END AS late FROM near) "
    "SELECT nr, buyer, state, round(p, 2) AS price, sent, level, late, sent AS month, concat_ws(' ', buyer, level, state) AS label "
    "FROM named QUALIFY row_number() OVER (PARTITION BY buyer, state ORDER BY sent, nr) = 1",
)
def _(t):
    return clean(t.dirty(t.orders, BOOK), BOOK_STEPS, staged=True).withColumn("price", F.round("price", 2))
