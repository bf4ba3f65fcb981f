"""Dirty columns derived from keys, written once for Spark and for DuckDB.

The given tables are clean, so every query first makes a mess of them with
plain arithmetic on keys. The texts below are SQL both engines read; the few
functions they name differently are written as macros.
"""

from __future__ import annotations

import re

# macro: (Spark, DuckDB)
MACROS = {
    "ISO": ("date_format({0}, 'yyyy-MM-dd')", "strftime({0}, '%Y-%m-%d')"),
    "SLASHED": ("date_format({0}, 'yyyy/MM/dd')", "strftime({0}, '%Y/%m/%d')"),
    "DMY": ("date_format({0}, 'dd/MM/yyyy')", "strftime({0}, '%d/%m/%Y')"),
    "DMY1": ("date_format({0}, 'd/M/yyyy')", "strftime({0}, '%-d/%-m/%Y')"),
    "STAMP": ("date_format({0}, 'yyyy-MM-dd HH:mm:ss')", "strftime({0}, '%Y-%m-%d %H:%M:%S')"),
    "SECONDS": (
        "CAST(unix_seconds(CAST({0} AS TIMESTAMP)) AS STRING)",
        "CAST(CAST(floor(epoch({0})) AS BIGINT) AS STRING)",
    ),
    "MILLIS": ("CAST(unix_millis(CAST({0} AS TIMESTAMP)) AS STRING)", "CAST(epoch_us({0}) // 1000 AS STRING)"),
    "MILLIS_INT": ("unix_millis(CAST({0} AS TIMESTAMP))", "epoch_us({0}) // 1000"),
    "TAB": ("char(9)", "chr(9)"),
}


def _render(text: str, engine: int) -> str:
    def put(match):
        return MACROS[match.group(1)][engine].format(match.group(2))

    return re.sub(r"\b(%s)\(([^()]*)\)" % "|".join(sorted(MACROS, key=len, reverse=True)), put, text)


def for_spark(columns: dict[str, str]) -> list[str]:
    return [f"{_render(e, 0)} AS {n}" for n, e in columns.items()]


def for_duck(columns: dict[str, str]) -> str:
    return ", ".join(f"{_render(e, 1)} AS {n}" for n, e in columns.items())


def cased(column: str, key: str) -> str:
    """A text in one of three casings, and padded for every second key."""
    return (
        f"CASE WHEN {key} % 2 = 0 THEN ' ' ELSE '' END || "
        f"CASE {key} % 3 WHEN 0 THEN lower({column}) WHEN 1 THEN upper({column}) ELSE {column} END || "
        f"CASE WHEN {key} % 4 = 0 THEN TAB() || ' ' ELSE '' END"
    )


def holes(value: str, key: str) -> str:
    """The value as text, with null, 'N/A' and junk at some keys."""
    return (
        f"CASE WHEN {key} % 13 = 0 THEN NULL WHEN {key} % 17 = 0 THEN 'N/A' "
        f"WHEN {key} % 19 = 0 THEN '' ELSE {value} END"
    )


ORDERS = {
    "order_id": "o_orderkey",
    "status": holes(cased("o_orderstatus", "o_orderkey"), "o_orderkey"),
    "priority": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END",
    "price": holes(
        "CASE WHEN o_orderkey % 23 = 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || 'mg' "
        "WHEN o_orderkey % 29 = 0 THEN '5d' ELSE ' ' || CAST(o_totalprice AS STRING) END",
        "o_orderkey",
    ),
    "halves": "CASE WHEN o_orderkey % 31 = 0 THEN 'half' ELSE CAST(o_orderkey % 100 AS STRING) || '.5' END",
    "day": (
        "CASE o_orderkey % 4 WHEN 0 THEN ISO(o_orderdate) WHEN 1 THEN SLASHED(o_orderdate) "
        "WHEN 2 THEN DMY(o_orderdate) ELSE 'on ' || ISO(o_orderdate) END"
    ),
}

# One admission per order; the customer is the patient, the segment the ward.
ADMISSIONS = {
    "row_no": "o_orderkey",
    "patient_id": (
        "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE '' END || 'P' || "
        "CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 7 = 0 THEN TAB() ELSE '' END END"
    ),
    "admission_date": (
        "CASE WHEN o_orderkey % 101 = 0 THEN 'unknown' ELSE CASE o_orderkey % 3 WHEN 0 THEN ISO(o_orderdate) "
        "WHEN 1 THEN DMY(o_orderdate) ELSE DMY1(o_orderdate) END END"
    ),
    "ward": f"CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE {cased('c_mktsegment', 'o_orderkey')} END",
    "age": (
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'N/A' "
        "ELSE CAST(18 + o_orderkey % 78 AS STRING) END"
    ),
}

# One prescription per line item; every tenth order is unknown to the parents.
MEDICATIONS = {
    "medication_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)",
    "patient_id": (
        "CASE WHEN l_orderkey % 10 = 0 THEN 'X' ELSE 'P' END || CAST(l_orderkey AS STRING) || "
        "CASE WHEN l_linenumber = 2 THEN '  ' ELSE '' END"
    ),
    "drug_name": (
        "CASE WHEN l_partkey % 41 = 0 THEN '  ' WHEN l_partkey % 43 = 0 THEN NULL ELSE CASE l_linenumber % 4 "
        "WHEN 0 THEN 'Drug ' || l_returnflag WHEN 1 THEN lower('Drug ' || l_returnflag) "
        "WHEN 2 THEN upper('Drug ' || l_returnflag) || ' ' ELSE lower('Drug ' || l_returnflag) || '  ' END END"
    ),
    "dosage_mg": (
        "CASE WHEN l_partkey % 37 = 0 THEN 'none' ELSE CASE l_suppkey % 3 WHEN 0 THEN CAST(l_quantity AS STRING) "
        "WHEN 1 THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) || 'mg' "
        "ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) || ' mg' END END"
    ),
    "prescribed_date": (
        "CASE WHEN l_partkey % 53 = 0 THEN 'soon' ELSE CASE l_suppkey % 5 "
        "WHEN 0 THEN SECONDS(l_shipdate + INTERVAL 10000 DAYS) WHEN 1 THEN MILLIS(l_shipdate + INTERVAL 10000 DAYS) "
        "ELSE ISO(l_shipdate + INTERVAL 10000 DAYS) END END"
    ),
}
PATIENTS = {"patient_id": "'P' || CAST(o_orderkey AS STRING)", "ward": "substr(o_orderpriority, 3)"}

# Two feeds that together are the event table: one kind of events with written
# times, the other with epoch milliseconds and ward codes.
IN_FEED_A = "event_type IN ('click', 'view')"
FEED_A = {
    "patient_id": "event_id",
    "bed_number": "CASE WHEN event_id % 23 = 0 THEN 'Bed' ELSE 'Bed ' || CAST(user_id % 60 AS STRING) END",
    "icu_unit": "CASE user_id % 4 WHEN 0 THEN 'ICU_MEDICAL' WHEN 1 THEN 'ICU_SURGICAL' WHEN 2 THEN 'ICU_CARDIAC' ELSE 'ICU_NEURO' END",
    "admitted_at": "CASE WHEN event_id % 17 = 0 THEN 'later' ELSE STAMP(ts) END",
}
FEED_B = {
    "pid": "'u-' || CAST(event_id AS STRING)",
    "ward_code": (
        "CASE WHEN event_id % 25 = 0 THEN 'XX' ELSE CASE user_id % 4 WHEN 0 THEN 'MICU' WHEN 1 THEN ' SURG-ICU' "
        "WHEN 2 THEN 'CCU ' ELSE 'NEURO-ICU' END END"
    ),
    "room": "'Room 0' || CAST(user_id % 60 AS STRING)",
    "admission_ts": "MILLIS_INT(ts)",
}
BEDS = {
    "unit": "CASE s_suppkey % 4 WHEN 0 THEN 'ICU_MEDICAL' WHEN 1 THEN 'ICU_SURGICAL' WHEN 2 THEN 'ICU_CARDIAC' ELSE 'ICU_BURN' END",
    "bed_id": "s_name",
}
REFERENCE_DAY = "2024-01-31"

# A worse copy of the orders: rows missing, cells changed, rows repeated.
CANDIDATE = {
    "order_id": "o_orderkey",
    "status": "CASE WHEN o_orderkey % 11 = 0 THEN 'zz' WHEN o_orderkey % 9 = 0 THEN ' ' || lower(o_orderstatus) ELSE o_orderstatus END",
    "priority": "CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE o_orderpriority END",
    "price": "CASE WHEN o_orderkey % 7 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) + 1 END",
}
EXPECTED = {
    "order_id": "CAST(o_orderkey AS STRING)",
    "status": "o_orderstatus",
    "priority": "o_orderpriority",
    "price": "CAST(CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE)",
}
KEPT = "o_totalprice >= 15000"
REPEATED = "o_totalprice > 490000"
