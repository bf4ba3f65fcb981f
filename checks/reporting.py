"""Queries for conforming, reports, quality, comparison, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanframe.plans import compare as C
from cleanframe.plans import quality as Q
from cleanframe.plans import reports as R
from cleanframe.plans.conform import ICU_UNITS, WARD_CODE_UNITS, Feed, conform_feeds, look_up, orphans, tagged_union
from cleanframe.sources import json_rows, json_rows_drift, upsert

from .cleaning import _DAY, _DOSE, BLANK, FEEDS_SQL, MEDICATIONS_SQL, NULL_LIKE, ORDERS_SQL, _orders, feeds
from .dirt import (
    ADMISSIONS,
    BEDS,
    CANDIDATE,
    EXPECTED,
    KEPT,
    MEDICATIONS,
    PATIENTS,
    REFERENCE_DAY,
    REPEATED,
    for_duck,
)
from .registry import query

# -- counts per ward --------------------------------------------------------

SINCE = "1998-01-01"
_READ_AGE = "CASE WHEN regexp_matches(age, '^\\d+$') THEN CAST(age AS DOUBLE) END"
ADMISSIONS_SQL = (
    f"WITH raw AS (SELECT {for_duck(ADMISSIONS)} FROM orders JOIN customer ON o_custkey = c_custkey), "
    f"mid AS (SELECT median({_READ_AGE}) AS m FROM raw), "
    f"rows AS (SELECT row_no, trim(patient_id, {BLANK}) AS patient_id, CAST(coalesce(try_strptime(admission_date, '%Y-%m-%d'), "
    f"try_strptime(admission_date, '%d/%m/%Y')) AS DATE) AS admission_date, upper(trim(ward, {BLANK})) AS ward, "
    f"CAST(round_even(coalesce({_READ_AGE}, m), 0) AS BIGINT) AS age FROM raw, mid), "
    "complete AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY row_no) AS n FROM rows "
    "WHERE patient_id IS NOT NULL AND admission_date IS NOT NULL AND ward IS NOT NULL), "
    "clean AS (SELECT patient_id, admission_date, ward, age FROM complete WHERE n = 1)"
)


def admissions(t):
    raw = t.dirty(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), ADMISSIONS)
    return R.clean_admissions(raw, order_by=["row_no"])


@query(
    "clean_admissions",
    f"{ADMISSIONS_SQL} SELECT * REPLACE (strftime(admission_date, '%Y-%m-%d') AS admission_date) FROM clean",
)
def _(t):
    return admissions(t).withColumn("admission_date", F.date_format("admission_date", "yyyy-MM-dd"))


@query(
    "ward_counts",
    f"{ADMISSIONS_SQL} SELECT ward, count(*) AS patient_count FROM clean WHERE admission_date >= DATE '{SINCE}' "
    "GROUP BY ward ORDER BY patient_count DESC, ward",
)
def ward_counts(t):
    return R.ward_counts(admissions(t), SINCE)


# -- prescriptions ----------------------------------------------------------

PRESCRIPTIONS_SQL = (
    f"{MEDICATIONS_SQL}, p AS (SELECT {for_duck(PATIENTS)} FROM orders), "
    f"read AS (SELECT medication_id, trim(patient_id, {BLANK}) AS patient_id, drug_name AS raw_drug, "
    f"lower(trim(coalesce(drug_name, ''), {BLANK})) AS drug_name, round_even({_DOSE}, 2) AS dosage_mg, "
    f"{_DAY} AS prescribed_date FROM m), "
    "clean AS (SELECT * EXCLUDE (raw_drug) FROM read WHERE patient_id IN (SELECT patient_id FROM p) "
    "AND drug_name <> '' AND dosage_mg IS NOT NULL AND prescribed_date IS NOT NULL)"
)


def medications(t):
    return t.dirty(t.lineitem, MEDICATIONS)


def patients(t):
    return t.dirty(t.orders, PATIENTS)


@query(
    "clean_prescriptions",
    f"{PRESCRIPTIONS_SQL} SELECT * REPLACE (strftime(prescribed_date, '%Y-%m-%d') AS prescribed_date) FROM clean",
)
def _(t):
    cleaned = R.clean_prescriptions(medications(t), patients(t))
    return cleaned.withColumn("prescribed_date", F.date_format("prescribed_date", "yyyy-MM-dd"))


@query(
    "prescription_counts",
    f"{PRESCRIPTIONS_SQL} SELECT upper(ward) AS ward, drug_name, count(*) AS prescription_count FROM clean "
    "JOIN p USING (patient_id) WHERE prescribed_date >= DATE '2024-01-01' GROUP BY 1, 2 ORDER BY 1, 2",
)
def _(t):
    return R.prescription_counts(R.clean_prescriptions(medications(t), patients(t)), patients(t))


@query(
    "prescription_counts_raw",
    f"{PRESCRIPTIONS_SQL} SELECT upper(ward) AS ward, coalesce(raw_drug, '') AS drug_name, count(*) AS prescription_count "
    "FROM read JOIN p USING (patient_id) WHERE prescribed_date >= DATE '2024-01-01' GROUP BY 1, 2",
)
def _(t):
    return R.prescription_counts(medications(t), patients(t), normalize_drug=False)


@query(
    "orphans",
    f"{PRESCRIPTIONS_SQL} SELECT medication_id, patient_id FROM m WHERE trim(patient_id, {BLANK}) NOT IN (SELECT patient_id FROM p)",
)
def _(t):
    return orphans(medications(t).select("medication_id", "patient_id"), patients(t), "patient_id", "patient_id")


@query(
    "join_fanout",
    f"{PRESCRIPTIONS_SQL}, late AS (SELECT * FROM read WHERE prescribed_date >= DATE '2024-01-01'), "
    "x AS (SELECT (SELECT count(*) FROM clean JOIN p USING (patient_id) WHERE prescribed_date >= DATE '2024-01-01') AS reported_total, "
    "(SELECT count(*) FROM late JOIN p USING (patient_id)) AS inner_total, "
    "(SELECT count(*) FROM late) * (SELECT count(*) FROM p) AS cross_total) "
    "SELECT *, abs(reported_total - inner_total) <= abs(reported_total - cross_total) AS join_fixed FROM x",
)
def _(t):
    reported = R.prescription_counts(R.clean_prescriptions(medications(t), patients(t)), patients(t))
    return R.join_fanout(medications(t), patients(t), reported)


@query(
    "normalized_counts",
    f"{MEDICATIONS_SQL} SELECT upper(trim(drug_name, {BLANK})) AS drug_name, CAST(sum(trunc(CAST(dosage_mg AS DOUBLE))) AS BIGINT) AS dosage_mg "
    f"FROM m WHERE trim(drug_name, {BLANK}) <> '' AND regexp_matches(dosage_mg, '^\\d+\\.\\d+$') GROUP BY 1",
)
def _(t):
    return R.normalized_counts(medications(t), ["drug_name"], ["dosage_mg"])


# -- capacity ---------------------------------------------------------------

CONFORMED_SQL = (
    f"{FEEDS_SQL}, rows AS ("
    "SELECT 0 AS rank, patient_id AS nr, 'A' AS prefix, 'hospital_a' AS source_system, CAST(patient_id AS VARCHAR) AS source_record_id, "
    "icu_unit, coalesce('BED-' || nullif(regexp_extract(bed_number, '\\d+'), ''), 'BED-UNKNOWN') AS bed, "
    "try_strptime(admitted_at, '%Y-%m-%d %H:%M:%S') AS ts FROM a UNION ALL "
    "SELECT 1, admission_ts, 'B', 'hospital_b', pid, codes.icu_unit, 'BED-' || CAST(CAST(regexp_extract(room, '\\d+') AS INT) AS VARCHAR), "
    "make_timestamp_ms(admission_ts) FROM b JOIN codes ON trim(b.ward_code) = codes.ward_code), "
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY icu_unit, bed, time_bucket(INTERVAL 10 MINUTES, ts) "
    "ORDER BY rank, nr) AS n FROM rows WHERE ts IS NOT NULL), "
    "conformed AS (SELECT prefix || '-' || source_record_id AS patient_uid, source_system, source_record_id, icu_unit, "
    "prefix || '-' || bed AS bed_number, date_trunc('minute', ts) AS admitted_at, "
    "CASE WHEN date_trunc('minute', ts) >= TIMESTAMP '2024-01-24' THEN 'active' ELSE 'inactive' END AS status "
    "FROM numbered WHERE n = 1), "
    "occupied AS (SELECT icu_unit, count(*) AS o, count(*) FILTER (status = 'active') AS c FROM conformed GROUP BY 1), "
    "built AS (SELECT unit AS icu_unit, count(*) AS b FROM beds GROUP BY 1)"
)
_CAPACITY = (
    "SELECT icu_unit, coalesce(o, 0) AS current_occupancy, coalesce(b, 0) AS total_capacity, coalesce(c, 0) AS active_count "
    "FROM built {} JOIN occupied USING (icu_unit) ORDER BY icu_unit"
)


def conformed(t):
    a, b = feeds(t)
    return conform_feeds(
        [
            Feed("hospital_a", a, "A", "patient_id", "icu_unit", "bed_number", "admitted_at", "patient_id"),
            Feed("hospital_b", b, "B", "pid", "ward_code", "room", "admission_ts", "admission_ts", WARD_CODE_UNITS),
        ],
        REFERENCE_DAY,
    )


def beds(t):
    return t.dirty(t.supplier, BEDS)


@query(
    "conformed_feeds",
    f"{CONFORMED_SQL} SELECT * REPLACE (strftime(admitted_at, '%Y-%m-%d %H:%M:%S') AS admitted_at) FROM conformed",
)
def _(t):
    return conformed(t).withColumn("admitted_at", F.date_format("admitted_at", "yyyy-MM-dd HH:mm:ss"))


for how, join in (("left", "LEFT"), ("full", "FULL")):

    @query(f"capacity_{how}", f"{CONFORMED_SQL} {_CAPACITY.format(join)}")
    def _(t, how=how):
        return R.capacity_report(conformed(t), beds(t), how)


@query(
    "tagged_union",
    f"{FEEDS_SQL} SELECT 'hospital_a_patients' AS source_table, patient_id, bed_number, icu_unit, admitted_at, NULL AS pid, "
    "NULL AS ward_code, NULL AS room, NULL AS admission_ts FROM a UNION ALL SELECT 'hospital_b_patients', NULL, NULL, NULL, NULL, "
    "pid, ward_code, room, admission_ts FROM b",
)
def _(t):
    a, b = feeds(t)
    return tagged_union({"hospital_a_patients": a, "hospital_b_patients": b})


@query(
    "code_lookup",
    "SELECT c_custkey, coalesce(n_name, '') AS c_nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2",
)
def _(t):
    nations = t.nation.filter("n_regionkey <> 2").selectExpr("CAST(n_nationkey AS STRING) AS code", "n_name AS value")
    customers = t.customer.selectExpr("c_custkey", "CAST(c_nationkey AS STRING) AS c_nation")
    return look_up(customers, "c_nation", nations)


# The largest open order of each market segment, year and priority, from a least value on.
OPEN_ORDERS = """
SELECT c.c_mktsegment AS segment, year(o.o_orderdate) AS year, o.o_orderpriority AS update,
       max(o.o_totalprice) AS largest, count(DISTINCT o.o_custkey) AS customers
FROM orders AS o INNER JOIN customer AS c ON c.c_custkey = o.o_custkey
WHERE o.o_orderstatus = 'O' AND o.o_totalprice >= :least
GROUP BY ALL
"""


@query(
    "sql_passthrough",
    "WITH open_orders AS (SELECT *, extract(year FROM o_orderdate) AS y FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 150000) "
    "SELECT DISTINCT c_mktsegment AS segment, y AS year, o_orderpriority AS update, max(o_totalprice) OVER w AS largest, "
    "(SELECT count(*) FROM (SELECT DISTINCT i.o_custkey FROM open_orders i JOIN customer d ON d.c_custkey = i.o_custkey "
    "WHERE d.c_mktsegment = c.c_mktsegment AND i.y = o.y AND i.o_orderpriority = o.o_orderpriority)) AS customers "
    "FROM open_orders o JOIN customer c ON c.c_custkey = o.o_custkey WINDOW w AS (PARTITION BY c_mktsegment, y, o_orderpriority)",
)
def _(t):
    return R.read_sql(t.spark, OPEN_ORDERS, {"orders": t.orders, "customer": t.customer}, {"least": 150000})


@query(
    "top_rows",
    "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS row_count FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
def _(t):
    return R.top_rows(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])


# -- quality ----------------------------------------------------------------


@query(
    "profile",
    f"{ORDERS_SQL}, n AS (SELECT order_id, nullif(nullif(status, ''), 'N/A') AS status, priority, day FROM o) "
    "UNPIVOT (SELECT count(*) AS row_count, count(*) - count(order_id) AS order_id, count(*) - count(status) AS status, "
    "count(*) - count(priority) AS priority, count(*) - count(day) AS day FROM n) "
    "ON order_id, status, priority, day INTO NAME column_name VALUE null_count",
)
def _(t):
    from cleanframe.functions.values import nullify

    orders = _orders(t, "status", "priority", "day")
    return Q.profile(orders.withColumn("status", nullify(F.col("status"), NULL_LIKE)))


@query(
    "rule_ratios",
    f"{PRESCRIPTIONS_SQL}, r AS (SELECT count(*) AS row_count, "
    f"avg(CASE WHEN trim(m.patient_id, {BLANK}) IN (SELECT patient_id FROM p) THEN 1.0 ELSE 0 END) AS known_patient, "
    f"avg(CASE WHEN drug_name = lower(trim(drug_name, {BLANK})) AND drug_name <> '' THEN 1.0 ELSE 0 END) AS normalized_drug, "
    "avg(CASE WHEN regexp_matches(dosage_mg, '\\d') THEN 1.0 ELSE 0 END) AS numeric_dosage, "
    "avg(CASE WHEN regexp_matches(prescribed_date, '^\\d{4}-') THEN 1.0 ELSE 0 END) AS iso_date, "
    "greatest(0, 1 - abs(count(*) - (SELECT count(*) FROM clean)) / greatest(1, (SELECT count(*) FROM clean))) AS row_count_score FROM m) "
    "SELECT row_count, round(known_patient, 6) AS known_patient, round(normalized_drug, 6) AS normalized_drug, "
    "round(numeric_dosage, 6) AS numeric_dosage, round(iso_date, 6) AS iso_date, round(row_count_score, 6) AS row_count_score, "
    "round(0.3 * known_patient + 0.25 * normalized_drug + 0.25 * numeric_dosage + 0.1 * iso_date + 0.1 * row_count_score, 5) AS score FROM r",
)
def _(t):
    raw, known = medications(t), patients(t)
    expected = R.clean_prescriptions(raw, known).agg(F.count(F.lit(1)).alias("n")).scalar()
    iso = F.date_format(R.prescribed_date(F.col("prescribed_date")), "yyyy-MM-dd") == F.col("prescribed_date")
    ratios = Q.rule_ratios(raw, Q.prescription_rules(raw, known, iso, expected))
    rounded = [F.round(c, 5 if c == "score" else 6).alias(c) for c in ratios.columns if c != "row_count"]
    return ratios.select("row_count", *rounded)


_FEED_RATIOS = (
    "avg(CASE WHEN source_system IN ('hospital_a', 'hospital_b') THEN 1.0 ELSE 0 END) AS source_ok, "
    "avg(CASE WHEN icu_unit IN ('ICU_CARDIAC', 'ICU_MEDICAL', 'ICU_NEURO', 'ICU_SURGICAL') THEN 1.0 ELSE 0 END) AS unit_ok, "
    "avg(CASE WHEN regexp_matches(bed_number, '^[AB]-BED-(\\d+|UNKNOWN)$') THEN 1.0 ELSE 0 END) AS bed_ok, "
    "avg(CASE WHEN admitted_at IS NOT NULL THEN 1.0 ELSE 0 END) AS admitted_ok, "
    "avg(CASE WHEN status IN ('active', 'inactive') THEN 1.0 ELSE 0 END) AS status_ok, "
    "(SELECT count(*) FROM (SELECT DISTINCT icu_unit, bed_number, admitted_at FROM spoiled)) / count(*) AS not_duplicate, "
    "greatest(0, 1 - abs(count(*) - (SELECT count(*) FROM events)) / (SELECT count(*) FROM events)) AS row_count_score"
)
_SPOIL = {
    "icu_unit": "CASE WHEN substr(source_record_id, -1) = '4' THEN 'WARD' ELSE icu_unit END",
    "bed_number": "CASE WHEN substr(source_record_id, -1) = '6' THEN 'BED' ELSE bed_number END",
    "status": "CASE WHEN substr(source_record_id, -1) = '7' THEN 'gone' ELSE status END",
    "admitted_at": "CASE WHEN substr(source_record_id, -1) = '8' THEN NULL ELSE admitted_at END",
}


@query(
    "feed_ratios",
    f"{CONFORMED_SQL}, spoiled AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _SPOIL.items())}) FROM conformed), "
    f"r AS (SELECT count(*) AS row_count, {_FEED_RATIOS} FROM spoiled) SELECT row_count, "
    + ", ".join(
        f"round({c}, 6) AS {c}"
        for c in ("source_ok", "unit_ok", "bed_ok", "admitted_ok", "status_ok", "not_duplicate", "row_count_score")
    )
    + ", round(0.12 + 0.12 * source_ok + 0.16 * unit_ok + 0.16 * bed_ok + 0.14 * admitted_ok + 0.1 * status_ok "
    "+ 0.1 * not_duplicate + 0.1 * row_count_score, 5) AS score FROM r",
)
def _(t):
    spoiled = conformed(t).selectExpr(
        "patient_uid", "source_system", "source_record_id", *[f"{e} AS {c}" for c, e in _SPOIL.items()]
    )
    expected = t.events.agg(F.count(F.lit(1)).alias("n")).scalar()
    ratios = Q.rule_ratios(
        spoiled, Q.conformed_rules(spoiled, ICU_UNITS, expected), Q.CONFORMED_COLUMNS, Q.CONFORMED_COLUMN_WEIGHT
    )
    rounded = [F.round(c, 5 if c == "score" else 6).alias(c) for c in ratios.columns if c != "row_count"]
    return ratios.select("row_count", *rounded)


@query(
    "spec_ratios",
    f"{ORDERS_SQL}, r AS (SELECT count(*) AS row_count, avg(CASE WHEN status = upper(trim(status, {BLANK})) THEN 1.0 ELSE 0 END) AS status_type, "
    "avg(CASE WHEN regexp_matches(day, '^\\d{4}-\\d\\d-\\d\\d$') THEN 1.0 ELSE 0 END) AS day_type, "
    "avg(CASE WHEN priority IS NOT NULL THEN 1.0 ELSE 0 END) AS priority_present, "
    "(SELECT count(*) FROM (SELECT DISTINCT priority, day FROM o)) / count(*) AS not_duplicate FROM o) "
    "SELECT row_count, round(status_type, 6) AS status_type, round(day_type, 6) AS day_type, round(priority_present, 6) AS priority_present, "
    "round(not_duplicate, 6) AS not_duplicate, round((status_type + day_type + priority_present + not_duplicate) / 4, 5) AS score FROM r",
)
def _(t):
    orders = _orders(t, "status", "priority", "day")
    spec = {
        "dedupe_keys": ["priority", "day"],
        "type_requirements": {"status": "string_upper", "day": "date(YYYY-MM-DD)"},
        "null_handling": {"priority": "drop_invalid"},
    }
    ratios = Q.rule_ratios(orders, Q.clean_spec_rules(orders, spec))
    rounded = [F.round(c, 5 if c == "score" else 6).alias(c) for c in ratios.columns if c != "row_count"]
    return ratios.select("row_count", *rounded)


@query(
    "dup_ratio",
    "SELECT round(1 - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) / count(*), 6) AS duplicate_share FROM events",
)
def _(t):
    pairs = t.events.select("user_id", "event_type")
    per_pair = pairs.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return per_pair.agg(F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("duplicate_share"))


# -- comparison -------------------------------------------------------------


def candidate(t):
    orders = t.orders
    return t.dirty(orders.filter(KEPT).union(orders.filter(REPEATED)), CANDIDATE)


def expected(t):
    return t.dirty(t.orders, EXPECTED)


def _canon(c, kind):
    if kind == "text":
        return f"lower(trim({c}))"
    return f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"


_CELLS = ", ".join(
    f"{_canon(c, k)} AS {c}" for c, k in (("order_id", "n"), ("price", "n"), ("priority", "text"), ("status", "text"))
)
SIDES_SQL = (
    f"WITH c0 AS (SELECT {for_duck(CANDIDATE)} FROM (SELECT * FROM orders WHERE {KEPT} UNION ALL SELECT * FROM orders WHERE {REPEATED})), "
    f"e0 AS (SELECT {for_duck(EXPECTED)} FROM orders), c AS (SELECT {_CELLS} FROM c0), e AS (SELECT {_CELLS} FROM e0)"
)
_EQUAL = " + ".join(
    f"CAST(x.{c} IS NOT DISTINCT FROM y.{c} AS INT)" for c in ("status", "priority", "price")
)


@query(
    "cmp_cells_by_key",
    f"{SIDES_SQL}, first AS (SELECT DISTINCT * FROM c), "
    f"s AS (SELECT count(*) AS shared_keys, sum({_EQUAL}) AS matched_cells FROM first x JOIN e y USING (order_id)), "
    "q AS (SELECT shared_keys, CAST(matched_cells AS BIGINT) AS matched_cells, matched_cells / (3 * shared_keys) AS cell_accuracy, "
    "shared_keys / (SELECT count(*) FROM e) AS coverage, 1 - (SELECT count(DISTINCT order_id) FROM c) / (SELECT count(*) FROM c) AS duplicate_share FROM s) "
    "SELECT shared_keys, matched_cells, round(cell_accuracy, 6) AS cell_accuracy, round(coverage, 6) AS coverage, "
    "round(duplicate_share, 6) AS duplicate_share, round(0.7 * cell_accuracy + 0.3 * coverage - 0.2 * duplicate_share, 6) AS score FROM q",
)
def _(t):
    scores = C.cell_accuracy_by_key(candidate(t), expected(t), "order_id", ["status", "priority", "price"], ["status"])
    return scores.select(
        "shared_keys",
        "matched_cells",
        *[F.round(c, 6).alias(c) for c in ("cell_accuracy", "coverage", "duplicate_share", "score")],
    )


# Rows are laid side by side in the order of their texts; a double reads 7.0.
_PLACED = (
    "row_number() OVER (ORDER BY order_id, {price}, coalesce(priority, 'None'), status) AS place"
)


@query(
    "cmp_cells_positional",
    f"{SIDES_SQL}, x AS (SELECT *, {_PLACED.format(price='price')} FROM c), "
    f"y AS (SELECT *, {_PLACED.format(price="price || '.0'")} FROM e), "
    "n AS (SELECT greatest((SELECT count(*) FROM c), (SELECT count(*) FROM e)) * 4 AS total_cells) "
    f"SELECT CAST(sum(CAST(x.order_id IS NOT DISTINCT FROM y.order_id AS INT) + {_EQUAL}) AS BIGINT) AS matched_cells, any_value(total_cells) AS total_cells, "
    f"round(sum(CAST(x.order_id IS NOT DISTINCT FROM y.order_id AS INT) + {_EQUAL}) / any_value(total_cells), 6) AS accuracy "
    "FROM x FULL JOIN y USING (place), n",
)
def _(t):
    scores = C.cell_accuracy_by_position(candidate(t), expected(t))
    return scores.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "cmp_multiset",
    f"{SIDES_SQL} SELECT (SELECT count(*) FROM (SELECT * FROM c INTERSECT ALL SELECT * FROM e)) AS shared_rows, "
    "(SELECT count(*) FROM c) AS candidate_rows, (SELECT count(*) FROM e) AS expected_rows",
)
def _(t):
    return C.multiset_overlap(candidate(t), expected(t))


@query(
    "cmp_equal",
    f"{SIDES_SQL} SELECT NOT EXISTS (SELECT * FROM c EXCEPT ALL SELECT * FROM e) AND NOT EXISTS "
    "(SELECT * FROM e EXCEPT ALL SELECT * FROM c) AS same",
)
def _(t):
    return C.same_rows(candidate(t), expected(t))


@query(
    "cmp_equal_shuffled",
    f"{SIDES_SQL} SELECT NOT EXISTS (SELECT * FROM e EXCEPT ALL SELECT * FROM (SELECT * FROM e ORDER BY priority)) AS same",
)
def _(t):
    shuffled = expected(t).select(*reversed(expected(t).columns)).repartition(7, "priority")
    return C.same_rows(shuffled, expected(t))


# Every customer against a worse copy. The SQL tries all pairs.
_WORSE = {
    "id": "CAST(c_custkey AS STRING)",
    "name": "CASE WHEN c_custkey % 6 = 0 THEN 'Nobody' ELSE c_name END",
    "nation": "CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 100 ELSE c_nationkey END",
    "segment": "CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE lower(c_mktsegment) END",
}
_GOOD = {"id": "c_custkey", "name": "c_name", "nation": "c_nationkey", "segment": "c_mktsegment"}


def _lowered(columns):
    return ", ".join(f"lower(CAST({e} AS VARCHAR)) AS {n}" for n, e in columns.items())


@query(
    "cmp_best_match",
    f"WITH c AS (SELECT {_lowered(_WORSE)} FROM customer WHERE c_acctbal > -900), e AS (SELECT {_lowered(_GOOD)} FROM customer), "
    "x AS (SELECT count(*) AS equal_rows FROM (SELECT * FROM c INTERSECT ALL SELECT * FROM e)), "
    "b AS (SELECT e.id, max(CAST(c.id IS NOT DISTINCT FROM e.id AS INT) + CAST(c.name IS NOT DISTINCT FROM e.name AS INT) "
    "+ CAST(c.nation IS NOT DISTINCT FROM e.nation AS INT) + CAST(c.segment IS NOT DISTINCT FROM e.segment AS INT)) AS m FROM e, c GROUP BY 1), "
    "r AS (SELECT equal_rows, equal_rows / (SELECT count(*) FROM e) AS exact_ratio, (SELECT sum(m) / 4 FROM b) / (SELECT count(*) FROM e) AS partial_ratio FROM x) "
    "SELECT equal_rows, round(exact_ratio, 6) AS exact_ratio, round(partial_ratio, 6) AS partial_ratio, "
    "round(0.7 * exact_ratio + 0.3 * partial_ratio, 6) AS score FROM r",
)
def _(t):
    worse = t.dirty(t.customer.filter("c_acctbal > -900"), _WORSE)
    scores = C.row_similarity(worse, t.dirty(t.customer, _GOOD))
    return scores.select("equal_rows", *[F.round(c, 6).alias(c) for c in ("exact_ratio", "partial_ratio", "score")])


@query(
    "cmp_best_match_blocked",
    f"WITH c AS (SELECT {_lowered(_WORSE)} FROM customer WHERE c_acctbal > -900), e AS (SELECT {_lowered(_GOOD)} FROM customer), "
    "x AS (SELECT count(*) AS equal_rows FROM (SELECT * FROM c INTERSECT ALL SELECT * FROM e)), "
    "b AS (SELECT e.id, max(CAST(c.id IS NOT DISTINCT FROM e.id AS INT) + CAST(c.name IS NOT DISTINCT FROM e.name AS INT) "
    "+ 1 + CAST(c.segment IS NOT DISTINCT FROM e.segment AS INT)) AS m FROM e, c WHERE c.nation = e.nation GROUP BY 1), "
    "r AS (SELECT equal_rows, equal_rows / (SELECT count(*) FROM e) AS exact_ratio, (SELECT sum(m) / 4 FROM b) / (SELECT count(*) FROM e) AS partial_ratio FROM x) "
    "SELECT equal_rows, round(exact_ratio, 6) AS exact_ratio, round(partial_ratio, 6) AS partial_ratio, "
    "round(0.7 * exact_ratio + 0.3 * partial_ratio, 6) AS score FROM r",
)
def _(t):
    worse = t.dirty(t.customer.filter("c_acctbal > -900"), _WORSE)
    scores = C.row_similarity(worse, t.dirty(t.customer, _GOOD), block_by=["nation"])
    return scores.select("equal_rows", *[F.round(c, 6).alias(c) for c in ("exact_ratio", "partial_ratio", "score")])


# thirty columns, most of few values, one value in half of the rows
_WIDE = {
    "id": "c_custkey",
    "name": "c_name",
    "nation": "c_nationkey",
    "segment": "c_mktsegment",
    "half": "CASE WHEN c_custkey % 2 = 0 THEN 'same' ELSE c_name END",
    **{f"d{m:02}": f"(c_custkey * {2 * m + 1} + c_nationkey) % {m}" for m in range(2, 27)},
}
_WIDE_WORSE = {
    c: "c_custkey + 1000000" if c == "id" else f"CASE WHEN (c_custkey * 13 + {i}) % 7 = 0 THEN NULL ELSE {e} END" for i, (c, e) in enumerate(_WIDE.items())
}


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


@query(
    "cmp_best_match_wide",
    f"WITH c AS (SELECT {_columns(_WIDE_WORSE)} FROM customer WHERE c_acctbal > -500), e AS (SELECT {_columns(_WIDE)} FROM customer), "
    f"b AS (SELECT e.id, max({' + '.join(f'CAST(c.{c} IS NOT DISTINCT FROM e.{c} AS INT)' for c in _WIDE)}) AS m FROM e, c GROUP BY 1) "
    "SELECT CAST(0 AS BIGINT) AS equal_rows, round(sum(m) / 30 / count(*), 6) AS partial_ratio, round(0.3 * (sum(m) / 30 / count(*)), 6) AS score FROM b",
)
def _(t):
    worse = t.customer.filter("c_acctbal > -500").selectExpr(*[f"{e} AS {c}" for c, e in _WIDE_WORSE.items()])
    scores = C.row_similarity(worse, t.customer.selectExpr(*[f"{e} AS {c}" for c, e in _WIDE.items()]))
    return scores.select("equal_rows", *[F.round(c, 6).alias(c) for c in ("partial_ratio", "score")])


_PAIRS = (
    "x AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY status) AS place FROM c), "
    "y AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY status) AS place FROM e)"
)


@query(
    "cmp_blended",
    f"{SIDES_SQL}, {_PAIRS}, s AS (SELECT sum(CASE WHEN x.order_id IS NOT NULL THEN 1 + {_EQUAL} ELSE 0 END) / 4 AS sim FROM y LEFT JOIN x USING (order_id, place)), "
    "r AS (SELECT (SELECT count(*) FROM e) AS ne, (SELECT count(*) FROM c) AS nc, "
    "(SELECT count(*) FROM (SELECT * FROM c INTERSECT ALL SELECT * FROM e)) AS same, sim FROM s) "
    "SELECT round(0.55 * same / ne + 0.25 * sim / ne + 0.1 + 0.1 * (1 - abs(nc - ne) / ne), 5) AS score, round(sim / ne, 5) AS partial_match, "
    "round(1 - abs(nc - ne) / ne, 5) AS row_count_score, round(same / ne, 5) AS exact_row_match_score, ne AS row_count_expected, "
    "nc AS row_count_actual, same = ne AND ne = nc AS exact_match FROM r",
)
def _(t):
    scores = C.blended_match(candidate(t), expected(t), ["order_id"], ["status"])
    rounded = ("score", "partial_match", "row_count_score", "exact_row_match_score")
    return scores.select(
        *[F.round(c, 5).alias(c) for c in rounded], "row_count_expected", "row_count_actual", "exact_match"
    )


@query(
    "cmp_row_comparisons",
    f"{SIDES_SQL}, {_PAIRS} SELECT row_number() OVER (ORDER BY y.status, CAST(y.order_id AS BIGINT)) - 1 AS expected_index, "
    f"CASE WHEN x.order_id IS NOT NULL THEN (1 + {_EQUAL}) / 4 ELSE 0 END AS similarity FROM y LEFT JOIN x USING (order_id, place) "
    "ORDER BY y.status, CAST(y.order_id AS BIGINT) LIMIT 20",
)
def _(t):
    wanted = expected(t).withColumn("order_id", F.col("order_id").cast("bigint"))
    shown = C.row_comparisons(candidate(t), wanted, ["order_id"], ["status", "order_id"])
    return shown.select(F.col("expected_index").cast("bigint").alias("expected_index"), "similarity")


# customers in blocks of several rows, few values in each column, so that rows repeat
_KIN = {"a": "c_custkey % 4", "b": "(c_custkey * 7) % 3", "d": "(c_custkey * 11) % 5", "half": "c_custkey % 2", "segment": "c_mktsegment"}
_KIN_WORSE = {c: f"CASE WHEN (c_custkey * 13 + {i}) % 3 = 0 THEN NULL ELSE {e} END" for i, (c, e) in enumerate(_KIN.items())}
_KIN_ROW = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _KIN)


@query(
    "cmp_blended_similarity",
    f"WITH c0 AS (SELECT c_custkey AS k, c_nationkey * 9 + c_custkey % 9 AS block, {_columns(_KIN_WORSE)} FROM customer WHERE c_acctbal > -500), "
    f"e0 AS (SELECT c_custkey AS k, c_nationkey * 9 + c_custkey % 9 AS block, {_columns(_KIN)} FROM customer), "
    f"c AS (SELECT block, {_KIN_ROW} AS row, any_value(struct_pack({', '.join(f'{c} := {c}' for c in _KIN)})) AS v, count(*) AS n, min(k) AS k FROM c0 GROUP BY 1, 2), "
    f"e AS (SELECT block, {_KIN_ROW} AS row, any_value(struct_pack({', '.join(f'{c} := {c}' for c in _KIN)})) AS v, count(*) AS n, min(k) AS k FROM e0 GROUP BY 1, 2), "
    "x AS (SELECT e.block, e.row, least(e.n, c.n) AS n FROM e JOIN c ON e.block = c.block AND e.row = c.row), "
    "p AS (SELECT e.block, e.row, e.v, e.k, e.n - coalesce(x.n, 0) AS n FROM e LEFT JOIN x ON x.block = e.block AND x.row = e.row), "
    "q AS (SELECT c.block, c.row, c.v, c.k, c.n - coalesce(x.n, 0) AS n FROM c LEFT JOIN x ON x.block = c.block AND x.row = c.row), "
    f"g AS (SELECT p.block, p.row AS p, q.row AS q, p.k AS pk, q.k AS qk, p.n AS le, q.n AS lc, {' + '.join(f'CAST(p.v.{c} IS NOT DISTINCT FROM q.v.{c} AS INT)' for c in _KIN)} AS same "
    "FROM p JOIN q ON p.block = q.block WHERE p.n > 0 AND q.n > 0), "
    "r AS (WITH RECURSIVE r(it, block, p, q, pk, qk, le, lc, same) AS (SELECT 0, block, p, q, pk, qk, le, lc, same FROM g WHERE same > 0 UNION ALL "
    "SELECT it + 1, block, p, q, pk, qk, le2, lc2, same FROM (SELECT *, CASE WHEN p = fp THEN le - take ELSE le END AS le2, CASE WHEN q = fq THEN lc - take ELSE lc END AS lc2 FROM ("
    "SELECT *, first_value(p) OVER w AS fp, first_value(q) OVER w AS fq, first_value(least(le, lc)) OVER w AS take FROM r WINDOW w AS (PARTITION BY block ORDER BY same DESC, pk, qk)) AS y) AS z "
    "WHERE le2 > 0 AND lc2 > 0) SELECT * FROM r), "
    "t AS (SELECT same * least(le, lc) AS cells, row_number() OVER (PARTITION BY it, block ORDER BY same DESC, pk, qk) AS place FROM r), "
    "s AS (SELECT coalesce((SELECT sum(n) FROM x), 0) AS same, (SELECT sum(cells) FROM t WHERE place = 1) AS cells, (SELECT count(*) FROM e0) AS ne, (SELECT count(*) FROM c0) AS nc), "
    f"u AS (SELECT count(*) AS n FROM (SELECT {', '.join(_KIN)} FROM c0 INTERSECT ALL SELECT {', '.join(_KIN)} FROM e0)) "
    "SELECT round((same + cells / 5) / ne, 6) AS partial_match, round(u.n / ne, 6) AS exact_row_match_score, "
    "round(0.55 * u.n / ne + 0.25 * (same + cells / 5) / ne + 0.1 + 0.1 * (1 - abs(nc - ne) / ne), 5) AS score FROM s, u",
)
def _(t):
    def side(columns):
        return [*[f"{e} AS {c}" for c, e in columns.items()], "c_custkey AS k{0}", "c_nationkey * 9 + c_custkey % 9 AS block{0}"]

    # the block and the order are no cells to compare
    made = t.customer.filter("c_acctbal > -500").selectExpr(*[c.format("") for c in side(_KIN_WORSE)])
    wanted = t.customer.selectExpr(*[c.format("") for c in side(_KIN)])
    scores = C.blended_match(made, wanted, ["block"], ["k"], pair_by="similarity", columns=list(_KIN))
    return scores.select(F.round("partial_match", 6).alias("partial_match"), F.round("exact_row_match_score", 6).alias("exact_row_match_score"), F.round("score", 5).alias("score"))


def _reports(t):
    """Counts per status and priority of both sides, with one group each missing."""
    keys = ["status", "priority"]
    measures = [F.count(F.lit(1)).alias("orders"), F.sum(F.col("price").cast("bigint")).alias("total")]
    made = candidate(t).filter("priority IS NULL OR priority <> '1-URGENT' OR status = 'F'").groupBy(*keys).agg(*measures)
    wanted = expected(t).filter("priority <> '5-LOW' OR status = 'O'").groupBy(*keys).agg(*measures)
    return made, wanted


REPORTS_SQL = (
    f"{SIDES_SQL}, gc AS (SELECT upper(trim(status)) AS status, upper(priority) AS priority, status AS s0, count(*) AS orders, "
    "CAST(sum(CAST(price AS BIGINT)) AS BIGINT) AS total FROM c0 WHERE (priority IS NULL OR priority <> '1-URGENT' OR status = 'F') "
    "GROUP BY 1, 2, 3 HAVING upper(priority) IS NOT NULL), "
    "ge AS (SELECT upper(status) AS status, upper(priority) AS priority, count(*) AS orders, CAST(sum(CAST(price AS BIGINT)) AS BIGINT) AS total "
    "FROM e0 WHERE priority <> '5-LOW' OR status = 'O' GROUP BY 1, 2), "
    "summed AS (SELECT status, priority, sum(orders) AS orders FROM gc GROUP BY 1, 2), "
    "kept AS (SELECT status, priority, max(orders) AS orders, arg_max(total, orders) AS total FROM gc GROUP BY 1, 2)"
)


@query(
    "cmp_grouped",
    f"{REPORTS_SQL} SELECT count(*) AS keys, round(avg(greatest(0, 1 - abs(coalesce(a.orders, 0) - coalesce(ge.orders, 0)) / greatest(1, coalesce(ge.orders, 0)))), 6) AS accuracy "
    "FROM summed a FULL JOIN ge USING (status, priority)",
)
def _(t):
    made, wanted = _reports(t)
    return C.grouped_measure_accuracy(made, wanted, ["status", "priority"], "orders").withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@query(
    "cmp_expected_measure",
    f"{REPORTS_SQL}, unnamed AS (SELECT DISTINCT upper(trim(status)) AS status FROM c0 WHERE priority IS NULL), "
    "m AS (SELECT avg(CASE WHEN a.orders IS NULL THEN 0 ELSE greatest(0, 1 - abs(a.orders - ge.orders) / greatest(1, ge.orders)) END) AS match "
    "FROM ge LEFT JOIN kept a USING (status, priority)), n AS (SELECT (SELECT count(*) FROM kept) + (SELECT count(*) FROM unnamed) AS a, (SELECT count(*) FROM ge) AS e) "
    "SELECT round(match, 6) AS match, round(0.75 * match + 0.15 * greatest(0, 1 - abs(a - e) / e) + 0.1, 6) AS score FROM m, n",
)
def _(t):
    made, wanted = _reports(t)
    scores = C.expected_measure_match(made, wanted, ["status", "priority"], "orders")
    return scores.select(F.round("match", 6).alias("match"), F.round("score", 6).alias("score"))


@query(
    "cmp_multi_measure",
    f"{REPORTS_SQL}, m AS (SELECT avg(CASE WHEN a.orders IS NULL OR ge.orders IS NULL THEN 0 ELSE "
    "(greatest(0, 1 - abs(a.orders - ge.orders) / greatest(1, ge.orders)) + greatest(0, 1 - abs(a.total - ge.total) / greatest(1, ge.total))) / 2 END) AS mean "
    "FROM kept a FULL JOIN ge USING (status, priority)), n AS (SELECT (SELECT count(*) FROM kept) AS a, (SELECT count(*) FROM ge) AS e) "
    "SELECT round(mean, 6) AS mean, round(0.85 * mean + 0.15 * greatest(0, 1 - abs(a - e) / e), 5) AS score FROM m, n",
)
def _(t):
    made, wanted = _reports(t)
    scores = C.multi_measure_accuracy(made, wanted, ["status", "priority"], ["orders", "total"])
    return scores.select(F.round("mean", 6).alias("mean"), F.round("score", 5).alias("score"))


@query(
    "coverage",
    f"{SIDES_SQL} SELECT round((SELECT count(*) FROM (SELECT order_id FROM c INTERSECT SELECT order_id FROM e)) / (SELECT count(*) FROM e), 6) AS coverage, "
    "round(1 - (SELECT count(DISTINCT order_id) FROM c) / (SELECT count(*) FROM c), 6) AS duplicate_share",
)
def _(t):
    wanted = expected(t).withColumn("order_id", F.col("order_id").cast("bigint"))
    shares = Q.coverage(candidate(t), wanted, ["order_id"])
    return shares.select(*[F.round(c, 6).alias(c) for c in shares.columns])


# -- sources and sinks ------------------------------------------------------


@query(
    "upsert",
    "WITH n AS (SELECT c_custkey, 'moved' AS c_name, c_acctbal FROM customer WHERE c_acctbal < 1000 "
    "UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000) "
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL FROM n",
)
def _(t):
    customers = t.customer.select("c_custkey", "c_name", "c_acctbal")
    moved = customers.filter("c_acctbal < 1000").withColumn("c_name", F.lit("moved"))
    new = customers.filter("c_acctbal > 9000").withColumn("c_custkey", F.col("c_custkey") + 10000000)
    stale = moved.withColumn("c_name", F.lit("stale"))
    changes = moved.union(new).withColumn("nr", F.lit(2)).union(stale.withColumn("nr", F.lit(1)))
    return upsert(customers, changes, "c_custkey", order_by=["nr"])


@query(
    "json_rows",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    arrays = t.events.select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("rows"))
    return json_rows(arrays, "rows", "k bigint")


@query(
    "json_rows_drift",
    "SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, "
    "CASE WHEN event_id % 7 <> 0 AND event_id % 5 = 1 THEN 'x' END AS note, "
    "CASE WHEN event_id % 7 = 0 THEN 'broken {' END AS malformed FROM events",
)
def _(t):
    odd = F.when(F.col("event_id") % 7 == 0, "broken {").when(F.col("event_id") % 5 == 0, '{"k": {"deep": 1}, "other": [1]}')
    odd = odd.when(F.col("event_id") % 5 == 1, F.regexp_replace("props", "^\\{", '{"note": "x", '))
    texts = t.events.select("event_id", odd.otherwise(F.concat(F.lit("["), "props", F.lit("]"))).alias("rows"))
    return json_rows_drift(texts, "rows", "k bigint, note string").drop("extra")


@query(
    "cmp_fingerprint",
    f"{SIDES_SQL} SELECT NOT EXISTS (SELECT * FROM c EXCEPT ALL SELECT * FROM e) AND NOT EXISTS "
    "(SELECT * FROM e EXCEPT ALL SELECT * FROM c) AS sides, "
    "NOT EXISTS (SELECT * FROM e EXCEPT ALL SELECT * FROM (SELECT * FROM e ORDER BY priority)) AS shuffled",
)
def _(t):
    shuffled = expected(t).select(*reversed(expected(t).columns)).repartition(7, "priority")
    sides = C.same_fingerprints(candidate(t), expected(t)).select(F.struct("same").alias("s")).scalar()
    return C.same_fingerprints(shuffled, expected(t)).select(sides["same"].alias("sides"), F.col("same").alias("shuffled"))


@query(
    "cmp_differing_rows",
    f"{SIDES_SQL}, b AS (SELECT *, 1 AS n, 0 AS m FROM c UNION ALL SELECT *, 0, 1 FROM e) "
    "SELECT order_id, price, priority, status, CAST(sum(n) AS BIGINT) AS candidate_rows, CAST(sum(m) AS BIGINT) AS expected_rows FROM b GROUP BY 1, 2, 3, 4 HAVING sum(n) <> sum(m)",
)
def _(t):
    return C.differing_rows(candidate(t), expected(t))
