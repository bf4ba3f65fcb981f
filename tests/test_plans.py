from datetime import date

import pytest
from pyspark.sql import functions as F

from cleanframe.errors import SpecError
from cleanframe.plans import quality as Q
from cleanframe.plans import reports as R
from cleanframe.plans.conform import WARD_CODE_UNITS, Feed, conform_feeds, known_parents, look_up, orphans, tagged_union

from .conftest import rows

ADMISSIONS = "nr int, patient_id string, admission_date string, ward string, age string"


def admissions(table):
    return table(
        ADMISSIONS,
        (1, " P1 ", "2024-05-01", "icu ", "40"),
        (2, "P1", "2023-05-01", "ER", "41"),
        (3, "P2", "1/12/2024", "Icu", "N/A"),
        (4, "P3", "31/12/2023", "er", "51"),
        (5, "P4", "someday", "er", "90"),
        (6, None, "2024-01-01", "er", None),
        (7, "P5", "2024-01-01", None, "62"),
        (8, "P6", "2024-01-01", "er", None),
    )


def test_clean_admissions(table):
    got = R.clean_admissions(admissions(table), ["nr"])
    # the median of 40 41 51 90 62 is 51
    assert rows(got) == [
        ("P1", date(2024, 5, 1), "ICU", 40),
        ("P2", date(2024, 12, 1), "ICU", 51),
        ("P3", date(2023, 12, 31), "ER", 51),
        ("P6", date(2024, 1, 1), "ER", 51),
    ]


def test_ward_counts_in_order(table):
    got = R.ward_counts(R.clean_admissions(admissions(table), ["nr"]))
    assert [tuple(r) for r in got.collect()] == [("ICU", 2), ("ER", 1)]


def test_ages_without_any_number_stay_missing(table):
    got = R.clean_admissions(table(ADMISSIONS, (1, "P1", "2024-05-01", "icu", "N/A")), ["nr"])
    assert rows(got) == [("P1", date(2024, 5, 1), "ICU", None)]


MEDICATIONS = "medication_id string, patient_id string, drug_name string, dosage_mg string, prescribed_date string"


def medications(table):
    return table(
        MEDICATIONS,
        ("m1", "P1", "Aspirin ", "100mg", "2024-02-01"),
        ("m2", " P1", "aspirin", "99.995", "1706745600"),
        ("m3", "X9", "aspirin", "1", "2024-02-01"),
        ("m4", "P2", "  ", "1", "2024-02-01"),
        ("m5", "P2", "Metformin", "none", "2024-02-01"),
        ("m6", "P2", "Metformin", "5 mg", "2023-12-31"),
        ("m7", "P2", "METFORMIN", "5.0", "1706745600000"),
        ("m8", None, "METFORMIN", "5.0", "2024-02-01"),
        ("m9", "P2", "METFORMIN", "5.0", "170674560"),
    )


def patients(table):
    return table("patient_id string, ward string", ("P1", "icu"), ("P2 ", "ER"), ("P3", "OBS"), ("", "OBS"))


def test_clean_prescriptions(table):
    got = R.clean_prescriptions(medications(table), patients(table))
    assert rows(got) == [
        ("m1", "P1", "aspirin", 100.0, date(2024, 2, 1)),
        ("m2", "P1", "aspirin", 100.0, date(2024, 2, 1)),
        ("m6", "P2", "metformin", 5.0, date(2023, 12, 31)),
        ("m7", "P2", "metformin", 5.0, date(2024, 2, 1)),
    ]


def test_prescription_counts(table):
    got = R.prescription_counts(R.clean_prescriptions(medications(table), patients(table)), patients(table))
    assert [tuple(r) for r in got.collect()] == [("ER", "metformin", 1), ("ICU", "aspirin", 2)]
    raw = R.prescription_counts(medications(table), patients(table), normalize_drug=False)
    assert ("ICU", "Aspirin ", 1) in rows(raw) and ("ER", "  ", 1) in rows(raw)


def test_join_fanout_tells_the_joins_apart(table):
    m, p = medications(table), patients(table)
    fixed = R.join_fanout(m, p).first()
    assert (fixed.inner_total, fixed.cross_total, fixed.join_fixed) == (5, 28, True)
    crossed = table("ward string, drug_name string, prescription_count bigint", ("ICU", "a", 28))
    assert R.join_fanout(m, p, crossed).first().join_fixed is False
    nothing = crossed.filter("false")
    assert R.join_fanout(m, p, nothing).first().join_fixed is False


def test_normalized_counts(table):
    report = table("ward string, n string", (" icu", "2.9"), ("ICU", "3"), ("", "1"), (None, "1"), ("er", "many"))
    assert rows(R.normalized_counts(report, ["ward"], ["n"])) == [("ICU", 5)]


def test_known_parents_and_orphans_split_the_rows(table):
    children = table("k string, v int", (" a", 1), ("b", 2), ("", 3), (None, 4), ("a", 5))
    parents = table("id string", ("a",), ("a",), ("",))
    assert rows(known_parents(children, parents, "k", "id")) == [(" a", 1), ("a", 5)]
    assert rows(orphans(children, parents, "k", "id")) == [("", 3), ("b", 2), (None, 4)]


def test_a_hot_child_key_is_split_by_adaptive_execution(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        children = spark.range(0, 60000, numPartitions=8).selectExpr(
            "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS k", "id"
        )
        parents = spark.range(60000).selectExpr("CASE WHEN id = 0 THEN 'hot' ELSE concat('k', id) END AS k")
        known = known_parents(children, parents, "k", "k")
        assert len(known.collect()) == 60000
        assert "skew=true" in known._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_look_up_by_dict_and_table(table):
    df = table("c string", ("x",), ("q",), (None,))
    codes = table("code string, value string", ("x", "X"))
    for given in ({"x": "X"}, codes):
        assert rows(look_up(df, "c", given)) == [("",), ("",), ("X",)]


def test_tagged_union_makes_mixed_columns_text(table):
    got = tagged_union({"one": table("id int, a int", (1, 2)), "two": table("id string, b int", ("x", 3))}, "src")
    assert rows(got) == [("one", "1", 2, None), ("two", "x", None, 3)]


def feeds(table):
    a = table(
        "patient_id int, bed_number string, icu_unit string, admitted_at string",
        (1, "Bed 7", "ICU_NEURO", "2024-01-30 10:01:30"),
        (2, "Bed 07", "ICU_NEURO", "2024-01-30 10:09:00"),
        (3, "Bed 7", "ICU_NEURO", "2024-01-30 10:10:00"),
        (4, "Bed 7", "WARD", "2024-01-30 10:10:00"),
        (5, "Bed 7", "ICU_NEURO", "soon"),
    )
    b = table(
        "pid string, ward_code string, room string, admission_ts bigint",
        ("u1", " NCCU", "Room 7", 1706609050000),  # 10:04:10, the bed and bucket of patient 1
        ("u2", "CCU", "Room", 1704067200000),
        ("u3", "XX", "Room 7", 1704067200000),
    )
    return conform_feeds(
        [
            Feed("hospital_a", a, "A", "patient_id", "icu_unit", "bed_number", "admitted_at", "patient_id"),
            Feed("hospital_b", b, "B", "pid", "ward_code", "room", "admission_ts", "admission_ts", WARD_CODE_UNITS),
        ],
        "2024-01-31",
    )


def test_conform_feeds_prefers_the_first_feed(table):
    got = feeds(table).withColumn("admitted_at", F.date_format("admitted_at", "MM-dd HH:mm:ss"))
    assert rows(got) == [
        ("A-1", "hospital_a", "1", "ICU_NEURO", "A-BED-7", "01-30 10:01:00", "active"),
        ("A-3", "hospital_a", "3", "ICU_NEURO", "A-BED-7", "01-30 10:10:00", "active"),
        ("B-u2", "hospital_b", "u2", "ICU_CARDIAC", "B-BED-UNKNOWN", "01-01 00:00:00", "inactive"),
    ]


def test_code_table_gives_the_same_feeds_as_a_dict(table):
    codes = table("ward_code string, icu_unit string", *WARD_CODE_UNITS.items())
    b = table("pid string, ward_code string, room string, admission_ts bigint", ("u1", " NCCU", "Room 7", 1706609050000))
    feed = Feed("hospital_b", b, "B", "pid", "ward_code", "room", "admission_ts", "admission_ts", codes)
    assert conform_feeds([feed], "2024-01-31").first().icu_unit == "ICU_NEURO"


def test_capacity_report_left_and_full(table):
    beds = table("unit string, bed_id string", ("ICU_NEURO", "1"), ("ICU_NEURO", "2"), ("ICU_BURN", "3"))
    left = R.capacity_report(feeds(table), beds)
    full = R.capacity_report(feeds(table), beds, "full")
    assert [tuple(r) for r in left.collect()] == [("ICU_BURN", 0, 1, 0), ("ICU_NEURO", 2, 2, 2)]
    assert [tuple(r) for r in full.collect()] == [("ICU_BURN", 0, 1, 0), ("ICU_CARDIAC", 1, 0, 0), ("ICU_NEURO", 2, 2, 2)]
    with pytest.raises(SpecError):
        R.capacity_report(feeds(table), beds, "inner")


# -- SQL --------------------------------------------------------------------


def test_read_sql_binds_parameters_and_leaves_no_view(spark, table):
    t = table("a int", (1,), (2,))
    assert rows(R.read_sql(spark, " WITH x AS (SELECT a FROM t) SELECT a FROM x WHERE a > :n; ", {"t": t}, {"n": 1})) == [(2,)]
    assert not spark.catalog.tableExists("t")


def test_read_sql_restores_a_view_of_the_same_name(spark, table):
    table("a int", (9,)).createOrReplaceTempView("mine")
    R.read_sql(spark, "select * from mine", {"mine": table("a int", (1,))})
    assert rows(spark.table("mine")) == [(9,)]
    spark.catalog.dropTempView("mine")


@pytest.mark.parametrize(
    "query",
    ["", "show tables", "select 1; select 2", "with x as (select 1) insert into t select * from x", "drop table t", "select 1 -- x\n; drop table t"],
)
def test_read_sql_refuses_everything_else(spark, query):
    with pytest.raises(SpecError):
        R.read_sql(spark, query, {})


def test_read_sql_allows_write_words_in_quotes(spark):
    assert rows(R.read_sql(spark, "select 'insert; drop' as a -- delete\n", {})) == [("insert; drop",)]


def test_top_rows(table):
    got = R.top_rows(table("a int", (3,), (1,), (2,)), ["a"], 2)
    assert rows(got) == [(1, 3), (2, 3)]


# -- quality ----------------------------------------------------------------


def test_profile(table):
    got = Q.profile(table("a int, b string", (1, None), (None, None), (3, "x")))
    assert rows(got) == [(3, "a", 1), (3, "b", 2)]


def test_closeness_and_distinct_share(spark, table):
    df = table("a int, e int", (8, 10), (30, 10), (0, 0), (5, 0))
    assert [r[0] for r in df.select(Q.closeness(F.col("a"), F.col("e"))).collect()] == pytest.approx([0.8, 0, 1, 0])
    pairs = table("a int, b int", (1, None), (1, None), (1, 2), (None, None))
    assert pairs.limit(1).select(Q.distinct_share(pairs, ["a", "b"])).first()[0] == 0.75


def test_prescription_rules(table):
    m, p = medications(table), patients(table)
    iso = F.date_format(R.prescribed_date(F.col("prescribed_date")), "yyyy-MM-dd") == F.col("prescribed_date")
    got = Q.rule_ratios(m, Q.prescription_rules(m, p, iso, 9)).first()
    assert got.known_patient == pytest.approx(7 / 9)
    assert got.normalized_drug == pytest.approx(2 / 9)
    assert got.numeric_dosage == pytest.approx(8 / 9)
    assert got.iso_date == pytest.approx(6 / 9)
    assert got.score == pytest.approx(0.3 * 7 / 9 + 0.25 * 2 / 9 + 0.25 * 8 / 9 + 0.1 * 6 / 9 + 0.1, abs=1e-6)


def test_conformed_rules_are_full_on_conformed_feeds_and_short_on_missing_columns(table):
    good = feeds(table)
    rules = Q.conformed_rules(good, Q_UNITS, 3)
    assert Q.rule_ratios(good, rules, Q.CONFORMED_COLUMNS, Q.CONFORMED_COLUMN_WEIGHT).first().score == 1.0
    short = good.drop("status")
    got = Q.rule_ratios(short, [], Q.CONFORMED_COLUMNS).first()
    assert got.score == pytest.approx(0.2 * 6 / 7, abs=1e-6)
    assert Q.rule_ratios(good.filter("false"), rules, Q.CONFORMED_COLUMNS, Q.CONFORMED_COLUMN_WEIGHT).first().score == 0.0


Q_UNITS = sorted(set(WARD_CODE_UNITS.values()))


def test_clean_spec_rules(table):
    df = table("id string, ward string, age string, day string", ("a", "ER", "5", "2024-01-01"), ("a", "er", None, "1/1/24"))
    spec = {
        "dedupe_keys": ["id"],
        "type_requirements": {"id": "string", "ward": "string_upper", "age": "int_nullable", "day": "date(YYYY-MM-DD)"},
        "null_handling": {"age": "median_impute"},
        "string_normalization": {"ward": "strip + uppercase"},
    }
    got = Q.rule_ratios(df, Q.clean_spec_rules(df, spec)).first().asDict()
    assert got.pop("row_count") == 2
    assert got.pop("score") == pytest.approx((1 + 0.5 + 1 + 0.5 + 0.5 + 0.5 + 0.5) / 7, abs=1e-6)
    assert got == {
        "id_type": 1.0, "ward_type": 0.5, "age_type": 1.0, "day_type": 0.5, "age_present": 0.5, "ward_normalized": 0.5, "not_duplicate": 0.5,
    }
    with pytest.raises(SpecError):
        Q.clean_spec_rules(df, {"type_requirements": {"id": "uuid"}})


def test_coverage(table):
    got = Q.coverage(table("k int", (1,), (1,), (9,)), table("k int", (1,), (2,)), ["k"]).first()
    assert (got.coverage, got.duplicate_share) == (0.5, pytest.approx(1 / 3))
