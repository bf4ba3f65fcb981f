from datetime import date, datetime

import pytest
from pyspark.sql import functions as F, types as T

from cleanframe.errors import SpecError
from cleanframe.functions import values as V

from .conftest import column

TEXT = T.StringType()


def one(spark, make, *cells, type="string"):
    df = spark.createDataFrame([(c,) for c in cells], f"c {type}").coalesce(1)
    return [r[0] for r in df.select(make(F.col("c"))).collect()]


def test_strip_knows_every_whitespace(spark):
    assert one(spark, V.strip, "\t a b  \x1c\n", "", None) == ["a b", "", None]


@pytest.mark.parametrize(
    "text,number",
    [
        (" 12.5 ", 12.5),
        ("-.5", -0.5),
        ("7.", 7.0),
        ("1e3", 1000.0),
        ("5d", None),
        ("5f", None),
        ("nan", None),
        ("1e400", None),
        ("81mg", None),
        ("N/A", None),
        ("", None),
        (None, None),
    ],
)
def test_try_num(spark, text, number):
    assert one(spark, V.try_num, text) == [number]


def test_try_num_of_numbers(spark):
    double = T.DoubleType()
    cells = [1.5, float("nan"), float("inf"), None]
    assert one(spark, lambda c: V.try_num(c, double), *cells, type="double") == [1.5, None, None, None]
    assert one(spark, lambda c: V.try_num(c, T.IntegerType()), 3, type="int") == [3.0]


def test_to_whole(spark):
    texts = ["2.5", "3.5", "-2.5", "x", "9007199254740993", "1e30"]
    assert one(spark, lambda c: V.to_whole(c, TEXT), *texts) == [2, 4, -2, None, 9007199254740993, None]
    assert one(spark, lambda c: V.to_whole(c, TEXT, "trunc"), "2.9", "-2.9") == [2, -2]


def test_title(spark):
    assert one(spark, V.title, "o'neil icu-a 3rd", "ÉCOLE x", None) == ["O'Neil Icu-A 3Rd", "École X", None]


def test_dates(spark):
    formats = ["yyyy-MM-dd", "d/M/yyyy", "MM-dd-yyyy"]
    texts = ["2026-03-05", " 5/3/2026", "05/03/2026", "03-07-1981", "2024-02-30", "2024-13-01", "2026", None]
    want = [date(2026, 3, 5)] * 3 + [date(1981, 3, 7)] + [None] * 4
    assert one(spark, lambda c: V.parse_date(c, formats), *texts) == want


def test_the_order_of_formats_decides_day_or_month_first(spark):
    assert one(spark, lambda c: V.parse_date(c, V.DAY_FIRST), "07-03-2026") == [date(2026, 3, 7)]
    assert one(spark, lambda c: V.parse_date(c, V.MONTH_FIRST), "07-03-2026") == [date(2026, 7, 3)]


def test_timestamps(spark):
    texts = ["2026-03-05 10:11:12", "2026-03-05T10:11:12+02:00", "2026/03/05 10:11", "2026-03-05 10:11"]
    got = one(spark, lambda c: F.date_format(V.parse_timestamp(c), "yyyy-MM-dd HH:mm:ss"), *texts)
    assert got == ["2026-03-05 10:11:12", "2026-03-05 08:11:12", "2026-03-05 10:11:00", "2026-03-05 10:11:00"]


def shown(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def test_epoch_threshold_of_the_operation(spark):
    cells = [1.7e9, 1.7e12, 1e11, 100000000001.0, -1.7e12, 1e14, None]
    got = one(spark, lambda c: shown(V.epoch(c)), *cells, type="double")
    assert got == [
        "2023-11-14 22:13:20",
        "2023-11-14 22:13:20",
        None,  # seconds beyond the clock's range
        "1973-03-03 09:46:40",
        "1916-02-18 01:46:40",
        None,
        None,
    ]


def test_epoch_threshold_of_the_feeds(spark):
    cells = [1e10, 10000000001.0, -1e12]
    got = one(spark, lambda c: shown(V.epoch(c, V.FEED_EPOCH)), *cells, type="double")
    assert got == ["2286-11-20 17:46:40", "1970-04-26 17:46:40", None]


def test_mixed_timestamp_limits_digit_strings(spark):
    texts = ["1700000000", "170000000", "2024-01-02", "soon"]
    day = lambda digits: lambda c: F.date_format(V.mixed_timestamp(c, digits=digits), "yyyy-MM-dd")
    assert one(spark, day(r"^\d{10,13}$"), *texts) == ["2023-11-14", None, "2024-01-02", None]
    assert one(spark, day(r"^\d+$"), *texts) == ["2023-11-14", "1975-05-22", "2024-01-02", None]


def test_mixed_timestamp_of_numbers_and_times(spark):
    long = one(spark, lambda c: shown(V.mixed_timestamp(c, dtype=T.LongType())), 1700000000123, type="bigint")
    assert long == ["2023-11-14 22:13:20"]
    at = datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, lambda c: V.mixed_timestamp(c, dtype=T.TimestampType()), at, type="timestamp") == [at]


def test_time_bucket_and_recent(spark):
    texts = ["2024-01-24 00:00:00", "2024-01-23 23:59:59", "2030-01-01 00:00:00"]
    parse = lambda c: c.cast("timestamp")
    assert one(spark, lambda c: V.recent(parse(c), "2024-01-31", 7), *texts) == [True, False, True]
    assert one(spark, lambda c: shown(V.time_bucket(parse(c), 10)), "2024-01-01 10:19:59") == ["2024-01-01 10:10:00"]


def test_feed_scalars(spark):
    assert one(spark, V.drug_name, " Aspirin  ", None) == ["aspirin", ""]
    assert one(spark, V.dosage, "100mg", "12.5 mg", "-3", "none", None) == [100.0, 12.5, 3.0, None, None]
    assert one(spark, V.bed_label, "Room 007", "Bed 12/3", "Bed", "000") == ["BED-7", "BED-12", "BED-UNKNOWN", "BED-0"]


def test_text_of_doubles_is_pythons(spark):
    cells = [7.0, 0.001, 1e16, 1.5e20, 1e-5, 12345678.9, -2.5, 0.0, 123456789012345.6, 1e22, 2.5e-7, float("inf")]
    assert one(spark, lambda c: V.as_text(c, T.DoubleType()), *cells, type="double") == [repr(c) for c in cells]
    assert one(spark, lambda c: V.as_text(c, T.BooleanType()), True, False, None, type="boolean") == ["True", "False", None]


def test_canonical_unifies_numbers_and_case(spark):
    same = ["7", " 7.0 ", "007", "+7", "7e0", "7.000"]
    assert set(one(spark, lambda c: V.canonical(c, TEXT), *same)) == {"7"}
    assert one(spark, lambda c: V.canonical(c, T.DoubleType()), 7.0, 0.1, -0.0, float("nan"), type="double") == ["7", "0.1", "0", None]
    assert one(spark, lambda c: V.canonical(c, T.LongType()), 7, type="bigint") == ["7"]
    assert one(spark, lambda c: V.canonical(c, T.DecimalType(10, 2)), __import__("decimal").Decimal("7.50"), type="decimal(10,2)") == ["7.5"]
    assert one(spark, lambda c: V.canonical(c, T.BooleanType()), True, type="boolean") == ["1"]
    assert one(spark, lambda c: V.canonical(c, TEXT), " ICU ", "0.10", "-0", "5d", "12345678901234567890123", None) == [
        "icu", "0.1", "0", "5d", "12345678901234567890123", None,
    ]


def test_canonical_as_text_tells_numbers_apart(spark):
    assert one(spark, lambda c: V.canonical(c, TEXT, "text"), "7", "7.0", " A", None) == ["7", "7.0", "a", ""]


def test_sort_text(spark):
    assert one(spark, lambda c: V.sort_text(c, TEXT), "7", "7.0", " B", None, "1e3") == ["7", "7.0", "b", "None", "1000.0"]
    assert one(spark, lambda c: V.sort_text(c, T.DoubleType()), 7.0, 7.5, None, type="double") == ["7.0", "7.5", "None"]


def test_numbers_have_no_limits_but_those_of_doubles(table):
    texts = ["1e250", "1e-250", "1e200", "9" * 400, "1" * 300, "7.", ".5", "5d", "1e", "-3E2"]
    got = column(table("s string", *[(t,) for t in texts]).select(V.try_num(F.col("s")).alias("n")), "n")
    assert got == [1e250, 1e-250, 1e200, None, float("1" * 300), 7.0, 0.5, None, None, -300.0]
    doses = ["9" * 120 + "mg", "9" * 400, "take 2.5 or 3", "none", None]
    got = column(table("s string", *[(t,) for t in doses]).select(V.dosage(F.col("s")).alias("n")), "n")
    assert got == [float("9" * 120), None, 2.5, None, None]


def test_equality_of_numbers_is_exact(table):
    def form(text):
        return table("s string", (text,)).select(V.canonical(F.col("s"), T.StringType()).alias("c")).first()["c"]

    forms = {t: form(t) for t in ("3e-20", "5e-30", "0", "123456789012345678901.5", "123456789012345678902", "1e400", "-0.0", "2e5", "0.1", "1.50e1")}
    assert len({forms[t] for t in ("3e-20", "5e-30", "0", "123456789012345678901.5", "123456789012345678902", "1e400")}) == 6
    assert forms["-0.0"] == "0" and forms["2e5"] == form("200000.00") == "200000" and forms["1.50e1"] == "15"
    assert forms["3e-20"] == form("0." + "0" * 19 + "30") == "3e-20"
    doubles = table("d double", (3e-20,), (5e-30,), (0.0,), (0.1,), (15.0,), (1e22,), (float("nan"),), (-2.5e-5,))
    got = column(doubles.select(V.canonical(F.col("d"), T.DoubleType()).alias("c")), "c")
    assert got == ["3e-20", "5e-30", "0", forms["0.1"], "15", "1" + "0" * 22, None, "-0.000025"]


def test_times_need_a_session_in_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for build in (lambda: V.parse_timestamp(F.lit("2024-01-01")), lambda: V.mixed_timestamp(F.lit("1706608800"))):
            with pytest.raises(SpecError, match="UTC"):
                build()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_common_decimals_take_the_same_text_as_any_notation(spark):
    from decimal import Decimal

    written = ["0.0", "-0.0", "-0.00", "-0", "0.", "5.", "-5.", "0.10", "-1.50", "100.00", "-100.05", "00.50", "+7.250", ".5", "-.50"]
    written += ["12345678901234567.12345678901234560", "12345678901234567.12345678901234567", "0.00000000000000001", "99999999999999999.0", "123456789012345678.50"]
    got = one(spark, lambda c: V.canonical(c, TEXT), *written)
    general = one(spark, lambda c: V.canonical(c, TEXT), *[f"{w}e0" for w in written])
    assert got == general
    plain = [format(Decimal(w), "f") for w in written]
    assert got == [(p.rstrip("0").rstrip(".") if "." in p else p).replace("-0", "0", p.strip("-0.") == "") for p in plain]
