from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F

from cleanframe.errors import SpecError
from cleanframe.operators import (
    coalesce_columns,
    copy_column,
    derive_column,
    exact_median,
    first_per_key,
    fix_dtypes,
    fix_nulls,
    fix_unix_ms,
    forward_fill,
    map_values,
    normalize_strings,
    remove_duplicates,
    remove_outliers,
    rename_columns,
    running_sum,
)

from .conftest import column, rows

NULL_LIKE = ["", "N/A", "n/a"]


# -- duplicates -------------------------------------------------------------


def test_first_row_per_key_stays_and_null_keys_are_equal(table):
    df = table("k string, v int, at int", ("a", 1, 2), ("a", 2, 1), (None, 3, 1), (None, 4, 2), ("b", 5, 1))
    assert rows(remove_duplicates(df, ["k"], ["at"]).drop("at")) == [("a", 2), ("b", 5), (None, 3)]
    assert rows(first_per_key(df, ["k"], ["at"], keep="last").drop("at")) == [("a", 1), ("b", 5), (None, 4)]


def test_first_row_keeps_its_null_cells(table):
    df = table("k int, v string, at int", (1, None, 1), (1, "x", 2))
    assert rows(remove_duplicates(df, ["k"], ["at"])) == [(1, None, 1)]


def test_ties_do_not_depend_on_partitioning(spark):
    df = spark.range(200).select((F.col("id") % 5).alias("k"), F.lit(1).alias("at"), F.col("id").alias("v"))
    a = rows(remove_duplicates(df.repartition(1), ["k"], ["at"]))
    b = rows(remove_duplicates(df.orderBy(F.rand(3)).repartition(7), ["k"], ["at"]))
    assert a == b and len(a) == 5


def test_a_hot_key_is_cut_down_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    plan = remove_duplicates(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("row_number(), 1, Partial")
    assert plan.index("Exchange") < partial  # printed root first: the limit runs below the exchange


def test_duplicates_need_columns_and_order(table):
    df = table("k int, v int", (1, 1))
    for keys, order in (([], ["v"]), (["k"], []), (["x"], ["v"]), (["k"], ["x"])):
        with pytest.raises(SpecError):
            remove_duplicates(df, keys, order)


# -- nulls ------------------------------------------------------------------


def test_drop(table):
    df = table("a string, b int", ("x", 1), ("N/A", 2), ("", 3), (None, 4), ("y", None))
    assert rows(fix_nulls(df, "drop", ["a"])) == [("", 3), ("N/A", 2), ("x", 1), ("y", None)]
    assert rows(fix_nulls(df, "drop", null_like=NULL_LIKE)) == [("x", 1)]


def test_nan_is_missing(table):
    df = table("at int, v double", (1, 1.0), (2, float("nan")), (3, None), (4, 4.0))
    assert rows(fix_nulls(df, "drop", ["v"])) == [(1, 1.0), (4, 4.0)]
    assert rows(fix_nulls(df, "mean", ["v"])) == [(1, 1.0), (2, 2.5), (3, 2.5), (4, 4.0)]
    assert rows(fix_nulls(df, "forward_fill", ["v"], order_by=["at"])) == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 4.0)]
    assert rows(fix_nulls(df, "mode", ["v"])) == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 4.0)]


def test_mean_reads_text_and_replaces_other_text(table):
    df = table("a string", ("1",), ("2",), (None,), ("x",))
    assert sorted(column(fix_nulls(df, "mean", ["a"]), "a")) == [1.0, 1.5, 1.5, 2.0]


def test_mean_and_median_of_nothing_fail_when_run(table):
    df = table("a string", ("x",), (None,))
    for strategy in ("mean", "median", "mode"):
        with pytest.raises(Exception, match="cannot fill column"):
            fix_nulls(table("a string", (None,)) if strategy == "mode" else df, strategy, ["a"]).collect()


def test_mode_takes_the_smallest_of_ties_in_native_order(table):
    df = table("a int, b string", (10, "x"), (9, "y"), (9, "y"), (10, "x"), (None, None))
    assert (9, "x") in rows(fix_nulls(df, "mode", ["a", "b"]))


def test_mode_of_one_column(table):
    df = table("a string", ("q",), ("p",), ("p",), (None,), ("N/A",))
    assert sorted(column(fix_nulls(df, "mode", ["a"], NULL_LIKE), "a")) == ["p"] * 4 + ["q"]


@pytest.mark.parametrize("cells", [[1], [1, 2], [3, 1, 2], [5, 5, 5, 1], list(range(100, 0, -1)), [0.5, None, 2.5, 9.0]])
def test_exact_median(spark, cells):
    import statistics

    df = spark.createDataFrame([(None if c is None else float(c),) for c in cells], "v double")
    got = df.limit(1).select(exact_median(df, "v").alias("m")).first()["m"]
    assert got == statistics.median([c for c in cells if c is not None])


def test_exact_median_of_many_ranges_and_hot_values(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("v"))
    want = df.select(F.median("v")).first()[0]
    assert df.limit(1).select(exact_median(df, "v").alias("m")).first()["m"] == want


def test_median_fill(table):
    df = table("a string", ("1",), ("10",), ("2",), (None,))
    assert sorted(column(fix_nulls(df, "median", ["a"]), "a")) == [1.0, 2.0, 2.0, 10.0]


def test_unknown_strategy_and_column(table):
    df = table("a int", (1,))
    with pytest.raises(SpecError):
        fix_nulls(df, "median_of_medians")
    with pytest.raises(SpecError):
        fix_nulls(df, "drop", ["z"])
    with pytest.raises(SpecError):
        fix_nulls(df, "forward_fill", ["a"])


# -- ordered operators ------------------------------------------------------


def holed(spark, n=2000):
    """A third of the rows share one group; some order keys are equal."""
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        (F.xxhash64("id") % 300).alias("at"),
        F.when(F.xxhash64("id", F.lit(1)) % 4 == 0, F.col("id")).alias("v"),
    )


def test_forward_fill_without_groups_equals_one_window(spark):
    df = holed(spark)
    w = Window.orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("v", F.last("v", ignorenulls=True).over(w))
    for ranges in (None, 3, 100):
        got = forward_fill(df.repartition(5), ["v"], ["at", "id"], ranges=ranges)
        assert rows(got, "id") == rows(want, "id")


def test_forward_fill_cuts_hot_groups(spark):
    df = holed(spark)
    w = Window.partitionBy("g").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("v", F.last("v", ignorenulls=True).over(w))
    for group_rows in (10, 100, 10**6):
        got = forward_fill(df.repartition(5), ["v"], ["at", "id"], ["g"], group_rows=group_rows)
        assert rows(got, "id") == rows(want, "id")


def test_forward_fill_carries_over_ranges_without_any_value(spark):
    df = spark.range(1, 301).select("id", F.when(F.col("id").isin(5, 120), F.col("id")).alias("v"))
    got = rows(forward_fill(df.repartition(4), ["v"], ["id"]), "id")
    assert got == [(i, 120 if i >= 120 else 5 if i >= 5 else None) for i in range(1, 301)]
    hot = forward_fill(df.withColumn("g", F.lit("g")), ["v"], ["id"], ["g"], group_rows=10).drop("g")
    assert rows(hot, "id") == got


def test_forward_fill_keeps_leading_nulls_and_null_groups(table):
    df = table("g string, at int, v string", (None, 1, None), (None, 2, "a"), (None, 3, None), ("x", 1, None), ("x", 2, "b"))
    got = forward_fill(df, ["v"], ["at"], ["g"])
    assert rows(got) == [("x", 1, None), ("x", 2, "b"), (None, 1, None), (None, 2, "a"), (None, 3, "a")]
    got = forward_fill(df, ["v"], ["at"], ["g"], group_rows=0)
    assert rows(got) == [("x", 1, None), ("x", 2, "b"), (None, 1, None), (None, 2, "a"), (None, 3, "a")]


def test_forward_fill_of_several_columns_and_text_order(table):
    df = table("at string, a int, b string", ("c", None, "z"), ("a", 1, None), ("b", None, "y"), ("d", 2, None))
    assert rows(forward_fill(df, ["a", "b"], ["at"]), "at") == [("a", 1, None), ("b", 1, "y"), ("c", 1, "z"), ("d", 2, "z")]


def test_running_sum_equals_one_window(spark):
    df = holed(spark).withColumn("w", F.col("id") % 7)
    for partition_by in ([], ["g"]):
        w = Window.partitionBy(*partition_by).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
        want = df.withColumn("running_sum", F.sum("w").over(w))
        got = running_sum(df.repartition(3), "w", ["at", "id"], partition_by, group_rows=50)
        assert rows(got, "id") == rows(want, "id")


# -- outliers ---------------------------------------------------------------


def test_outliers_keep_nulls_and_text(table):
    df = table("v string", *[("1",)] * 20, ("100",), (None,), ("x",))
    assert sorted(map(str, column(remove_outliers(df, "v"), "v"))) == ["1"] * 20 + ["None", "x"]


def test_outlier_bounds_are_inclusive_and_population(table):
    df = table("v double", (0.0,), (2.0,))
    assert remove_outliers(df, "v", 1).count() == 2
    assert remove_outliers(df, "v", 0.99).count() == 0


def test_equal_values_have_no_outliers(table):
    assert remove_outliers(table("v double", *[(0.1,)] * 7), "v", 0.1).count() == 7
    df = table("g int, v double", *[(1, 0.1)] * 7, (2, 5.0))
    assert remove_outliers(df, "v", 0.1, ["g"]).count() == 8


def test_outliers_per_group(table):
    cells = [("a", 1.0)] * 20 + [("a", 50.0)] + [(None, 50.0)] * 20 + [(None, 1.0)] + [("n", None)]
    got = remove_outliers(table("g string, v double", *cells), "v", 3, partition_by=["g"])
    assert rows(got.groupBy("g", "v").count()) == [("a", 1.0, 20), ("n", None, 1), (None, 50.0, 20)]


def test_outliers_of_hot_groups_meet_their_bounds_everywhere(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 40).alias("g"), (F.xxhash64("id") % 1000).alias("v"), "id"
    )
    want = rows(remove_outliers(df, "v", 1, ["g"]), "id")
    assert 0 < len(want) < 3000
    for group_rows in (0, 60, 500):
        assert rows(remove_outliers(df.repartition(5), "v", 1, ["g"], group_rows=group_rows), "id") == want


def test_outliers_refuse_bad_parameters(table):
    df = table("v string", ("x",))
    for n in (0, -1, "many", None):
        with pytest.raises(SpecError):
            remove_outliers(df, "v", n)
    with pytest.raises(Exception, match="no numeric values"):
        remove_outliers(df, "v").collect()


# -- types ------------------------------------------------------------------


def test_fix_dtypes(table):
    df = table("a string, b string, c string, d int", ("1.5", "2.5", "2026-03-05", 7), ("x", "81mg", "5/3/2026", None))
    got = fix_dtypes(
        df, {"a": "float", "b": "int", "c": "date", "d": "string"}, formats={"c": ["yyyy-MM-dd", "d/M/yyyy"]}
    )
    assert dict(got.dtypes) == {"a": "double", "b": "bigint", "c": "date", "d": "string"}
    assert rows(got, "a") == [(None, None, date(2026, 3, 5), None), (1.5, 2, date(2026, 3, 5), "7")]


def test_fix_dtypes_can_keep_unreadable_cells(table):
    df = table("a string, b string, c string", ("2.9", "1e2", "2026-03-05"), ("x", "y", "z"))
    got = fix_dtypes(df, {"a": "int", "b": "float", "c": "date"}, on_error="keep", int_mode="trunc")
    assert rows(got) == [("2", "100.0", "2026-03-05"), ("x", "y", "z")]


def test_fix_dtypes_renders_dates_and_never_reads_bare_numbers_as_dates(table):
    df = table("a string, b int", ("2026-03-05", 20260305))
    got = fix_dtypes(df, {"a": "date", "b": "date"}, as_string=True)
    assert rows(got) == [("2026-03-05", None)]


def test_fix_dtypes_refuses(table):
    df = table("a string", ("1",))
    for spec, how in (({}, {}), ({"a": "uuid"}, {}), ({"z": "int"}, {}), ({"a": "int"}, {"int_mode": "up"}), ({"a": "int"}, {"on_error": "raise"})):
        with pytest.raises(SpecError):
            fix_dtypes(df, spec, **how)


def test_normalize_strings(table):
    df = table("a string, n int", ("\t o'NEIL  ", 5), (None, None))
    assert rows(normalize_strings(df, ["a", "n"], "title")) == [("O'Neil", "5"), (None, None)]
    assert column(normalize_strings(df, ["a"], " UPPER "), "a")[0] == "O'NEIL"
    with pytest.raises(SpecError):
        normalize_strings(df, ["a"], "camel")


def test_fix_unix_ms(table):
    df = table("a string", ("1700000000",), (" 1700000000123",), ("2026-03-05",), ("N/A",), (None,))
    assert sorted(map(str, column(fix_unix_ms(df, "a"), "a"))) == ["2023-11-14", "2023-11-14", "2026-03-05", "None", "None"]
    kept = column(fix_unix_ms(df, ["a"], "datetime", on_error="keep"), "a")
    assert sorted(map(str, kept)) == ["2023-11-14 22:13:20", "2023-11-14 22:13:20", "2026-03-05 00:00:00", "N/A", "None"]
    typed = fix_unix_ms(table("a bigint", (1700000000123,)), "a", "datetime", as_string=False)
    assert typed.dtypes == [("a", "timestamp")]


# -- columns ----------------------------------------------------------------


def test_rename_merges_into_an_existing_column(table):
    df = table("a string, b string, c int", ("x", None, 1), ("y", "z", 2), ("w", "N/A", 3))
    assert rows(rename_columns(df, {"a": "b", "gone": "c"})) == [("N/A", 3), ("x", 1), ("z", 2)]
    assert rows(rename_columns(df, {"a": "b"}, NULL_LIKE)) == [("w", 3), ("x", 1), ("z", 2)]
    assert rename_columns(df, {"a": "d", "d": "e"}).columns == ["e", "b", "c"]


def test_rename_of_mixed_types_makes_text(table):
    got = rename_columns(table("a int, b string", (1, None), (2, "u")), {"b": "a"})
    assert rows(got) == [("1",), ("2",)]


@pytest.mark.parametrize("size", [1, 500])
def test_map_values(table, size):
    more = {f"k{i}": str(i) for i in range(size)}
    df = table("a string", ("x",), ("y",), ("z",), (None,))
    mapping = {"x": "1", "y": None, **more}
    assert sorted(map(str, column(map_values(df, "a", mapping), "a"))) == ["1", "None", "None", "z"]
    assert sorted(map(str, column(map_values(df, "a", mapping, default="?"), "a"))) == ["1", "?", "?", "None"]


def test_map_values_looks_up_the_text_form(table):
    df = table("a double", (1.0,), (2.5,))
    assert column(map_values(df, "a", {"1.0": "one"}), "a") == ["one", "2.5"]
    assert column(map_values(table("a int", (1,), (2,)), "a", {1: 10}), "a") == [10, 2]


def test_coalesce_columns(table):
    df = table("a string, b string", ("", "x"), (None, None), ("y", "z"))
    assert column(coalesce_columns(df, "c", ["a", "b"]), "c") == ["", None, "y"]
    got = coalesce_columns(df, "a", ["a", "b"], fill_value="-", drop_sources=True, null_like=NULL_LIKE)
    assert got.columns == ["a"] and column(got, "a") == ["x", "-", "y"]
    with pytest.raises(SpecError):
        coalesce_columns(df, "c", ["a", "nope"])


def test_copy_column(table):
    df = table("a string, b string", ("x", None), ("y", "z"))
    assert column(copy_column(df, "a", "b"), "b") == ["x", "y"]
    assert column(copy_column(df, "a", "b", overwrite=False), "b") == ["x", "z"]
    assert column(copy_column(df, "a", "c", overwrite=False), "c") == ["x", "y"]


def test_derive_constant_and_from_column(table):
    df = table("a string", ("x",))
    assert column(derive_column(df, "b", value=3), "b") == [3]
    assert column(derive_column(df, "b", "from_column", source_column="a"), "b") == ["x"]


def test_derive_if_equals(table):
    df = table("a string, n int", ("x", 1), (None, None))
    how = {"then": "yes", "else": "no"}
    assert column(derive_column(df, "b", "if_equals", column="a", equals="x", **how), "b") == ["yes", "no"]
    assert column(derive_column(df, "b", "if_equals", column="a", equals=None, **how), "b") == ["no", "yes"]
    assert column(derive_column(df, "b", "if_equals", column="n", equals="1", **how), "b") == ["no", "no"]
    assert column(derive_column(df, "b", "if_equals", column="a", equals=5, **how), "b") == ["no", "no"]
    assert column(derive_column(df, "b", "if_equals", column="n", equals=1.0, **how), "b") == ["yes", "no"]


def test_derive_template(table):
    df = table("a string, d double", ("x", 2.0), (None, None), ("N/A", 1e16))
    got = column(derive_column(df, "t", "template", template="{{{a}}}/{d}{gone}!", null_like=NULL_LIKE), "t")
    assert got == ["{x}/2.0!", "{}/!", "{}/1e+16!"]
    for bad in ("{a:>5}", "{a!r}", "{a.b}", "{a[0]}", "{}", "{0}", "{a"):
        with pytest.raises(SpecError):
            derive_column(df, "t", "template", template=bad)


def test_derive_digits(table):
    df = table("a string", ("Room 007b8",), ("none",), (None,))
    assert column(derive_column(df, "d", "extract_digits", column="a"), "d") == ["007", "UNKNOWN", "UNKNOWN"]
    assert column(derive_column(df, "d", "extract_digits", column="a", digits="all", fallback="-"), "d") == ["0078", "-", "-"]


def test_derive_within_days(table):
    df = table("a string", ("2026-03-28",), ("2026-03-27 23:59:59",), ("2030-01-01",), ("x",), (None,))
    how = dict(column="a", reference_date="2026-04-04", days=7, then="active")
    got = column(derive_column(df, "s", "date_within_days", **how, **{"else": "inactive"}), "s")
    assert got == ["active", "inactive", "active", "inactive", "inactive"]
    for bad in ({"reference_date": "someday"}, {"days": "week"}, {"column": "z"}):
        with pytest.raises(SpecError):
            derive_column(df, "s", "date_within_days", **{**how, **bad})


def test_derive_refuses_unknown_rules(table):
    with pytest.raises(SpecError):
        derive_column(table("a int", (1,)), "b", "guess", column="a")


# -- properties -------------------------------------------------------------


@pytest.mark.parametrize(
    "op",
    [
        lambda d: remove_duplicates(d, ["a"], ["b"]),
        lambda d: fix_dtypes(d, {"b": "float"}),
        lambda d: normalize_strings(d, ["a"], "upper"),
        lambda d: fix_unix_ms(d, "b", "datetime"),
    ],
)
def test_cleaning_twice_changes_nothing(spark, op):
    df = spark.range(60).select(
        F.concat(F.lit(" k"), (F.col("id") % 7).cast("string")).alias("a"), (F.col("id") * 1000003).cast("string").alias("b")
    )
    assert rows(op(op(df))) == rows(op(df))


def test_mappings_find_values_and_texts(table):
    doubles = table("d double", (1.0,), (2.5,), (None,), (float("nan"),))
    assert column(map_values(doubles, "d", {1: "one", "2.5": "half"}, default="?"), "d") == ["one", "half", "?", "?"]
    texts = table("s string", ("1",), ("2",), ("True",))
    many = {i: f"n{i}" for i in range(200)}
    for more in ({}, many):
        assert column(map_values(texts, "s", {**more, 1: "number", "1": "text", True: "yes"}), "s")[0] == "text"
        assert map_values(texts, "s", {**more, 1: "number", "1": "text"}).count() == 3
    assert column(map_values(table("d decimal(5,2)", (Decimal(1),), (Decimal(2),)), "d", {1: "one"}), "d") == ["one", "2.00"]


def test_nan_is_missing(table):
    nan = float("nan")
    df = table("a double, b double", (nan, 1.0), (2.0, 3.0), (None, nan))
    assert column(coalesce_columns(df, "c", ["a", "b"]), "c") == [1.0, 2.0, None]
    assert column(copy_column(df, "b", "a", overwrite=False), "a") == [1.0, 2.0, None]
    assert column(rename_columns(df, {"b": "a"}), "a") == [1.0, 2.0, None]
    from cleanframe.plans.quality import profile

    assert {r["column_name"]: r["null_count"] for r in profile(df).collect()} == {"a": 2, "b": 1}


def test_stored_sketches_merge_to_the_median(spark, tmp_path):
    from cleanframe.operators.nulls import median_sketches, merged_medians

    df = spark.range(10_001).selectExpr("CAST(id AS double) AS x", "IF(id % 3 = 0, NULL, id * 2) AS y", "id % 7 AS part", "CAST(NULL AS double) AS z")
    median_sketches(df, ["x", "y", "z"], by=["part"]).write.parquet(str(tmp_path / "s"))
    merged = merged_medians(spark.read.parquet(str(tmp_path / "s")), ["x", "y", "z"])
    got = spark.range(1).select(*[c.alias(n) for n, c in merged.items()]).first()
    assert abs(got.x - 5000) < 100 and abs(got.y - 10_000) < 200 and got.z is None
