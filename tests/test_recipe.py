import pytest
from pyspark.sql import functions as F

from checks.cleaning import BOOK_STEPS
from cleanframe.errors import SpecError
from cleanframe.operators import OPERATIONS, clean, clean_or_keep, clean_with_report, parse_operations

from .conftest import column, rows


def test_operations_are_read_from_lists_objects_and_aliases():
    one = {"operation": " Remove_Duplicates ", "columns": ["a"]}
    want = [("remove_duplicates", {"columns": ["a"]})]
    assert parse_operations(one) == parse_operations([one]) == parse_operations({"operations": [one]}) == want
    assert parse_operations({"name": "fix_dtypes", "dtypes": {"a": "int"}}) == [("fix_dtypes", {"columns": {"a": "int"}})]
    assert parse_operations({"operation": "coalesce_columns", "target": "t", "columns": ["a"]}) == [
        ("coalesce_columns", {"target_column": "t", "source_columns": ["a"]})
    ]
    assert parse_operations({"operation": "copy_column", "source_column": "a", "target_column": "b"})[0][1] == {
        "from_column": "a", "to_column": "b",
    }


@pytest.mark.parametrize("spec", [None, [], {}, ["x"], {"operations": []}, {"operation": "explode_all"}, {"operation": 7}])
def test_malformed_specs_are_refused(spec):
    with pytest.raises(SpecError):
        parse_operations(spec)


def test_there_are_eleven_operations():
    assert len(OPERATIONS) == 11


def test_a_wrong_step_anywhere_fails_before_any_job(spark, table):
    df = table("a string", ("x",))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("dry", "no job expected")
    steps = [
        {"operation": "fix_nulls", "strategy": "median", "columns": ["a"]},
        {"operation": "normalize_strings", "columns": ["gone"]},
    ]
    with pytest.raises(SpecError, match="gone"):
        clean(df, steps)
    assert not tracker.getJobIdsForGroup("dry")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(SpecError, match="unknown parameters"):
        clean(df, {"operation": "normalize_strings", "columns": ["a"], "colour": "red"})
    with pytest.raises(SpecError):
        clean(df, {"operation": "normalize_strings"})


def test_report_counts_rows_around_each_operation(table):
    df = table("k int, v string", (1, "a"), (1, "b"), (2, None), (3, "c"))
    out, report = clean_with_report(
        df,
        [
            {"operation": "fix_nulls", "strategy": "drop", "columns": ["v"]},
            {"operation": "remove_duplicates", "columns": ["k"]},
            {"operation": "normalize_strings", "columns": ["v"], "case": "upper"},
        ],
        order_by=["v"],
    )
    assert rows(out) == [(1, "A"), (3, "C")]
    assert report() == [
        {"operation": "fix_nulls", "rows_before": 4, "rows_after": 3},
        {"operation": "remove_duplicates", "rows_before": 3, "rows_after": 2},
        {"operation": "normalize_strings", "rows_before": 2, "rows_after": 2},
    ]


def test_report_counts_once_where_a_step_reads_its_input_several_times(spark):
    df = spark.range(400).select(
        "id",
        (F.col("id") % 10).alias("k"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("v"),
        F.when(F.col("id") % 5 != 0, F.lit("a")).alias("w"),
    )
    steps = [
        {"operation": "fix_nulls", "strategy": "mode", "columns": ["w"]},
        {"operation": "fix_nulls", "strategy": "mean", "columns": ["v"]},
        {"operation": "remove_outliers", "column": "v", "n_std": 1.5},
        {"operation": "fix_nulls", "strategy": "forward_fill", "columns": ["w"]},
        {"operation": "remove_duplicates", "columns": ["k"]},
    ]
    out, report = clean_with_report(df, steps, order_by=["id"])
    out.collect()
    want = [400] + [clean(df, steps[: i + 1], order_by=["id"]).count() for i in range(len(steps))]
    assert [(r["rows_before"], r["rows_after"]) for r in report()] == list(zip(want, want[1:]))


def test_a_wrong_spec_can_leave_the_table_as_it_was(table):
    df = table("a string", (" x",))
    kept, reason = clean_or_keep(df, [{"operation": "normalize_strings", "columns": ["a"]}, {"operation": "fly"}])
    assert kept is df and "fly" in reason
    cleaned, reason = clean_or_keep(df, {"operation": "normalize_strings", "columns": ["a"]})
    assert column(cleaned, "a") == ["x"] and reason is None


def test_a_failing_run_can_leave_the_table_as_it_was(table):
    df = table("a string, b string", ("x", None))
    kept, reason = clean_or_keep(df, {"operation": "fix_nulls", "strategy": "mode", "columns": ["b"]}, run=True)
    assert kept is df and "no mode" in reason
    cleaned, reason = clean_or_keep(df, {"operation": "fix_nulls", "strategy": "mode", "columns": ["a"]}, run=True)
    assert rows(cleaned) == [("x", None)] and reason is None


def test_defaults_reach_the_operations_that_take_them(table):
    df = table("k int, v string, at int", (1, "N/A", 2), (2, "x", 1), (3, "", 3))
    got = clean(df, {"operation": "fix_nulls", "strategy": "forward_fill", "columns": ["v"]}, ["at"], ["", "N/A"])
    assert sorted(column(got, "v")) == ["x", "x", "x"]


def test_a_list_of_all_kinds_of_steps(table):
    book = table(
        "nr int, buyer int, state string, web_price string, shop_price string, sent string, rush string",
        (1, 7, " o ", "10.0", None, "901929600000", "1-URGENT"),
        (2, 7, "", None, "20.0 EUR", "901929600000", "2-HIGH"),
        (3, 8, " f ", None, "12.5", "0", "none"),
        (4, 9, None, "11.0", "9", "86400000", "5-LOW"),
        (5, 9, " p ", "9999", None, "86400000", "5-LOW"),
        (6, 9, " p ", "12", None, "86400000", "5-LOW"),
    )
    got = clean(book, BOOK_STEPS).select("nr", "state", "price", "sent", "level", "late", "month", "label")
    assert rows(got) == [
        (1, "Open", 10.0, "1998-08-01", "1", "yes", "1998-08-01", "7 1 Open"),
        (3, "Filled", 12.5, "1970-01-01", "UNKNOWN", "no", "1970-01-01", "8 UNKNOWN Filled"),
        (4, "Filled", 11.0, "1972-09-27", "5", "no", "1972-09-27", "9 5 Filled"),
        (6, "Split", 12.0, "1972-09-27", "5", "no", "1972-09-27", "9 5 Split"),
    ]
    assert {s["operation"] for s in BOOK_STEPS} == set(OPERATIONS)


def test_stages_give_the_same_and_read_the_source_once(spark, table, tmp_path):
    table("k int, a string, b double", *[(i, None if i % 4 == 0 else str(i), float(i % 50) if i % 3 else None) for i in range(200)]).write.parquet(str(tmp_path / "t"))
    steps = [
        {"operation": "fix_nulls", "strategy": "median", "columns": ["a"]},
        {"operation": "remove_outliers", "column": "b", "n_std": 1.2},
        {"operation": "fix_nulls", "strategy": "mean", "columns": ["b"]},
        {"operation": "fix_nulls", "strategy": "forward_fill", "columns": ["a"], "order_by": ["k"]},
        {"operation": "remove_duplicates", "columns": ["a"], "order_by": ["k"]},
    ]
    source = spark.read.parquet(str(tmp_path / "t"))
    staged = clean(source, steps, staged=True)
    assert rows(staged) == rows(clean(source, steps))
    assert str(tmp_path / "t") not in staged._jdf.queryExecution().analyzed().toString()
    assert not [f for f in staged.inputFiles() if f"{tmp_path}/t/" in f]
    with pytest.raises(SpecError):
        clean(source, [*steps, {"operation": "nothing"}], staged=True)
