import pytest

from cleanframe.errors import SpecError
from cleanframe.plans.conform import Feed, conform_feeds
from cleanframe.plans.reports import capacity_report
from cleanframe.streaming import capacity_stream, clean_stream, conform_stream, first_arrivals, late_rows, windowed_counts

from .conftest import rows


def drain(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination(60)
        return rows(spark.table(name))
    finally:
        query.stop()
        spark.catalog.dropTempView(name)


def test_row_local_operations_give_the_same_on_a_stream(spark, table, tmp_path):
    table("a string, at string", (" x", "1700000000"), ("N/A", "2024-01-01"), ("Y ", "soon")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a string, at string").parquet(str(tmp_path / "in"))
    spec = [
        {"operation": "fix_nulls", "strategy": "drop", "columns": ["a"]},
        {"operation": "normalize_strings", "columns": ["a"], "case": "upper"},
        {"operation": "fix_unix_ms", "column": "at"},
        {"operation": "derive_column", "target_column": "t", "rule": "template", "template": "{a}/{at}"},
    ]
    got = drain(spark, clean_stream(stream, spec, null_like=["N/A"]), "cleaned")
    assert got == [("X", "2023-11-14", "X/2023-11-14"), ("Y", None, "Y/")]


def test_whole_table_operations_are_refused(spark, tmp_path):
    stream = spark.readStream.schema("a string").parquet(str(tmp_path))
    for step in (
        {"operation": "remove_duplicates", "columns": ["a"]},
        {"operation": "fix_nulls", "strategy": "mean", "columns": ["a"]},
        {"operation": "remove_outliers", "column": "a"},
    ):
        with pytest.raises(SpecError, match="stream"):
            clean_stream(stream, step)


def test_first_arrivals(spark, tmp_path):
    df = spark.sql("select 1 as k, timestamp'2024-01-01 00:00:00' as at union all select 1, timestamp'2024-01-01 00:01:00' union all select 2, timestamp'2024-01-01 00:02:00'")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = drain(spark, first_arrivals(stream, ["k"], "at", "10 minutes").select("k"), "arrived")
    assert got == [(1,), (2,)]


A, B = "id string, unit string, bed string, at string", "pid string, code string, room string, at string"
CODES = {"MICU": "ICU_MEDICAL", "SICU": "ICU_SURGICAL"}
DAY = "2024-03-01"


def feeds(a, b):
    return [
        Feed("a", a, "A", "id", "unit", "bed", "at", "id"),
        Feed("b", b, "B", "pid", "code", "room", "at", "pid", CODES),
    ]


def arrive(spark, folder, schema, *rows):
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(df, out):
    """All that has arrived since, one file at a time."""
    writer = df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def streams(spark, tmp_path):
    made = []
    for name, schema in (("a", A), ("b", B)):
        (tmp_path / name).mkdir(exist_ok=True)
        made.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    return feeds(*made)


def deliver(spark, tmp_path, step):
    """The second feed comes first; rows of a bucket come out of order and over several runs."""
    a, b = tmp_path / "a", tmp_path / "b"
    if step == 0:
        arrive(spark, b, B, ("b1", "MICU", "Bed 3", "2024-03-01 10:04:00"), ("b2", "SICU", "Bed 5", "2024-03-01 10:12:00"), ("b3", "none", "Bed 5", "2024-03-01 10:12:00"))
        arrive(spark, b, B, ("b4", "MICU", "Bed 3", "2024-03-01 10:21:00"), ("b5", "MICU", "Bed 4", "2024-02-01 10:21:00"))
    if step == 1:
        arrive(spark, a, A, ("a1", "ICU_MEDICAL", "Bed 3", "2024-03-01 10:08:00"), ("a0", "ICU_MEDICAL", "Bed 3", "2024-03-01 10:02:00"))
        arrive(spark, a, A, ("a2", "ICU_SURGICAL", "Bed 6", "2024-03-01 10:11:00"), ("a3", "ICU_MEDICAL", "Bed 9", None))
    if step == 2:  # lets all windows end
        for hour in (0, 6):
            arrive(spark, a, A, (f"end{hour}", "ICU_NEURO", "Bed 1", f"2030-01-01 0{hour}:00:00"))


def batch(spark, tmp_path):
    return feeds(spark.read.schema(A).parquet(str(tmp_path / "a")).filter("id not like 'end%'"), spark.read.schema(B).parquet(str(tmp_path / "b")))


def test_the_earlier_feed_wins_on_a_stream_although_it_comes_later(spark, tmp_path):
    for step in range(3):
        deliver(spark, tmp_path, step)
        run(conform_stream(streams(spark, tmp_path), DAY, "40 days", minutes=10), tmp_path / "out")  # each run restarts from the checkpoint
    got = spark.read.parquet(str(tmp_path / "out" / "rows"))
    want = conform_feeds(batch(spark, tmp_path), DAY)
    assert rows(got.filter("source_record_id not like 'end%'")) == rows(want)
    assert {r["source_record_id"] for r in want.collect()} == {"a0", "b2", "b4", "b5", "a2"}
    assert got.columns == want.columns


def test_capacity_per_window_is_that_of_the_batch(spark, table, tmp_path):
    beds = table("unit string, bed string", *[("ICU_MEDICAL", str(i)) for i in range(4)], ("ICU_NEURO", "1"))
    for step in range(3):
        deliver(spark, tmp_path, step)
        query = run(capacity_stream(streams(spark, tmp_path), beds, DAY, "40 days", "1 day"), tmp_path / "out")
        assert late_rows(query) == 0
    got = spark.read.parquet(str(tmp_path / "out" / "rows"))
    conformed = conform_feeds(batch(spark, tmp_path), DAY)
    for day, n in (("2024-03-01", 2), ("2024-02-01", 1)):
        want = capacity_report(conformed.filter(f"date(admitted_at) = '{day}'"), beds, "full").filter("current_occupancy > 0")
        assert rows(got.filter(f"date(window_start) = '{day}'").drop("window_start")) == rows(want) and want.count() == n


def test_windowed_counts_and_late_rows(spark, tmp_path):
    schema = "ward string, at timestamp"
    at = lambda *pairs: spark.createDataFrame([(w, t) for w, t in pairs], "ward string, at string").selectExpr("ward", "cast(at as timestamp) as at")
    files = [
        at((" icu", "2024-01-01 10:05:00"), ("ICU ", "2024-01-01 10:50:00"), (None, "2024-01-01 10:00:00")),
        at(("er", "2024-01-01 12:30:00"), ("Icu", "2024-01-01 10:59:59")),
        at(("er", "2024-01-01 15:00:00")),
        at(("icu", "2024-01-01 10:01:00"), ("er", "2024-01-01 15:10:00")),  # the first is too late
    ]
    seen = 0
    for df in files:
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        seen += late_rows(run(windowed_counts(stream, "ward", "at", "1 hour", "1 hour"), tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out" / "rows")).selectExpr("hour(window_start) AS hour", "ward", "rows")
    assert rows(got) == [(10, "ICU", 3), (10, None, 1), (12, "ER", 1)] and seen == 1
