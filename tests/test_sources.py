import json
import os

import pytest
from pyspark.sql import functions as F

from cleanframe import sources as S
from cleanframe.sources import current_version, read_table, replace_table, tables, upsert_partitions
from cleanframe.errors import SpecError

from .conftest import rows


def test_read_table_by_path_and_name(spark, table, tmp_path):
    path = str(tmp_path / "t")
    table("a int, b string", (1, "x")).write.parquet(path)
    assert rows(S.read_table(spark, path, ["b"])) == [("x",)]
    scan = S.read_table(spark, path, ["b"]).filter("b = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:string>" in scan and "EqualTo(b,x)" in scan
    table("a int", (5,)).createOrReplaceTempView("named")
    assert rows(S.read_table(spark, "named")) == [(5,)]
    spark.catalog.dropTempView("named")


def test_read_table_of_other_formats(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a;b\n1;x\n")
    got = S.read_table(spark, str(path), format="csv", schema="a int, b string", sep=";", header=True)
    assert rows(got) == [(1, "x")]


def test_read_jdbc_insists_on_parallel_ranges(spark):
    with pytest.raises(SpecError):
        S.read_jdbc(spark, "jdbc:x", "t")
    with pytest.raises(SpecError):
        S.read_jdbc(spark, "jdbc:x", "t", partition_column="id")


def test_from_rows_turns_mixed_cells_into_text(spark):
    got = S.from_rows(spark, [{"age": 5}, {"age": "N/A"}, {"age": 2.5}, {}], "age string")
    assert rows(got) == [("2.5",), ("5",), ("N/A",), (None,)]
    assert S.from_rows(spark, got, "age string") is got


def test_json_rows(table):
    df = table("task string, body string", ("t", json.dumps([{"a": 1, "b": "x"}, {"a": None}])), ("u", "[]"))
    assert rows(S.json_rows(df, "body", "a int, b string")) == [("t", 1, "x"), ("t", None, None)]


def test_variants(spark, table, tmp_path):
    root = str(tmp_path)
    for variant, value in (("messy", " x"), ("clean", "x")):
        table("a string", (value,)).write.parquet(f"{root}/{variant}/patients")
    assert rows(S.load_variant(spark, root, "patients", "clean")) == [("x",)]
    live = f"{root}/live/patients"
    S.load_variant(spark, root, "patients", "messy", live)
    assert rows(S.load_variant(spark, root, "patients", "clean", live)) == [("x",)]


def test_overwrite_and_snapshot(spark, table, tmp_path):
    path, kept = str(tmp_path / "t"), str(tmp_path / "kept")
    first = S.overwrite(table("a int", (1,)), path)
    assert rows(S.snapshot_once(first, kept)) == [(1,)]
    S.overwrite(table("a int", (2,)), path)
    assert rows(S.snapshot_once(spark.read.parquet(path), kept)) == [(1,)]
    with pytest.raises(SpecError, match="another path"):
        S.overwrite(spark.read.parquet(path).withColumn("a", F.lit(3)), path)


def test_upsert(table):
    target = table("id int, v string", (1, "a"), (2, "b"), (None, "n"))
    changes = table("id int, v string, nr int", (2, "old", 1), (2, "new", 2), (3, "c", 1), (None, "m", 1))
    assert rows(S.upsert(target, changes, "id", order_by=["nr"])) == [(1, "a"), (2, "new"), (3, "c"), (None, "m")]


def test_upsert_stamps_changed_rows(table):
    target = table("id int, v string, at timestamp", (1, "a", None))
    got = S.upsert(target, table("id int, v string", (2, "b")), ["id"], stamp="at")
    assert [(r.id, r.at is None) for r in sorted(got.collect())] == [(1, True), (2, False)]


def test_write_upsert_goes_to_a_new_path(spark, table, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    table("id int, v string", (1, "a"), (2, "b")).write.parquet(old)
    got = S.write_upsert(old, table("id int, v string", (2, "c")), "id", new)
    assert rows(got) == [(1, "a"), (2, "c")]
    assert rows(spark.read.parquet(old)) == [(1, "a"), (2, "b")]
    with pytest.raises(SpecError):
        S.write_upsert(old, got, "id", old)


def test_materialize_writes_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    got = S.materialize(spark.range(5).withColumn("s", F.struct("id")))
    assert got.count() == 5 and len(set(os.listdir(folder)) - before) == 1
    assert got.columns == ["id", "s"]


def test_a_shared_folder_set_on_the_context_is_used_where_the_setting_is_absent(spark, tmp_path):
    class Context:
        master, applicationId = "spark://host:1", "app"

        def __init__(self, folder):
            self.getCheckpointDir = lambda: folder

    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return default

        def __init__(self, folder):
            self.sparkContext = Context(folder)

    from cleanframe.sources.tables import shared_folder

    assert shared_folder(Session("hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(SpecError, match="spark.checkpoint.dir"):
        shared_folder(Session(None))


def test_a_table_its_plan_reads_is_never_replaced(spark, tmp_path):
    base = f"{tmp_path}/kept"
    spark.range(10).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(base)
    df = spark.read.parquet(base)
    for path in (base, f"file://{base}", f"file:{base}/", str(tmp_path), f"{base}/k=1", os.path.relpath(base)):
        with pytest.raises(SpecError, match="another path"):
            S.overwrite(df, path)
        with pytest.raises(SpecError, match="another path"):
            S.write_upsert(base, spark.createDataFrame([(1, 1)], "id long, k int"), "id", path)
    assert spark.read.parquet(base).count() == 10
    other = S.overwrite(df.filter("id < 4"), f"{base}-b", partition_by=["k"])
    assert other.count() == 4
    assert S.overwrite(spark.range(3).selectExpr("id", "0 AS k"), f"{base}-b").count() == 3
    assert sorted(os.listdir(tmp_path)) == ["kept", "kept-b"]


def test_upserts_need_an_order_for_repeated_keys(table):
    target = table("id int, v string", (1, "a"))
    with pytest.raises(Exception, match="several changes"):
        S.upsert(target, table("id int, v string", (1, "x"), (1, "y")), "id").collect()
    with pytest.raises(SpecError, match="no columns"):
        S.upsert(target, table("id int, w string", (1, "x")), "id")


def test_a_versioned_table_survives_a_crash_before_its_pointer_moves(spark, table, tmp_path):
    at = f"file://{tmp_path}/t"
    assert current_version(spark, at) is None
    replace_table(table("a int", (1,), (2,)), at)
    tables.write_version(table("a int", (9,)), at)  # and then it dies
    assert rows(read_table(spark, at)) == [(1,), (2,)]
    old = read_table(spark, at)
    again = replace_table(old.selectExpr("a + 1 AS a"), at)  # reads what it replaces
    assert rows(again) == [(2,), (3,)] and rows(old) == [(1,), (2,)]
    assert rows(replace_table(again.filter("a = 3"), at)) == [(3,)]
    kept = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]
    assert len(kept) == 2 and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_current-")]


def test_upserts_rewrite_only_the_partitions_they_touch(spark, table, tmp_path):
    at = str(tmp_path / "t")
    table("k int, day string, v string", (1, "mon", "a"), (2, "mon", "b"), (3, "tue", "c"), (4, "wed", "d"), (5, "a b/c", "e"), (6, None, "f")).write.partitionBy("day").parquet(at)
    names = lambda: {p.parent.name: {p.name for p in (tmp_path / "t").glob(f"{p.parent.name}/*.parquet")} for p in (tmp_path / "t").glob("*/*.parquet")}
    before = names()
    changes = table("k int, day string, v string", (3, "mon", "C"), (7, "thu", "g"), (5, "thu", "E"), (6, None, "F"))
    got = upsert_partitions(at, changes, "k", "day")
    want = [(1, "a", "mon"), (2, "b", "mon"), (3, "C", "mon"), (4, "d", "wed"), (5, "E", "thu"), (6, "F", None), (7, "g", "thu")]
    assert rows(got.select("k", "v", "day"), "k") == want and rows(spark.read.parquet(at).select("k", "v", "day"), "k") == want
    after = names()
    assert after["day=wed"] == before["day=wed"] and after["day=mon"] != before["day=mon"]
    assert not (tmp_path / "t" / "day=tue").exists() and len(after) == 4
    again = upsert_partitions(at, changes, "k", "day")
    assert rows(again.select("k", "v", "day"), "k") == want
    with pytest.raises(SpecError):
        upsert_partitions(at, table("k int", (1,)), "k", "day")


def test_json_that_drifts_keeps_all_rows(table):
    texts = [
        (1, '[{"a": 1, "b": "x"}, {"a": "2", "c": [1, 2]}]'),
        (2, '{"a": {"deep": 1}, "b": 7}'),
        (3, '[3, {"b": null}]'),
        (4, "no json"),
        (5, "[]"),
        (6, None),
    ]
    df = table("id int, rows string", *texts)
    got = S.json_rows_drift(df, "rows", "a bigint, b string").select("id", "a", "b", F.to_json("extra").alias("extra"), "malformed")
    assert rows(got) == rows(
        table(
            "id int, a bigint, b string, extra string, malformed string",
            (1, 1, "x", None, None),
            (1, 2, None, '{"c":[1,2]}', None),
            (2, None, "7", None, None),
            (3, None, None, None, "3"),
            (3, None, None, None, None),
            (4, None, None, None, "no json"),
        )
    )
    assert S.json_schema(df.filter("id < 3"), "rows").first()["schema"]
    with pytest.raises(SpecError):
        S.json_rows_drift(df, "rows", "id int")
