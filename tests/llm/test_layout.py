"""Mixing, sharding, the pipeline and the registered queries."""

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import canonical, connect
from cleanframe.llm import langid, mixing, queries, sharding
from pyspark.sql import functions as F

from . import brute

FOLDER = "/root/testdata/sf0.001"


def sized(chance, n):
    sources = ["b", "a", None, "c", "z", "é"]
    weights = [40, 5, 3, 1, 1, 0.2]
    rows = [(i, " ".join(["w"] * chance.choice((0, 1, 3, 20, 200))), s, "x") for i, s in enumerate(chance.choices(sources, weights, k=n))]
    return rows + [(None, "one two", "a", "x"), (None, "one two", "a", "x"), (n, None, "a", "x"), (n + 1, "", None, "x")]


def test_targets_and_quotas(spark):
    chance = random.Random(4)
    for n in (1, 2, 5, 23):
        sizes = {(None if i == 3 else f"s{i:02}"): chance.choice((0, 1, 7, 90, 4000)) for i in range(n)}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r for r in mixing.quotas(mixing.targets(table), 4, 50).collect()}
        want = brute.targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert {s: r["target"] for s, r in got.items()} == pytest.approx(want)
        if sum(sizes.values()):
            total = sum(r["target"] for r in got.values())
            words = {r["block_words"] for r in got.values()}.pop()
            assert words == max(1, total // (max(50, 16 * n) * 4))
            blocks = max(1, round(total / (words * 4) + 1e-9))
            assert {s: r["quota"] for s, r in got.items()} == brute.sainte_lague({s: r["target"] for s, r in got.items()}, blocks)


def test_the_mix_meets_its_targets(spark):
    rows = sized(random.Random(6), 900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(3)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(brute.words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = brute.targets(dict(sizes))
    assert target == pytest.approx(want)
    for s, words in taken.items():
        assert abs(words - want[s]) <= 8 * (got[0]["block_words"] + 1)
    again = mixing.mix(docs.repartition(7)).select("doc_id", "text", "taken").collect()
    assert Counter((r["doc_id"], r["text"], r["taken"]) for r in again) == Counter((r["doc_id"], r["text"], r["taken"]) for r in got)
    times = Counter((r["doc_id"], r["text"]) for r in got for _ in range(round(r["taken"] / r["size"]) if r["size"] else 0))
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    told = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert sum(abs(told[k] - times[k]) for k in told | times) <= len(sizes)  # a half is rounded either way
    assert mixing.mix(docs.limit(0)).count() == 0
    silent = docs.filter("text is null or text = ''")
    assert {(r["taken"], r["target"]) for r in mixing.mix(silent).collect()} == {(0, 0.0)}


def test_mixing_runs_without_python(spark):
    plan = mixing.mix(spark.read.parquet(f"{FOLDER}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("shards, range_bytes", [(7, 1 << 20), (3, 500)])
def test_shards(spark, shards, range_bytes):
    chance = random.Random(shards)
    rows = [(i, "t" * chance.choice((0, 5, 40, 300)) + str(i % 400)) for i in range(1500)]
    rows += [(2000 + i, "the same text") for i in range(700)] + [(None, "x"), (None, None), (5000, None), (5001, ""), (5002, "y"), (5002, "y")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, slot string").repartition(3)
    got = sharding.shard(docs, shards, range_bytes=range_bytes).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    members = defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16 and r["text_crc32"] == brute.crc(r["text"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
        members[r["shard"]].append(r)
    assert sorted(members) == list(range(shards))
    mean, largest = sum(r["size"] for r in got) / shards, max(r["size"] for r in got)
    order = []
    for s in sorted(members):
        assert sorted(r["slot"] for r in members[s]) == list(range(len(members[s])))
        assert abs(sum(r["size"] for r in members[s]) - mean) <= largest
        order += [(-1 if r["text_crc32"] is None else r["text_crc32"], r["doc_id"] or -1) for r in sorted(members[s], key=lambda r: r["slot"])]
    assert order == sorted(order)


def test_few_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    got = sharding.shard(docs, 40).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2] and {r["slot"] for r in got} == {0}
    assert sharding.shard(docs.limit(0), 40).count() == 0


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = canonical(pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns))
    assert got.equals(canonical(duck.execute(entry.oracle_sql()[name]).df()))


def test_each_operator_has_a_query():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_the_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [f" {' '.join(brute.plain_words(r['text']))} " for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    odd = [(10_001, None, "en", "s", 0), (10_002, "1 2 3", "en", "s", 5), (10_003, "", None, None, 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    before = {r["doc_id"]: r["text"] for r in docs.collect()}

    out = stages["language ID"](spark, docs, FOLDER)
    assert out.columns == docs.columns
    model = langid.train(docs)
    rejected = {r["doc_id"] for r in langid.identify(docs, model, ["doc_id"]).collect() if r["rejected"]}
    assert {r["doc_id"] for r in out.collect()} == set(before) - rejected and {10_001, 10_002, 10_003} <= rejected

    out = stages["MinHash near-dedup"](spark, docs, FOLDER)
    assert out.columns == docs.columns
    kept = {i for i, (_, c) in brute.near_duplicates(before.items()).items() if i == c}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(kept)

    out = stages["benchmark decontamination"](spark, docs, FOLDER)
    assert out.columns == docs.columns
    spoiled = {d for d, t in before.items() if any(b in f" {' '.join(brute.plain_words(t))} " for b in bench)}
    gone = set(before) - {r["doc_id"] for r in out.collect()}
    assert spoiled <= gone and len(gone - spoiled) <= 1

    out = stages["mixing sources to target weights"](spark, docs, FOLDER)
    assert out.columns == docs.columns
    taken = {r["doc_id"]: round(r["taken"] / r["size"]) if r["size"] else 0 for r in mixing.mix(docs).collect()}
    told = Counter(r["doc_id"] for r in out.collect())
    assert sum(abs(told[d] - n) for d, n in taken.items()) <= 20

    out = stages["sharding"](spark, docs, FOLDER)
    assert set(docs.columns) <= set(out.columns)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(before.keys())
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).filter("n != m + 1").count() == 0
    assert 0 < whole.count()


def test_operators_take_little_memory_beside_an_executor(spark, monkeypatch):
    """Small batches in Python, each text sent once, and no sort of all rows to measure the ranges."""
    import tracemalloc

    import pyarrow as pa

    from cleanframe.llm import decontaminate, minhash

    texts = pa.array([" ".join(f"w{(i * 31 + j * j) % 4999}" for j in range(4000)) for i in range(800)])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    for operator in (minhash._sets, decontaminate._frequencies):
        tracemalloc.start()
        for _ in operator(iter([batch])):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 3 * batch.nbytes
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('some text of ', id) AS text")
    items = spark.createDataFrame([(1, "one two three four five")], "item_id int, text string")
    plan = decontaminate.decontaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "__text" not in plan
    plans, store = [], sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
    sharding.shard(docs, 3)
    assert [p for p in plans if "SortAggregate" in p] == []


def test_a_plan_holds_the_cuts_once(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(300)], "doc_id long, text string")
    out = sharding.shard(docs, 5)
    assert out.count() == 300
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("collect_list(") <= 2
