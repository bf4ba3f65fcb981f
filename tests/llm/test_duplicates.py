"""Near duplicates of documents and vectors against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cleanframe.llm import minhash, store, vectors

from . import brute


def edited(chance, words, n):
    out = list(words)
    for _ in range(n):
        out[chance.randrange(len(out))] = f"w{chance.randrange(10**6)}"
    return out


def corpus():
    """Copies from exact to barely similar, shared passages, short texts, a large group of near copies."""
    chance = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = [None, "", " \n ", "one", "One", "one two three four", "ONE two three four", "one two three four five", "É x y z w v"]
    passage = chance.choices(vocabulary, k=60)
    for _ in range(40):
        base = chance.choices(vocabulary, k=chance.randint(20, 200))
        texts.append(" ".join(base))
        for n in (0, 1, 2, 4, 8):
            texts.append(" ".join(edited(chance, base, n)))
        texts.append(" ".join(passage + chance.choices(vocabulary, k=chance.randint(10, 100))))
    hot = chance.choices(vocabulary, k=150)
    texts += [" ".join(edited(chance, hot, chance.choice((1, 2, 3)))) for _ in range(150)]
    texts += [" ".join(hot)] * 100
    texts.append(" ".join(chance.choices(vocabulary, k=30_000)))
    return texts


def test_documents_match_plain_python(spark):
    texts = corpus()
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    out = minhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == brute.near_duplicates(rows)
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "a b c d e f g h"
    rows = [(3, text), (3, text), (None, text), (7, text.upper()), (None, "other words than those here"), (5, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == sorted(
        [("3", "3", True), ("3", "3", True), ("None", "3", False), ("7", "3", False), ("None", "None", True), ("5", "5", True), ("None", "None", True)]
    )
    assert sorted(str(r["doc_id"]) for r in minhash.deduplicated(docs).collect()) == ["3", "5", "None", "None"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_shingles_and_sketches():
    for text in ("", "a", "a b c d", "a b c d e", "a b c d e a b c d e f", "x" * 600_000 + " y z", "é  \t b c d"):
        (made,) = minhash.shingle_sets(pa.array([text]))
        assert len(made) == len(brute.shingles(text))
    chance = np.random.default_rng(1)
    for n in (1, 3, 50, 2000):
        assert (minhash.sketch(chance.integers(0, 2**63, n).astype(np.uint64), 64) != np.uint64(2**64 - 1)).all()
    both = chance.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = minhash.sketch(both[:2000], 2000), minhash.sketch(both[1000:], 2000)
    assert abs((a == b).mean() - 1 / 3) < 0.05


def test_a_batch_does_not_change_a_text(spark):
    texts = corpus()[9:60]
    alone = [next(minhash.shingle_sets(pa.array([t]))) for t in texts]
    for one, other in zip(alone, minhash.shingle_sets(pa.array(texts))):
        assert (one == other).all()


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 51), (52, 50)]])
def test_components(spark, links):
    rows = [(f"{a:03}", f"{b:03}") for a, b in links]
    got = {r["node"]: r["label"] for r in store.components(spark.createDataFrame(rows, "a string, b string")).collect()}
    known = {x for pair in links if pair[0] != pair[1] for x in pair}
    want = brute.components(60, links)
    assert got == {f"{x:03}": f"{want[x]:03}" for x in known}


def vector_rows():
    chance = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        for _ in range(60):
            center = chance.standard_normal(16)
            rows += [(center + chance.standard_normal(16) * s).tolist() + [label] for s in (0, 0, 0.02, 0.08, 0.2)]
    hot = chance.standard_normal(16)
    rows += [(hot + chance.standard_normal(16) * 0.05).tolist() + [1] for _ in range(120)]
    return [(i, [float(np.float32(x)) for x in r[:-1]], r[-1]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("leaf, block", [(1500, 1500), (60, 1500), (1500, 40)])
def test_vectors_match_plain_python(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(table, leaf=leaf).collect()}
    want = brute.near_vectors(rows)
    assert got.keys() == want.keys()
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    if leaf == 1500:  # nothing is cut: brute force inside the leaf
        assert got == want
    assert found >= 0.99 * there


def test_links_of_a_dense_group_are_found(spark):
    draw = np.random.default_rng(3)
    middle = draw.standard_normal(64)
    # pairs of members have a cosine of about 0.93
    group = middle + 0.274 * np.linalg.norm(middle) / 8 * draw.standard_normal((1500, 64))
    others = draw.standard_normal((300, 64))
    rows = [(i, v.tolist(), int(i >= 1800)) for i, v in enumerate([*group, *others, *group[:900]])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(table, leaf=60).collect()}
    unit = np.array([v for _, v, _ in rows]) / np.linalg.norm([v for _, v, _ in rows], axis=1)[:, None]
    labels = np.array([label for *_, label in rows])
    want = ((unit @ unit.T >= 0.93) & (labels[:, None] == labels)).sum(axis=1) - 1
    assert want.sum() > 900_000
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0),
        (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (10, [None, 1.0], 0), (11, [], 0), (12, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.01], 0),
        (13, [-0.0, 1.0], 1), (14, [0.0, 1.0], 1), (15, [1e30, 1e30], 2), (16, [1e-30, 1e-30], 2),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.near_vectors(table).collect())
    group = [("1", 4, "1", True), ("2", 4, "1", False), ("3", 4, "1", False), ("3", 4, "1", False), ("None", 4, "1", False)]
    alone = [(str(i), 0, str(i), True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert got == sorted([*group, *alone, ("13", 1, "13", True), ("14", 1, "13", False), ("15", 1, "15", True), ("16", 1, "15", False)])
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_star_links_take_no_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(store, "stored", lambda df, real=store.stored: made.append(real(df)) or made[-1])
    links = spark.createDataFrame([(f"{i % 3:03}", f"{i:03}") for i in range(3, 90)], "a string, b string")
    assert store.components(links).count() == 90
    assert len(made) == 2


def test_later_rounds_join_links_between_components_only(spark, monkeypatch):
    joined = []

    def counted(links, real=minhash.components):
        links = links.cache()
        joined.append(links.count())
        return real(links)

    monkeypatch.setattr(minhash, "components", counted)
    texts = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(list(enumerate(texts)))
    assert len(joined) >= 2 and joined[0] > 150
    assert sum(joined[1:]) < joined[0] / 2


def test_members_of_a_large_group_are_not_paired(spark, monkeypatch):
    """Copies just below the threshold in one large group: few of their pairs are looked at after the second round."""
    looked = []

    def counted(pairs, *more, real=minhash._compared):
        pairs = pairs.cache()
        looked.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(minhash, "_compared", counted)
    chance = random.Random(8)
    base = [f"v{i}" for i in range(150)]
    texts = [" ".join(edited(chance, base, chance.choice((1, 2, 2, 3, 3, 4)))) for _ in range(500)]
    # pairs that are linked with each other and not with the rest
    for _ in range(20):
        far = edited(chance, base, 6)
        texts += [" ".join(far), " ".join(edited(chance, far, 1))]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(rows)
    assert sum(looked[2:]) < 2 * len(texts)


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_labels_of_a_bucket_are_joined_as_by_all_pairs(spark, percent):
    chance = random.Random(percent)
    buckets = []
    for size in (2, 3, 8, 40, 40):
        base = chance.sample(range(1000), chance.choice((1, 5, 30)))
        members = {frozenset(base)}
        while len(members) < size:
            old = set(chance.choice([base, *members]))
            old -= set(chance.sample(sorted(old), chance.randint(0, len(old) // 4)))
            members.add(frozenset(old | set(chance.sample(range(1000, 1030), chance.randint(not old, 3)))))
        buckets.append(sorted(members, key=sorted))
    buckets.append([frozenset(range(10 * i, 10 * i + 5)) for i in range(6)])  # no shingle that most have
    nodes = [(f"{k:02}-{i:02}", k, s) for k, members in enumerate(buckets) for i, s in enumerate(members)]
    sets = spark.createDataFrame([(name.encode(), sorted(s)) for name, _, s in nodes], "node binary, shingles array<bigint>")
    label = {name: name if chance.random() < 0.8 else f"{k:02}-00" for name, k, _ in nodes}
    left = spark.createDataFrame([(k, name.encode(), label[name].encode()) for name, k, _ in nodes], "bucket long, node binary, label binary")
    sure, pairs = minhash._near(left, sets, percent, minhash.stored)
    shingles = {name: s for name, _, s in nodes}
    linked = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    made = [(bytes(a).decode(), bytes(b).decode()) for a, b in sure.collect()]
    for a, b, la, lb in ([bytes(x).decode() for x in r] for r in pairs.collect()):
        assert (la, lb) == (label[a], label[b])
        if linked(shingles[a], shingles[b]):
            made.append((la, lb))
    wanted = [(label[a], label[b]) for a, k, s in nodes for b, q, r in nodes if k == q and a < b and linked(s, r)]
    place = {name: i for i, (name, *_) in enumerate(nodes)}
    joined = lambda links: brute.components(len(nodes), [(place[a], place[b]) for a, b in links])
    assert joined(made) == joined(wanted)
    assert wanted or percent == 100


def test_texts_are_not_dealt_out_for_a_few_copies(spark):
    """Ids that stay are many and those that go are few: the few are sent to the texts."""
    texts = [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(3000)]
    rows = list(enumerate(texts + texts[:20]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        kept = minhash.deduplicated(docs)
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(3000))
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
