"""The comparisons against a plain reading of their definitions on small tables."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cleanframe.errors import SpecError
from cleanframe.plans import compare as C, nearest

SCHEMA = "k string, a string, n bigint"


def some_rows(seed, n):
    pick = random.Random(seed)
    return [(f"k{pick.randrange(n)}", pick.choice(["x", "Y ", "z", None]), pick.randrange(3)) for _ in range(n)]


def plain(row):
    return tuple(None if v is None else str(v).strip().lower() for v in row)


def agree(r, s):
    return sum(x == y for x, y in zip(r, s))


def pair(spark, seed, n=30, m=25):
    wanted = some_rows(seed, n) if n else []
    made = (wanted[: m // 2] + some_rows(seed + 1, m - m // 2))[:m] if m else []
    frames = [spark.createDataFrame(r, SCHEMA) for r in (made, wanted)]
    return frames, [plain(r) for r in made], [plain(r) for r in wanted]


SIZES = [(1, 30, 25), (2, 12, 40), (3, 1, 1), (4, 0, 5), (5, 5, 0), (6, 0, 0)]


@pytest.mark.parametrize("seed,n,m", SIZES)
def test_cells_by_position(spark, seed, n, m):
    (c, e), made, wanted = pair(spark, seed, n, m)
    order = lambda r: tuple(str(r[i]) for i in (1, 0, 2))  # columns by name: a, k, n
    lined = itertools.zip_longest(sorted(made, key=order), sorted(wanted, key=order), fillvalue=(None,) * 3)
    matched, cells = sum(agree(r, s) for r, s in lined), 3 * max(len(made), len(wanted))
    got = C.cell_accuracy_by_position(c.repartition(3), e).first()
    assert (got.matched_cells, got.total_cells) == (matched, cells)
    assert got.accuracy == pytest.approx(1.0 if not cells else 0.0 if not wanted else matched / cells)


def test_cells_by_position_with_many_copies_and_other_columns(spark):
    e = spark.createDataFrame([("a", 1)] * 40 + [("b", 2)], "x string, y int")
    c = spark.createDataFrame([("a", 1.0, None)] * 35 + [("b", 2.0, "q")] * 3, "x string, y double, z string")
    got = C.cell_accuracy_by_position(c, e).first()
    # 35 equal rows; 3 rows b face rows a and agree in nothing; 3 expected rows
    # face nothing, which agrees with the column z they lack
    assert (got.total_cells, got.matched_cells) == (41 * 3, 35 * 3 + 3)


@pytest.mark.parametrize("seed,n,m", SIZES)
@pytest.mark.parametrize("group_rows", [10**6, 2])
def test_row_similarity_tries_all_pairs(spark, seed, n, m, group_rows):
    (c, e), made, wanted = pair(spark, seed, n, m)
    got = C.row_similarity(c, e, group_rows=group_rows).first()
    if not wanted or not made:
        assert got.score == (1.0 if wanted == made else 0.0)
        return
    exact = sum((Counter(made) & Counter(wanted)).values()) / len(wanted)
    best = sum(max(agree(r, s) for s in made) / 3 for r in wanted) / len(wanted)
    assert got.exact_ratio == pytest.approx(exact)
    assert got.partial_ratio == pytest.approx(best)
    assert got.score == pytest.approx(0.7 * exact + 0.3 * best)


def test_row_similarity_within_blocks(spark):
    (c, e), made, wanted = pair(spark, 7)
    got = C.row_similarity(c, e, block_by=["n"]).first()
    best = sum(max([agree(r, s) for s in made if s[2] == r[2]], default=0) / 3 for r in wanted) / len(wanted)
    assert got.partial_ratio == pytest.approx(best)


def test_row_similarity_over_different_columns(spark):
    e = spark.createDataFrame([("a", 1)], "x string, y int")
    c = spark.createDataFrame([("a", 1, None)], "x string, y int, z string")
    got = C.row_similarity(c, e).first()
    assert (got.exact_ratio, got.partial_ratio) == (0.0, 1.0)


def test_row_similarity_over_many_columns(spark):
    wide = spark.range(3).select(*[(F.col("id") * 100 + i).alias(f"c{i:02}") for i in range(13)])
    other = wide.withColumn("c03", F.lit(-1)).withColumn("c07", F.when(F.col("c00") == 0, F.col("c07")).otherwise(-2))
    got = C.row_similarity(other, wide).first()
    assert got.equal_rows == 0
    assert got.partial_ratio == pytest.approx((12 + 11 + 11) / 3 / 13)
    assert C.row_similarity(wide, wide, block_by=[f"c{i:02}" for i in range(12)]).first().score == 1.0


def test_row_similarity_sends_no_table_through_the_driver(spark, monkeypatch):
    """Spark expects stored cells to be as small as their files, and would broadcast them."""
    plans, store = [], nearest.materialize

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(nearest, "materialize", lambda df: store(planned(df)))
    monkeypatch.setattr(F, "broadcast", lambda df: df.hint("merge"))  # the list of hot keys may be
    some = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(3)).alias(f"c{i}") for i in range(8)]
    e, c = spark.range(120).select(*some), spark.range(1000, 1120).select(*some)
    got = planned(C.row_similarity(c, e, light=2)).first()
    made, wanted = [tuple(r) for r in c.collect()], [tuple(r) for r in e.collect()]
    best = sum(max(agree(r, s) for s in made) / 8 for r in wanted) / len(wanted)
    assert got.partial_ratio == pytest.approx(best)
    assert "collect_list(other" in plans[-1]  # patterns were compared
    assert [p for p in plans if "BroadcastExchange" in p] == []


def wide_rows(seed, n):
    """Rows of columns that hang together, of others, of one that is often the same and of names, with a worse copy."""
    pick = random.Random(seed)
    good = []
    for i in range(n):
        nr = pick.randrange(4 * n)
        dealt = [nr % m for m in range(2, 10)] + [pick.choice("xyz"), "same" if i % 2 else f"n{i}", None if nr % 5 else "z"]
        good.append([str(v) if v is not None else v for v in dealt] + [f"n{i % (n // 2)}", f"b{nr % 3}"])
    worse = [[None if pick.randrange(5) == 0 else v for v in row] for row in good[n // 5 :]]
    names = [f"c{i:02}" for i in range(len(good[0]))]
    return names, [tuple(r) for r in good], [tuple(r) for r in worse]


@pytest.mark.parametrize(
    "seed,light,group_rows,few,block_by",
    [(1, 3, 10**6, 10**6, []), (2, 3, 2, 0, ["c12"]), (3, 0, 10**6, 10**6, []), (4, 40, 10**6, 0, []), (5, 2, 10**6, 10**6, ["c12"]), (6, 10**6, 10**6, 10**6, [])],
)
def test_row_similarity_of_wide_rows_tries_all_pairs(spark, monkeypatch, seed, light, group_rows, few, block_by):
    monkeypatch.setattr(nearest, "FEW", few)
    monkeypatch.setattr(nearest, "FEW_BYTES", few)
    monkeypatch.setattr(nearest, "BITS", 20)  # cells in several words
    names, wanted, made = wide_rows(seed, 120)
    schema = ", ".join(f"{c} string" for c in names)
    got = C.row_similarity(spark.createDataFrame(made, schema), spark.createDataFrame(wanted, schema), block_by, group_rows, light).first()
    at = [names.index(b) for b in block_by]
    best = sum(max([agree(r, s) for s in made if all(r[i] == s[i] for i in at)], default=0) / len(names) for r in wanted) / len(wanted)
    assert got.partial_ratio == pytest.approx(best)


def test_row_similarity_stores_no_row_per_cell(spark, monkeypatch):
    """Of rows that have a near copy little is stored, however wide they are."""
    sizes, store = [], nearest.materialize

    def counted(df):
        sizes.append((out := store(df)).count())
        return out

    monkeypatch.setattr(nearest, "materialize", counted)
    e = spark.range(400).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(7)).alias(f"c{i:02}") for i in range(24)])
    c = e.withColumns({"c05": F.lit(-1), "c17": F.lit(-1)})
    assert C.row_similarity(c, e, light=8).first().partial_ratio == pytest.approx(22 / 24)
    assert max(sizes) <= 4 * 400


def test_cuts_part_columns_that_hang_together():
    """Each part of four columns, two of which repeat the others, tells as much as two columns."""
    lanes = nearest._lanes({i: 10 for i in range(4)})
    rows = []
    for a, b in itertools.product(range(1, 11), repeat=2):
        word = sum(v << lane.at for v, lane in zip((a, a, b, b), lanes))
        rows.append([word])
    assert sorted(sorted(x.part // 2 for x in part) for part in nearest._cut(rows, lanes, 2)) == [[0, 1], [0, 1]]


@pytest.mark.parametrize("seed,n,m", SIZES)
def test_multiset_overlap_and_equality(spark, seed, n, m):
    (c, e), made, wanted = pair(spark, seed, n, m)
    got = C.multiset_overlap(c, e).first()
    assert tuple(got) == (sum((Counter(made) & Counter(wanted)).values()), len(made), len(wanted))
    assert C.same_rows(c, e).first().same == (Counter(made) == Counter(wanted))


def test_same_rows_by_strictness(table):
    e, c = table("a string, b string", ("7", None)), table("a double, b string", (7.0, None))
    assert C.same_rows(c, e).first().same is True
    assert C.same_rows(c, e, mode="text").first().same is False
    empty = table("a string, b string", ("7", ""))
    assert C.same_rows(empty, e).first().same is False
    assert C.same_rows(empty, e, mode="text").first().same is True
    extra = e.withColumn("z", F.lit(1))
    assert C.same_rows(extra, e).first().same is False
    assert C.same_rows(extra, e, columns=["a", "b"]).first().same is True
    assert C.same_rows(extra.filter("false"), e.filter("false")).first().same is True


def test_column_sets(table):
    sets = C.column_sets(table("a int, x int", (1, 1)), table("a int, b int", (1, 1)))
    assert sets == {"shared": ["a"], "missing": ["b"], "extra": ["x"]}


def test_cells_by_key(table):
    e = table("id string, a string, n double, nr int", ("1", "x", 1.0, 1), ("2", "y", 2.0, 2), ("3", None, 3.0, 3), ("4", "w", 4.0, 4))
    c = table("id int, a string, n string, nr int", (1, " X", "1", 1), (1, "bad", "9", 2), (2, "y", "3", 3), (3, None, "3.0", 4), (8, "q", "1", 5))
    got = C.cell_accuracy_by_key(c, e, "id", ["a", "n"], ["nr"]).first()
    assert (got.shared_keys, got.matched_cells) == (3, 5)
    assert got.coverage == 0.75 and got.duplicate_share == pytest.approx(0.2)
    assert got.score == pytest.approx(0.7 * 5 / 6 + 0.3 * 0.75 - 0.2 * 0.2)
    nothing = C.cell_accuracy_by_key(c.filter("id = 8"), e, "id", ["a", "n"], ["nr"]).first()
    assert nothing.score == 0.0


def test_blended_match(table):
    e = table("k string, n int", ("a", 1), ("b", 2), ("c", 3))
    c = table("k string, n int", ("a", 1), ("b", 9))
    got = C.blended_match(c, e, ["k"], ["n"]).first()
    assert got.exact_row_match_score == pytest.approx(1 / 3, abs=1e-6)
    assert got.partial_match == pytest.approx((1 + 0.5) / 3, abs=1e-6)
    assert got.row_count_score == pytest.approx(2 / 3, abs=1e-6)
    assert got.score == pytest.approx(0.55 / 3 + 0.25 * 0.5 + 0.1 + 0.1 * 2 / 3, abs=1e-6)
    assert (got.exact_match, got.wrong_columns, got.missing_columns) == (False, False, [])


def test_blended_match_edges(table):
    e = table("k string, n int", ("a", 1), ("a", 1))
    none = e.filter("false")
    assert tuple(C.blended_match(none, none, ["k"], ["n"]).first())[:3] == (1.0, True, 1.0)
    assert tuple(C.blended_match(none, e, ["k"], ["n"]).first())[:3] == (0.0, False, 0.0)
    assert tuple(C.blended_match(e, none, ["k"], ["n"]).first())[:3] == (0.0, False, 0.0)
    assert tuple(C.blended_match(e, e, ["k"], ["n"]).first())[:3] == (1.0, True, 1.0)
    wide = C.blended_match(e.withColumn("z", F.lit(1)), e.withColumn("y", F.lit(1)), ["k"], ["n"]).first()
    assert (wide.wrong_columns, wide.missing_columns, wide.extra_columns, wide.exact_match) == (True, ["y"], ["z"], False)
    assert wide.column_match_score == pytest.approx(2 / 3, abs=1e-6)


def test_a_hot_block_pairs_one_to_one_in_order(spark):
    e = spark.range(300).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("n"))
    c = e.filter("n >= 100")
    one_task = C.blended_match(c, e, ["k"], ["n"]).first()
    ranged = C.blended_match(c, e, ["k"], ["n"], group_rows=20).first()
    assert one_task == ranged
    assert ranged.partial_match == pytest.approx(200 * 0.5 / 300, abs=1e-6)  # k agrees, n is off by 100


def test_row_comparisons(table):
    e = table("k string, n int", ("a", 1), ("b", 2), ("c", 3))
    c = table("k string, n int", ("a", 1), ("b", 9))
    got = C.row_comparisons(c, e, ["k"], ["n"], n=2).collect()
    assert [(r.expected_index, r.similarity) for r in got] == [(0, 1.0), (1, 0.5)]
    assert (got[1].expected_row, got[1].candidate_row) == ('{"k":"b","n":2}', '{"k":"b","n":9}')


REPORT = "ward string, drug string, n bigint"


def test_grouped_measure_accuracy(table):
    e = table(REPORT, ("ICU", "a", 10), ("ER", "b", 4))
    c = table(REPORT, (" icu", "A", 6), ("ICU", "a ", 2), ("OBS", "z", 1), ("", "a", 5))
    got = C.grouped_measure_accuracy(c, e, ["ward", "drug"], "n").first()
    assert (got["keys"], got.accuracy) == (3, pytest.approx((0.8 + 0 + 0) / 3))
    none = e.filter("false")
    scores = [C.grouped_measure_accuracy(x, y, ["ward", "drug"], "n").first().accuracy for x, y in ((none, none), (none, e), (e, none), (e, e))]
    assert scores == [1.0, 0.0, 0.0, 1.0]


def test_expected_measure_match(table):
    e = table("ward string, n bigint", ("ICU", 10), ("ER", 4))
    c = table("ward string, n string", ("icu", "8"), ("OBS", "1"), ("er", "x"))
    got = C.expected_measure_match(c, e, ["ward"], "n").first()
    assert got.match == pytest.approx((0.8 + 0) / 2)
    assert got.score == pytest.approx(0.75 * 0.4 + 0.15 * 0.5 + 0.1)
    more = C.expected_measure_match(c.union(table("ward string, n string", (None, "1"))), e, ["ward"], "n").first()
    assert more.score == pytest.approx(0.75 * 0.4 + 0.1)
    assert C.expected_measure_match(c.drop("n"), e, ["ward"], "n").first().score == pytest.approx(0.05)
    none = e.filter("false")
    scores = [C.expected_measure_match(x, y, ["ward"], "n").first().score for x, y in ((none, none), (e, none), (e, e))]
    assert scores == [1.0, 0.0, pytest.approx(1.0)]


def test_multi_measure_accuracy(table):
    schema = "unit string, o bigint, t bigint"
    e = table(schema, ("A", 10, 4), ("B", 2, 0))
    c = table("unit string, o string, t string", ("a", "5", "4"), ("C", "1", "1"), ("B", "x", "0"))
    got = C.multi_measure_accuracy(c, e, ["unit"], ["o", "t"]).first()
    assert got["mean"] == pytest.approx((0.5 + 1) / 2 / 3)
    assert got.score == pytest.approx(0.85 * 0.25 + 0.15, abs=1e-6)
    assert C.multi_measure_accuracy(c.filter("false"), e, ["unit"], ["o", "t"]).first().score == 0.0
    assert C.multi_measure_accuracy(e, e, ["unit"], ["o", "t"]).first().score == 1.0


@pytest.mark.parametrize("seed", [11, 12])
def test_a_shuffled_table_equals_itself(spark, seed):
    (_, e), _, _ = pair(spark, seed)
    mixed = e.orderBy(F.rand(seed)).repartition(6).select("n", "k", "a")
    assert C.cell_accuracy_by_position(mixed, e).first().accuracy == 1.0
    assert C.row_similarity(mixed, e).first().score == 1.0
    assert C.same_rows(mixed, e).first().same
    assert C.blended_match(mixed, e, ["k"], ["a", "n"]).first().score == 1.0


def _best(made, wanted, fixed=()):
    """Per wanted row the most equal cells of a made row that agrees in the fixed columns."""
    score = lambda r, s: sum(a == b for a, b in zip(r, s))
    return [max((score(r, s) for s in made if all(r[i] == s[i] for i in fixed)), default=0) for r in wanted]


@pytest.mark.parametrize("seed,values,width,fixed,light", [(1, 2, 9, (), 1), (2, 3, 6, (0,), 2), (3, 2, 12, (), 3), (4, 40, 8, (), 2), (5, 2, 1, (), 1), (6, 4, 5, (1, 3), 1)])
def test_nearest_rows_by_few_and_by_heavy_values(spark, seed, values, width, fixed, light):
    chance = random.Random(seed)
    row = lambda: tuple(str(min(chance.randrange(values), chance.randrange(values))) if i % 3 else chance.choice("xxxy") for i in range(width))
    made, wanted = [row() for _ in range(60)], [row() for _ in range(50)]
    schema = ", ".join(f"c{i:02} string" for i in range(width))
    c, e = spark.createDataFrame(made, schema), spark.createDataFrame(wanted, schema)
    group_rows = 3 if seed % 2 else 10**6
    got = C.row_similarity(c, e, block_by=[f"c{i:02}" for i in fixed], light=light, group_rows=group_rows).first()
    assert got.partial_ratio == pytest.approx(sum(_best(made, wanted, fixed)) / width / len(wanted))


def test_nearest_rows_of_a_wide_table_with_a_value_in_half_the_rows(spark):
    chance = random.Random(8)
    base = [[str(i), *("same" if chance.random() < 0.5 else f"v{chance.randrange(30)}" for _ in range(34))] for i in range(120)]
    made = [tuple(r) for r in base]
    wanted = [tuple(f"new{k}" if i == 0 or chance.random() < 0.3 else v for i, v in enumerate(r)) for k, r in enumerate(base)]
    schema = ", ".join(f"c{i:02} string" for i in range(35))
    got = C.row_similarity(spark.createDataFrame(made, schema), spark.createDataFrame(wanted, schema), light=8).first()
    assert got.partial_ratio == pytest.approx(sum(_best(made, wanted)) / 35 / len(wanted))


def _greedy(made, wanted):
    """Equal cells of pairs fixed by (similarity, expected place, candidate place) over rows with copies."""
    left = []
    for rows in (wanted, made):
        side = {}
        for place, r in enumerate(rows):
            side.setdefault(r, [place, 0])[1] += 1
        left.append(side)
    order = sorted((-sum(a == b for a, b in zip(r, s)), e[0], c[0], r, s) for r, e in left[0].items() for s, c in left[1].items())
    total = 0
    for less, _, _, r, s in order:
        take = min(left[0][r][1], left[1][s][1])
        left[0][r][1] -= take
        left[1][s][1] -= take
        total -= less * take
    return total


@pytest.mark.parametrize("small", [10**6, 6, 0])
def test_pairs_by_similarity(spark, small):
    chance = random.Random(4)
    made = [(chance.randrange(6), i, *(chance.choice("abc") for _ in range(4))) for i in range(70)]
    wanted = [(chance.randrange(6), i, *(chance.choice("abc") for _ in range(4))) for i in range(60)] + [(9, 60, "a", "a", "a", "a")]
    schema = "block int, at int, w string, x string, y string, z string"
    c, e = spark.createDataFrame(made, schema).repartition(3), spark.createDataFrame(wanted, schema)
    cells = sum(_greedy([r[2:] for r in made if r[0] == b], [r[2:] for r in wanted if r[0] == b]) for b in range(10))
    got = C.blended_match(c, e, ["block"], ["at"], pair_by="similarity", columns=["w", "x", "y", "z"], small=small).first()
    assert got.partial_match == pytest.approx(cells / 4 / len(wanted), abs=1e-6)
    assert got.column_match_score == 1.0 and not got.wrong_columns


def test_equal_tables_pair_fully_and_empty_ones_not_at_all(spark):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, x string")
    assert C.blended_match(e, e, ["k"], ["x"], pair_by="similarity").first().score == 1.0
    assert C.blended_match(e.limit(0), e, ["k"], ["x"], pair_by="similarity").first().score == 0.0
    with pytest.raises(SpecError):
        C.blended_match(e, e, ["k"], ["x"], pair_by="luck")


def test_fingerprints_tell_rows_apart_without_shuffling_them(spark):
    for seed, n, m in ((1, 40, 40), (2, 9, 0), (3, 0, 0)):
        (c, e), made, wanted = pair(spark, seed, n, m)
        assert C.same_fingerprints(c, e).first().same == (Counter(made) == Counter(wanted))
        assert C.same_fingerprints(c.repartition(5), c).first().same
        assert C.same_fingerprints(c.union(c), c).first().same == (not made)
        got = {tuple(r)[:-2]: (r.candidate_rows, r.expected_rows) for r in C.differing_rows(c, e).collect()}
        assert sum(a - b for a, b in got.values()) == len(made) - len(wanted)
    swapped = spark.createDataFrame([(None, "a"), ("b", None)], "x string, y string")
    assert not C.same_fingerprints(swapped, swapped.selectExpr("y AS x", "x AS y")).first().same
    plan = C.same_fingerprints(swapped, swapped)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan
