"""Scores of a candidate table against an expected one.

Each function returns one row of metrics. Cells count as equal by their
canonical text (see functions.values.canonical); two missing cells are equal.
No comparison forms pairs of rows beyond one partner per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..errors import SpecError, require_columns
from ..functions.values import as_text, canonical, sort_text, strip, to_whole
from ..operators.dedupe import first_per_key
from ..operators.ordered import GROUP_ROWS, range_count, running_sum
from ..sources import materialize
from .nearest import LIGHT, nearest
from .pairing import SMALL, equal_cells
from .quality import clamp, closeness


def column_sets(candidate: DataFrame, expected: DataFrame) -> dict[str, list[str]]:
    """Shared, missing and extra columns of the candidate."""
    c, e = set(candidate.columns), set(expected.columns)
    return {"shared": sorted(c & e), "missing": sorted(e - c), "extra": sorted(c - e)}


def _cells(df: DataFrame, columns, mode: str = "value") -> list[Column]:
    """Canonical cells named c0, c1, ...; a column the table lacks is null."""
    return [
        (canonical(F.col(c), df.schema[c].dataType, mode) if c in df.columns else F.lit(None).cast("string")).alias(
            f"c{i}"
        )
        for i, c in enumerate(columns)
    ]


def _row_counts(candidate: DataFrame, expected: DataFrame, columns, mode: str = "value") -> DataFrame:
    """Distinct canonical rows with how often each side holds them: one shuffle, no join."""
    names = [f"c{i}" for i in range(len(columns))]
    both = candidate.select(*_cells(candidate, columns, mode), F.lit(1).alias("c"), F.lit(0).alias("e")).unionByName(
        expected.select(*_cells(expected, columns, mode), F.lit(0).alias("c"), F.lit(1).alias("e"))
    )
    return both.groupBy(*names).agg(F.sum("c").alias("c"), F.sum("e").alias("e"))


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def multiset_overlap(candidate: DataFrame, expected: DataFrame, columns=None) -> DataFrame:
    """How many rows the two tables share, counting copies."""
    columns = columns or column_sets(candidate, expected)["shared"]
    counts = _row_counts(candidate, expected, columns)
    return counts.agg(
        _total(F.least("c", "e")).alias("shared_rows"),
        _total(F.col("c")).alias("candidate_rows"),
        _total(F.col("e")).alias("expected_rows"),
    )


def same_rows(candidate: DataFrame, expected: DataFrame, columns=None, mode: str = "value") -> DataFrame:
    """Whether both tables hold the same rows equally often, in any order."""
    sets = column_sets(candidate, expected)
    if columns is None and (sets["missing"] or sets["extra"]):
        rows = candidate.select(F.lit(1).alias("n")).unionByName(expected.select(F.lit(1).alias("n")))
        return rows.agg((F.count("n") == 0).alias("same"))
    counts = _row_counts(candidate, expected, columns or sets["shared"], mode)
    return counts.agg((F.count_if(F.col("c") != F.col("e")) == 0).alias("same"))


def fingerprint(df: DataFrame, columns=None, mode: str = "value") -> DataFrame:
    """One row (`rows`, `first`, `second`) that tells tables of different rows apart, in any order.

    The sums of two independent 64-bit hashes of each row's canonical cells: no row is shuffled. Different
    multisets of rows have equal sums with a chance of about 2**-128.
    """
    columns = sorted(df.columns) if columns is None else list(columns)
    cells = [F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in _cells(df, columns, mode)]
    hashes = [F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)").alias(f"h{seed}") for seed in (1, 2)]
    sums = [F.coalesce(F.sum(f"h{seed}"), F.lit(0)).cast("decimal(38,0)").alias(name) for seed, name in ((1, "first"), (2, "second"))]
    return df.select(*hashes).agg(F.count(F.lit(1)).alias("rows"), *sums)


def same_fingerprints(candidate: DataFrame, expected: DataFrame, columns=None, mode: str = "value") -> DataFrame:
    """same_rows() by fingerprints, without a shuffle of rows; `differing_rows` says which rows differ."""
    sets = column_sets(candidate, expected)
    if columns is None and (sets["missing"] or sets["extra"]):
        return same_rows(candidate, expected)
    columns = list(columns or sets["shared"])
    told = F.struct("rows", "first", "second").alias("told")
    mine, other = (fingerprint(df, columns, mode).select(told).scalar() for df in (candidate, expected))
    return candidate.sparkSession.range(1).select((mine == other).alias("same"))


def differing_rows(candidate: DataFrame, expected: DataFrame, columns=None, mode: str = "value") -> DataFrame:
    """The distinct canonical rows that the tables don't hold equally often, with `candidate_rows` and `expected_rows`."""
    columns = list(columns or column_sets(candidate, expected)["shared"])
    counts = _row_counts(candidate, expected, columns, mode).filter("c <> e")
    return counts.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("c").alias("candidate_rows"), F.col("e").alias("expected_rows")
    )


# -- cells by position ------------------------------------------------------


def _runs(df: DataFrame, columns) -> tuple[DataFrame, Column]:
    """The sorted table as runs of equal rows: from start to before stop, with
    their cells. Also the number of rows. The counted rows are stored: the cells
    are parsed once, and the order is cut by what is read from the store.
    """
    own = sorted(df.columns)
    texts = df.select(*[sort_text(F.col(c), df.schema[c].dataType).alias(f"s{i}") for i, c in enumerate(own)])
    order = [f"s{i}" for i in range(len(own))]

    def cell(column):
        if column not in own:
            return F.lit(None).cast("string")
        text, dtype = F.col(f"s{own.index(column)}"), df.schema[column].dataType
        if isinstance(dtype, T.BooleanType):
            return F.when(text == "True", "1").when(text == "False", "0")
        return F.when(text != "None", canonical(text, T.StringType()))

    counted = materialize(texts.groupBy(*order).agg(F.count(F.lit(1)).alias("n")))
    cells = F.struct(*[cell(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("cells")
    placed = running_sum(counted, "n", order, name="stop", ties=()).select("n", "stop", cells)
    rows = counted.agg(_total(F.col("n")).alias("n")).first()["n"]
    return placed.select((F.col("stop") - F.col("n")).alias("start"), "stop", "cells"), rows


def _pieces(runs: DataFrame, side: str, width: Column) -> DataFrame:
    """The runs cut at every multiple of width, so that each range of positions
    can be overlaid on its own."""
    first, last = F.floor(F.col("start") / F.col("width")), F.floor((F.col("stop") - 1) / F.col("width"))
    cut = runs.filter("start < stop").withColumn("width", width).withColumn("range", F.explode(F.sequence(first, last)))
    return cut.select(
        "range",
        F.greatest(F.col("start"), F.col("range") * F.col("width")).alias("start"),
        F.struct(F.least(F.col("stop"), (F.col("range") + 1) * F.col("width")).alias("stop"), "cells.*").alias(side),
    )


def cell_accuracy_by_position(candidate: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of equal cells when both tables are sorted and laid side by side.

    Rows sort by the text of their cells in column-name order. Both sides are
    kept as runs of equal rows, so any number of copies is one run. Missing
    rows at the end of the shorter side are a run of empty cells.
    """
    columns = sorted(set(candidate.columns) | set(expected.columns))
    (runs_e, rows_e), (runs_c, rows_c) = _runs(expected, columns), _runs(candidate, columns)
    longest = max(rows_e, rows_c)
    width = F.lit(max(-(-longest // range_count(expected)), 1)).cast("bigint")

    def side(runs, rows, name):
        empty = F.struct(*[F.lit(None).cast("string").alias(f"c{i}") for i in range(len(columns))])
        tail = candidate.sparkSession.range(1).select(
            F.lit(rows).cast("bigint").alias("start"), F.lit(longest).cast("bigint").alias("stop"), empty.alias("cells")
        )
        return _pieces(runs.unionByName(tail), name, width)

    points = side(runs_e, rows_e, "e").unionByName(side(runs_c, rows_c, "c"), allowMissingColumns=True)
    so_far = Window.partitionBy("range").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    overlay = points.select("start", *[F.last(s, ignorenulls=True).over(so_far).alias(s) for s in "ec"])
    length = F.least(F.col("e.stop"), F.col("c.stop")) - F.col("start")
    overlaid = F.col("e").isNotNull() & F.col("c").isNotNull()
    equal = sum((F.col(f"e.c{i}").eqNullSafe(F.col(f"c.c{i}")).cast("bigint") for i in range(len(columns))), F.lit(0))
    matched = overlay.agg(_total(F.when(overlaid, length * equal)).alias("matched_cells"))
    cells = F.lit(longest * len(columns)).cast("bigint")
    accuracy = F.when(cells == 0, 1.0).when(F.lit(rows_e == 0), 0.0).otherwise(F.try_divide(F.col("matched_cells"), cells))
    return matched.select("matched_cells", cells.alias("total_cells"), accuracy.alias("accuracy"))


# -- cells by key -----------------------------------------------------------


def cell_accuracy_by_key(candidate: DataFrame, expected: DataFrame, key: str, columns, order_by) -> DataFrame:
    """0.7 x cell accuracy over shared keys + 0.3 x coverage - 0.2 x repeated rows.

    Of repeated keys the first row counts, on both sides; both sides meet in
    one aggregation per key rather than a join.
    """
    columns, order_by = list(columns), list(order_by)

    def side(df, name):
        require_columns(df, [key, *columns, *order_by])
        cells = df.select("*", F.struct(*_cells(df, columns)).alias("cells"))
        rank = [F.col(o).alias(f"o{i}") for i, o in enumerate(order_by)]
        return cells.select(
            canonical(F.col(key), df.schema[key].dataType).alias("key"),
            *[
                (F.struct(*rank, F.xxhash64("cells").alias("tie"), "cells") if s == name else F.lit(None)).alias(s)
                for s in "ce"
            ],
        ).filter(F.col("key").isNotNull())

    both_sides = side(candidate, "c").unionByName(side(expected, "e"))
    met = both_sides.groupBy("key").agg(
        F.min("c")["cells"].alias("c"), F.min("e")["cells"].alias("e"), F.count("c").alias("candidate_rows")
    )
    both = F.col("c").isNotNull() & F.col("e").isNotNull()
    equal = sum((F.col(f"c.c{i}").eqNullSafe(F.col(f"e.c{i}")).cast("int") for i in range(len(columns))), F.lit(0))
    totals = met.agg(
        F.count_if(both).alias("shared_keys"),
        F.count_if(F.col("e").isNotNull()).alias("expected_keys"),
        F.count_if(F.col("c").isNotNull()).alias("candidate_keys"),
        _total(F.when(both, equal)).alias("matched_cells"),
        _total(F.col("candidate_rows")).alias("candidate_rows"),
    )
    one = F.lit(1)
    parts = totals.select(
        "shared_keys",
        "matched_cells",
        (F.col("matched_cells") / F.greatest(F.col("shared_keys") * len(columns), one)).alias("cell_accuracy"),
        (F.col("shared_keys") / F.greatest("expected_keys", one)).alias("coverage"),
        ((F.col("candidate_rows") - F.col("candidate_keys")) / F.greatest("candidate_rows", one)).alias(
            "duplicate_share"
        ),
    )
    score = clamp(0.7 * F.col("cell_accuracy") + 0.3 * F.col("coverage") - 0.2 * F.col("duplicate_share"))
    return parts.withColumn("score", F.when(F.col("shared_keys") == 0, 0.0).otherwise(score))


# -- rows by best match -----------------------------------------------------

def row_similarity(candidate: DataFrame, expected: DataFrame, block_by=(), group_rows: int = GROUP_ROWS, light: int = LIGHT) -> DataFrame:
    """0.7 x share of equal rows + 0.3 x mean best similarity of an expected row.

    The best similarity of a row is the largest share of columns in which some
    candidate row agrees with it. It is found without comparing rows in pairs,
    through an index of cells (see plans.nearest), at any number of columns.
    Rows found exactly need no search. With `block_by` only candidates agreeing
    in those columns count. The search runs jobs while this is built.
    """
    columns = sorted(set(candidate.columns) | set(expected.columns))
    width = len(columns)
    fixed = [columns.index(b) for b in dict.fromkeys(block_by) if b in columns]
    if len(fixed) != len(set(block_by)):
        raise SpecError("block_by columns must occur in the tables")
    free = [i for i in range(width) if i not in fixed]

    texts = [F.coalesce(F.concat(F.lit("="), F.col(f"c{i}")), F.lit("")) for i in range(width)]
    counts = materialize(
        _row_counts(candidate, expected, columns).select(
            F.monotonically_increasing_id().alias("id"),
            *[F.array(*[texts[i] for i in some]).cast("array<string>").alias(n) for n, some in (("block", fixed), ("cells", free))],
            "c",
            "e",
        )
    )
    same_columns = set(candidate.columns) == set(expected.columns)
    totals = counts.agg(
        _total(F.least("c", "e") if same_columns else F.lit(0)).alias("equal_rows"),
        _total(F.when(F.col("c") > 0, F.col("e"))).alias("found_rows"),
        _total(F.col("e")).alias("expected_rows"),
        _total(F.col("c")).alias("candidate_rows"),
    )
    missing, offered = counts.filter((F.col("e") > 0) & (F.col("c") == 0)), counts.filter(F.col("c") > 0)
    near = F.lit(0)
    if fixed:
        blocks = offered.select("block").distinct()
        near = near + missing.join(blocks, "block", "left_semi").agg(_total(F.col("e") * len(fixed)).alias("s")).scalar()
    if free:
        best = nearest(missing.drop("c"), offered, len(free), light, group_rows=group_rows)
        near = near + best.agg(_total(F.col("e") * F.col("agree")).alias("s")).scalar()
    rows = F.greatest(F.col("expected_rows"), F.lit(1))
    exact = F.col("equal_rows") / rows
    partial = (F.col("found_rows") + near / width) / rows
    one_empty = (F.col("expected_rows") == 0) | (F.col("candidate_rows") == 0)
    both_empty = (F.col("expected_rows") == 0) & (F.col("candidate_rows") == 0)
    scored = totals.select("equal_rows", exact.alias("exact_ratio"), partial.alias("partial_ratio"), both_empty.alias("b"), one_empty.alias("o"))
    score = clamp(0.7 * F.col("exact_ratio") + 0.3 * F.col("partial_ratio"))
    return scored.select(
        "equal_rows",
        "exact_ratio",
        "partial_ratio",
        F.when(F.col("b"), 1.0).when(F.col("o"), 0.0).otherwise(score).alias("score"),
    )


# -- rows paired one to one -------------------------------------------------


def _paired(candidate, expected, shared, block_by, order_by, group_rows, rows=False) -> DataFrame:
    """Each expected row beside the candidate row of the same block and place.

    The place is the row's number within its block; with a block key that is
    unique on both sides it is always the first.
    """
    blocks = [f"b{i}" for i in range(len(block_by))]
    order = [f"__o{i}" for i in range(len(order_by))]

    def side(df, name):
        require_columns(df, [*block_by, *order_by])
        keys = [F.coalesce(canonical(F.col(b), df.schema[b].dataType), F.lit("\0")) for b in block_by]
        table = df.select(
            *[k.alias(n) for k, n in zip(keys, blocks)],
            F.struct(F.lit(1).alias("is_row"), *_cells(df, shared)).alias(name),
            *[F.col(o).alias(n) for o, n in zip(order_by, order)],
            *([F.struct(*shared).alias(f"{name}_row")] if rows else []),
            F.lit(1).alias("one"),
        )
        return running_sum(table, "one", order, blocks, name="place", group_rows=group_rows, ties=[name]).drop("one")

    return side(expected, "e").join(side(candidate, "c").drop(*order), [*blocks, "place"], "left")


def _similarity(shared) -> Column:
    if not shared:
        return F.when(F.col("c").isNotNull(), 1.0).otherwise(0.0)
    equal = sum((F.col(f"e.c{i}").eqNullSafe(F.col(f"c.c{i}")).cast("int") for i in range(len(shared))), F.lit(0))
    return F.when(F.col("c").isNotNull(), equal / len(shared)).otherwise(0.0)


def _by_similarity(candidate, expected, shared, block_by, order_by, small) -> Column:
    """Scalar subquery: the summed similarity of pairs fixed most similar first."""
    order = [f"o{i}" for i in range(len(order_by))]

    def side(df, name):
        require_columns(df, [*block_by, *order_by])
        text = lambda cells: F.array(*[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in cells]).cast("array<string>")
        place = F.struct(*[F.col(o).alias(n) for o, n in zip(order_by, order)], F.lit(0).alias("last"))
        return df.select(
            text([canonical(F.col(b), df.schema[b].dataType) for b in block_by]).alias("block"),
            text(_cells(df, shared)).alias("cells"),
            *[(F.lit(int(s == name)).cast("long")).alias(s) for s in "ce"],
            place.alias(f"{name}_place"),
        )

    both = side(candidate, "c").unionByName(side(expected, "e"), allowMissingColumns=True)
    sides = both.groupBy("block", "cells").agg(*[F.sum(s).alias(s) for s in "ce"], *[F.min(f"{s}_place").alias(f"{s}_place") for s in "ce"])
    return equal_cells(sides, max(1, len(shared)), small) / F.lit(max(1, len(shared)))


def blended_match(
    candidate: DataFrame,
    expected: DataFrame,
    block_by,
    order_by,
    group_rows: int = GROUP_ROWS,
    pair_by: str = "place",
    columns=None,
    small: int = SMALL,
) -> DataFrame:
    """0.55 x equal rows + 0.25 x similarity of pairs + 0.10 x columns + 0.10 x row count.

    Similarity is over the shared columns; rows pair one to one within
    `block_by`: by their `place` in the given order, or by `similarity`, the
    most similar first and of those the first in order (see plans.pairing;
    that search runs jobs while this is built). `columns` are those that are
    compared, all by default; blocks and order may be others.
    """
    if pair_by not in ("place", "similarity"):
        raise SpecError(f"pair_by must be place or similarity, not {pair_by!r}")
    sets = {k: [c for c in v if columns is None or c in columns] for k, v in column_sets(candidate, expected).items()}
    shared = sets["shared"]
    wrong = bool(sets["missing"] or sets["extra"])
    wanted = len(shared) + len(sets["missing"])
    column_share = len(shared) / wanted if wanted else 1.0
    overlap = multiset_overlap(candidate, expected, shared) if shared else candidate.agg(F.count(F.lit(1)).alias("candidate_rows")).select(
        F.least("candidate_rows", expected.agg(F.count(F.lit(1)).alias("n")).scalar()).alias("shared_rows"),
        "candidate_rows",
        expected.agg(F.count(F.lit(1)).alias("n")).scalar().alias("expected_rows"),
    )
    if pair_by == "similarity":
        pair_total = _by_similarity(candidate, expected, shared, list(block_by), list(order_by), small)
    else:
        pairs = _paired(candidate, expected, shared, list(block_by), list(order_by), group_rows)
        pair_total = pairs.agg(_total(_similarity(shared)).alias("s")).scalar()
    e, c = F.col("expected_rows"), F.col("candidate_rows")
    rows = F.greatest(e, F.lit(1))
    parts = overlap.select(
        e,
        c,
        (F.col("shared_rows") / rows).alias("exact_row_match_score"),
        (pair_total / rows).alias("partial_match"),
        closeness(c, e).alias("row_count_score"),
    )
    score = clamp(
        0.55 * F.col("exact_row_match_score")
        + 0.25 * F.col("partial_match")
        + F.lit(0.10 * column_share)
        + 0.10 * F.col("row_count_score")
    )
    both, neither = (e == 0) & (c == 0), (e == 0) | (c == 0)

    def settled(value, if_both):
        return F.when(both, if_both).when(neither, F.lit(0.0)).otherwise(F.round(value, 6))

    names = {k: F.array(*[F.lit(x) for x in sets[k]]).cast("array<string>") for k in ("missing", "extra")}
    return parts.select(
        settled(score, 1.0).alias("score"),
        F.when(both, True)
        .when(neither, False)
        .otherwise(F.lit(not wrong) & (e == c) & (F.col("exact_row_match_score") >= 1))
        .alias("exact_match"),
        settled(F.col("partial_match"), 1.0).alias("partial_match"),
        F.lit(wrong).alias("wrong_columns"),
        names["missing"].alias("missing_columns"),
        names["extra"].alias("extra_columns"),
        e.alias("row_count_expected"),
        c.alias("row_count_actual"),
        settled(F.col("row_count_score"), 1.0).alias("row_count_score"),
        settled(F.col("exact_row_match_score"), 1.0).alias("exact_row_match_score"),
        settled(F.lit(column_share), 1.0).alias("column_match_score"),
    )


def row_comparisons(
    candidate: DataFrame, expected: DataFrame, block_by, order_by, n: int = 20, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """The first n expected rows beside their partners, for display."""
    shared = column_sets(candidate, expected)["shared"]
    pairs = _paired(candidate, expected, shared, list(block_by), list(order_by), group_rows, rows=True)
    order = [f"__o{i}" for i in range(len(order_by))]
    shown = pairs.orderBy(*order, "place").limit(n)
    index = F.row_number().over(Window.orderBy(*order, "place")) - 1
    return shown.select(
        index.alias("expected_index"),
        F.round(_similarity(shared), 4).alias("similarity"),
        F.to_json("e_row").alias("expected_row"),
        F.to_json("c_row").alias("candidate_row"),
    )


# -- grouped measures -------------------------------------------------------


def _key_cells(df: DataFrame, keys) -> list[Column]:
    return [F.upper(strip(as_text(F.col(k), df.schema[k].dataType))).alias(f"k{i}") for i, k in enumerate(keys)]


def _met(candidate: DataFrame, expected: DataFrame, n_keys: int, n_measures: int, combine) -> DataFrame:
    """Both sides' measures a0.. and e0.. per key, by one aggregation; a, e count the rows."""
    keys = [f"k{i}" for i in range(n_keys)]

    def side(df, mine, other):
        return df.select(
            *keys,
            *[F.col(f"m{i}").alias(f"{mine}{i}") for i in range(n_measures)],
            *[F.lit(None).cast("bigint").alias(f"{other}{i}") for i in range(n_measures)],
            F.lit(1).alias(mine),
            F.lit(0).alias(other),
        )

    both = side(candidate, "a", "e").unionByName(side(expected, "e", "a"))
    return both.groupBy(*keys).agg(
        *[combine(f"{s}{i}").alias(f"{s}{i}") for s in "ae" for i in range(n_measures)],
        F.sum("a").alias("a"),
        F.sum("e").alias("e"),
    )


def _measured(df: DataFrame, keys, measures, unreadable=None) -> DataFrame:
    """Normalised keys and whole measures. Rows without either are left out,
    unless a value for unreadable measures says to keep them all."""
    require_columns(df, [*keys, *measures])
    values = [to_whole(F.col(m), df.schema[m].dataType, "trunc") for m in measures]
    cells = _key_cells(df, keys)
    if unreadable is not None:
        values = [F.coalesce(v, F.lit(unreadable)) for v in values]
        cells = [F.coalesce(c, F.lit("<NA>")).alias(f"k{i}") for i, c in enumerate(cells)]
    rows = df.select(*cells, *[v.alias(f"m{i}") for i, v in enumerate(values)]).dropna()
    if unreadable is None:
        for i in range(len(keys)):
            rows = rows.filter(F.col(f"k{i}") != "")
    return rows


def _last_per_key(rows: DataFrame, n_keys: int, n_measures: int) -> DataFrame:
    """Of rows whose keys became equal keep the one with the largest measures."""
    return first_per_key(rows, [f"k{i}" for i in range(n_keys)], [f"m{i}" for i in range(n_measures)], keep="last")


def grouped_measure_accuracy(candidate: DataFrame, expected: DataFrame, keys, measure: str) -> DataFrame:
    """Mean closeness of one measure over all keys of both sides; a missing key counts 0.

    Rows whose normalised keys collide are added up.
    """
    keys = list(keys)
    met = _met(_measured(candidate, keys, [measure]), _measured(expected, keys, [measure]), len(keys), 1, F.sum)
    actual, wanted = F.coalesce("a0", F.lit(0)), F.coalesce("e0", F.lit(0))
    totals = met.agg(
        F.count(F.lit(1)).alias("keys"),
        F.avg(closeness(actual, wanted)).alias("mean"),
        F.count_if(F.col("a") > 0).alias("a"),
        F.count_if(F.col("e") > 0).alias("e"),
    )
    score = F.when(F.col("keys") == 0, 1.0).when((F.col("a") == 0) | (F.col("e") == 0), 0.0).otherwise(F.col("mean"))
    return totals.select("keys", score.alias("accuracy"))


def expected_measure_match(candidate: DataFrame, expected: DataFrame, keys, measure: str) -> DataFrame:
    """0.75 x closeness over the expected keys + 0.15 x number of keys + 0.10 x columns.

    Unreadable measures count as 0, and a missing key is a key of its own.
    """
    keys = list(keys)
    required = [*keys, measure]
    column_share = len([c for c in required if c in candidate.columns]) / len(required)
    counted = expected.agg(F.count(F.lit(1)).alias("e"))
    if column_share < 1:
        counted = counted.withColumn("a", candidate.agg(F.count(F.lit(1)).alias("n")).scalar())
        fallback = (
            F.when((F.col("e") == 0) & (F.col("a") == 0), 1.0)
            .when(F.col("e") == 0, 0.0)
            .otherwise(F.lit(0.1 * column_share))
        )
        return counted.select(F.lit(0.0).alias("match"), fallback.alias("score"))
    sides = [_last_per_key(_measured(df, keys, [measure], 0), len(keys), 1) for df in (candidate, expected)]
    met = _met(*sides, len(keys), 1, F.max)
    close = F.when(F.col("a") == 0, 0.0).otherwise(closeness(F.col("a0"), F.col("e0")))
    totals = met.agg(
        F.coalesce(F.avg(F.when(F.col("e") > 0, close)), F.lit(0.0)).alias("match"),
        F.count_if(F.col("a") > 0).alias("a"),
        F.count_if(F.col("e") > 0).alias("e"),
    )
    score = clamp(
        0.75 * F.col("match") + 0.15 * closeness(F.col("a"), F.col("e")) + F.lit(0.10 * column_share)
    )
    empty = F.when((F.col("e") == 0) & (F.col("a") == 0), 1.0).when(F.col("e") == 0, 0.0)
    return totals.select("match", empty.otherwise(score).alias("score"))


def multi_measure_accuracy(candidate: DataFrame, expected: DataFrame, keys, measures) -> DataFrame:
    """0.85 x mean closeness of all measures over all keys + 0.15 x number of keys.

    A key that only one side has counts 0; no readable candidate row gives 0.
    """
    keys, measures = list(keys), list(measures)
    sides = [_last_per_key(_measured(df, keys, measures), len(keys), len(measures)) for df in (candidate, expected)]
    met = _met(*sides, len(keys), len(measures), F.max)
    close = sum((closeness(F.col(f"a{i}"), F.col(f"e{i}")) for i in range(len(measures))), F.lit(0.0)) / len(measures)
    on_both = (F.col("a") > 0) & (F.col("e") > 0)
    totals = met.agg(
        F.coalesce(F.avg(F.when(on_both, close).otherwise(0.0)), F.lit(0.0)).alias("mean"),
        F.count_if(F.col("a") > 0).alias("a"),
        F.count_if(F.col("e") > 0).alias("e"),
    )
    score = F.round(0.85 * F.col("mean") + 0.15 * closeness(F.col("a"), F.col("e")), 6)
    return totals.select("mean", F.when(F.col("a") == 0, 0.0).otherwise(score).alias("score"))
