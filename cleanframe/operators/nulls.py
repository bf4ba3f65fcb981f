"""Fill or drop missing cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..errors import check, require_columns
from ..functions.values import nullify, try_num
from .ordered import forward_fill, running_sum

STRATEGIES = ("drop", "mean", "median", "approximate_median", "mode", "forward_fill")
#: Size of a quantile sketch. A quantile's rank is off by 0.35 % of the rows at most, with a chance of 99 %.
SKETCH = 800


def _no_value(column: str, what: str) -> Column:
    return F.raise_error(F.lit(f"cannot fill column '{column}': it has no {what}"))


def _type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def exact_medians(df: DataFrame, columns) -> dict[str, Column]:
    """The exact medians of numeric columns out of one scalar subquery; null where a column is empty.

    Works on the histograms of all columns together, in one pass over the table: counts per column and
    value are combined before the shuffle, and the middles are found by one running sum along
    columns and values, which never sends a whole histogram through one task.
    """
    columns = list(columns)
    cells = [F.struct(F.lit(i).alias("which"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]
    counts = (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("which", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = running_sum(counts, "n", ["which", "value"], name="upto", ties=())
    # one row per column
    before = Window.orderBy("which").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("which").agg(F.sum("n").alias("total"))
    totals = totals.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0)))
    place = F.col("upto") - F.col("before")
    middle = upto.join(F.broadcast(totals), "which").groupBy("which").agg(
        F.min(F.when(place > F.floor((F.col("total") - 1) / 2), F.col("value"))).alias("low"),
        F.min(F.when(place > F.floor(F.col("total") / 2), F.col("value"))).alias("high"),
    )
    entry = F.struct("which", ((F.col("low") + F.col("high")) / 2).alias("median"))
    medians = middle.agg(F.map_from_entries(F.collect_list(entry)).alias("medians")).scalar()
    return {c: F.element_at(medians, F.lit(i)) for i, c in enumerate(columns)}


def exact_median(df: DataFrame, column: str) -> Column:
    """The exact median of one numeric column; see exact_medians."""
    return exact_medians(df, [column])[column]


def median_sketches(df: DataFrame, columns, by=(), size: int = SKETCH) -> DataFrame:
    """Quantile sketches (KLL) of numeric columns, one row per group of `by`.

    They can be stored, say per partition of a growing table, and merged later without reading the
    table again. A sketch has some 10 kB whatever the column holds. Missing cells don't count.
    """
    told = [F.kll_sketch_agg_double(F.when(~F.isnan(c), F.col(c)), F.lit(size)).alias(c) for c in columns]
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).groupBy(*by).agg(*told)


def merged_medians(sketches: DataFrame, columns) -> dict[str, Column]:
    """The columns' approximate medians from stored sketches, out of one scalar subquery; null where all are empty."""

    def median(c):
        merged = F.kll_merge_agg_double(c)
        return F.when(F.kll_sketch_get_n_double(merged) > 0, F.kll_sketch_get_quantile_double(merged, F.lit(0.5))).alias(c)

    found = sketches.agg(F.struct(*[median(c) for c in columns]).alias("medians")).scalar()
    return {c: found[c] for c in columns}


def _modes(df: DataFrame, columns) -> Column:
    """One struct with the most frequent value per column, the smallest if tied.

    One scan for all columns: grouping sets count every column on its own, with
    counts combined before the shuffle, so no task holds all distinct values.
    """
    slots = {c: f"__v{i}" for i, c in enumerate(columns)}
    values = df.select(*[F.col(c).alias(s) for c, s in slots.items()])
    if len(columns) == 1:
        counts = values.groupBy(*slots.values()).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("which", F.lit(0))
    else:
        counts = values.groupingSets([[s] for s in slots.values()], *slots.values()).agg(
            F.count(F.lit(1)).alias("n"), F.grouping_id().alias("which")
        )
    all_bits = (1 << len(columns)) - 1
    best = []
    for i, (c, s) in enumerate(slots.items()):
        which = 0 if len(columns) == 1 else all_bits & ~(1 << (len(columns) - 1 - i))
        rank = F.when((F.col("which") == which) & F.col(s).isNotNull(), F.struct(-F.col("n"), F.col(s)))
        best.append(F.min_by(s, rank).alias(c))
    return counts.agg(F.struct(*best).alias("modes")).scalar()


def fill_nulls(df: DataFrame, columns, strategy: str) -> DataFrame:
    """Fill with a statistic of the column, computed once for all columns."""
    if strategy == "mode":
        modes = _modes(df, columns)
        fills = {
            c: F.coalesce(c, F.coalesce(modes[c], _no_value(c, "mode").cast(_type(df, c)))) for c in columns
        }
        return df.withColumns(fills)
    numbers = df.withColumns({c: try_num(F.col(c), _type(df, c)) for c in columns})
    if strategy == "mean":
        means = numbers.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("means")).scalar()
        stats = {c: means[c] for c in columns}
    elif strategy == "approximate_median":
        stats = merged_medians(median_sketches(numbers, columns), columns)
    else:
        stats = exact_medians(numbers, columns)
    return numbers.withColumns(
        {c: F.coalesce(c, stats[c], _no_value(c, "numeric values").cast("double")) for c in columns}
    )


def fix_nulls(
    df: DataFrame, strategy: str, columns=None, null_like=(), order_by=(), partition_by=()
) -> DataFrame:
    """Drop rows with missing cells, or fill the cells.

    Missing are nulls, NaN and the texts in `null_like`, such as "" and "N/A".
    mean and median read the column as numbers, and other text counts as
    missing. approximate_median fills with a cell near the median (see SKETCH),
    in one pass without a shuffle of values. forward_fill needs `order_by`.
    """
    strategy = str(strategy).strip().lower()
    check("fix_nulls", strategy=(strategy, STRATEGIES))
    columns = list(df.columns if columns is None else columns)
    require_columns(df, columns)
    if null_like:
        df = df.withColumns({c: nullify(F.col(c), null_like, _type(df, c)) for c in columns})
    if not columns:
        return df
    floats = [c for c in columns if isinstance(_type(df, c), (T.DoubleType, T.FloatType))]
    if floats:
        df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
    if strategy == "drop":
        return df.dropna(subset=columns)
    if strategy == "forward_fill":
        return forward_fill(df, columns, order_by, partition_by)
    return fill_nulls(df, columns, strategy)
