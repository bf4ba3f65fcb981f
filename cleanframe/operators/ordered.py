"""Operators that need a total row order: forward fill and running sums.

A single ordered window would pull a whole table, or a whole hot group, into
one task. Instead the rows are cut into ranges of the order key, every range is
handled by its own task, and what one range hands to the next travels as one
extra row per range that sorts before the range's own rows.

The cut points are quantiles of a small key sample taken by hashing the key,
so every evaluation of the plan (also after a lost executor) cuts alike. They
only balance the work; results do not depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..errors import SpecError, require_columns
from ..functions.values import once

RANGE = "__range"
TIE = "__tie"
CARRY = "__is_row"

# A group with more rows than this is cut into ranges; smaller ones fit a task.
GROUP_ROWS = 4_000_000
# Sampled keys per range, and the most keys ever sampled.
SAMPLE_PER_RANGE = 32
SAMPLE_MAX = 500_000


def row_hash(df: DataFrame, columns=None) -> Column:
    """Hash of the row, to order rows that the given order leaves tied."""
    hashable = [
        f.name
        for f in df.schema.fields
        if (columns is None or f.name in columns) and not _holds_map(f.dataType)
    ]
    return F.xxhash64(*[F.col(c) for c in hashable]) if hashable else F.lit(0).cast("bigint")


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.VariantType))


def range_count(df: DataFrame) -> int:
    """Ranges to cut a table into: two per shuffle partition."""
    return max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _keyed(df: DataFrame, order_by, ties) -> tuple[DataFrame, list[str]]:
    """Add the order key: the order columns, and a hash of the tie columns if any."""
    require_columns(df, order_by)
    if not order_by:
        raise SpecError("an explicit order_by is required: Spark tables have no row order")
    ties = df.columns if ties is None else list(ties)
    keys = [F.col(c).alias(f"__key{i}") for i, c in enumerate(order_by)]
    if ties:
        keys.append(row_hash(df, ties).alias(TIE))
    names = [f"__key{i}" for i in range(len(order_by))] + ([TIE] if ties else [])
    return df.select("*", *keys), names


def _cuts(keyed: DataFrame, keys: list[str], ranges: int) -> Column:
    """Scalar subquery: the sorted cut points between the ranges."""
    resolution = 1 << 40
    sample = min(SAMPLE_MAX, SAMPLE_PER_RANGE * ranges)
    rows = keyed.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.greatest(rows, F.lit(1)))
    picked = keyed.select(F.struct(*keys).alias("key")).filter(
        F.pmod(F.xxhash64("key", F.lit("cut")), F.lit(resolution)) < share * resolution
    )
    ordered = picked.distinct().agg(F.sort_array(F.collect_list("key")).alias("keys"))
    at = F.sequence(F.lit(1), F.lit(ranges - 1))
    points = F.transform(at, lambda i: F.get("keys", F.floor(i * F.size("keys") / F.lit(ranges)).cast("int")))
    return ordered.select(F.filter(points, lambda p: p.isNotNull()).alias("cuts")).scalar()


def _with_range(table: DataFrame, cuts: Column, keys: list[str], ranges: int) -> DataFrame:
    """Add 1 + how many cut points lie at or before the row's key, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, (ranges - 1).bit_length())))])

    def search(key):
        def step_on(at, step):
            return F.when(key >= F.get("__cuts", at + step - 1), at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), step_on)

    found = once(F.struct(*keys), search)
    return table.withColumn("__cuts", cuts).withColumn(RANGE, found + 1).drop("__cuts")


def _ranged(df: DataFrame, order_by, partition_by, ranges, group_rows, ties) -> tuple[DataFrame, list[str]]:
    """Add the order keys and the range; rows of ordinary groups get range 0.

    `ranges` is how many to cut, or a column that already rises with the order.
    """
    require_columns(df, partition_by)
    keyed, keys = _keyed(df, order_by, ties)
    if isinstance(ranges, Column):
        return keyed.withColumn(RANGE, ranges), keys
    if ranges == 1:
        return keyed.withColumn(RANGE, F.lit(0)), keys
    ranges = ranges or range_count(df)
    if not partition_by:
        return _with_range(keyed, _cuts(keyed, keys, ranges), keys, ranges), keys
    # Bounded for broadcasting: at most rows / group_rows groups can be this big.
    hot = (
        df.groupBy(*[F.col(c).alias(f"__group{i}") for i, c in enumerate(partition_by)])
        .agg(F.count(F.lit(1)).alias("__rows"))
        .filter(F.col("__rows") > group_rows)
        .withColumn("__hot", F.lit(True))
        .drop("__rows")
    )
    same = [F.col(c).eqNullSafe(F.col(f"__group{i}")) for i, c in enumerate(partition_by)]
    marked = keyed.join(F.broadcast(hot), on=same, how="left").drop(*[f"__group{i}" for i in range(len(partition_by))])
    hot_rows = marked.filter("__hot")
    ranged = _with_range(marked, _cuts(hot_rows, keys, ranges), keys, ranges)
    return ranged.withColumn(RANGE, F.when(F.col("__hot"), F.col(RANGE)).otherwise(0)).drop("__hot"), keys


def _cut_rows(ranged: DataFrame, partition_by) -> DataFrame:
    """The rows of groups cut into ranges: all of them if there are no groups."""
    return ranged.filter(F.col(RANGE) > 0) if partition_by else ranged


def _one(ranges) -> bool:
    return not isinstance(ranges, Column) and ranges == 1


def _before(partition_by):
    return Window.partitionBy(*partition_by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _upto(partition_by, order_by):
    return (
        Window.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _with_carry(ranged: DataFrame, carry: DataFrame, partition_by, keys):
    rows = ranged.withColumn(CARRY, F.lit(1)).unionByName(
        carry.withColumn(CARRY, F.lit(0)), allowMissingColumns=True
    )
    return rows, _upto([*partition_by, RANGE], [CARRY, *keys])


def forward_fill(
    df: DataFrame,
    columns,
    order_by,
    partition_by=(),
    ranges: int | Column | None = None,
    group_rows: int = GROUP_ROWS,
    ties=None,
) -> DataFrame:
    """Replace each null by the last value before it in the given order.

    Leading nulls stay null. With `partition_by` values do not cross groups.
    ranges=1 is for tables or groups the caller knows to fit into one task.
    Rows the order leaves tied are ordered by a hash of the columns `ties`, all
    by default; () is for orders without ties.
    """
    columns, order_by, partition_by = list(columns), list(order_by), list(partition_by)
    require_columns(df, columns)
    if set(columns) & set(partition_by):
        raise SpecError("a column cannot be filled within groups of itself")
    ranged, keys = _ranged(df, order_by, partition_by, ranges, group_rows, ties)
    if _one(ranges):
        upto = _upto([*partition_by, RANGE], keys)
        return ranged.select(
            *[(F.last(c, ignorenulls=True).over(upto) if c in columns else F.col(c)).alias(c) for c in df.columns]
        )
    position = F.struct(*keys)
    # every range needs its row here, also one without any value
    last_in_range = (
        _cut_rows(ranged, partition_by)
        .groupBy(*partition_by, RANGE)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in columns])
    )
    carry = last_in_range.select(
        *partition_by, RANGE, *[F.last(c, ignorenulls=True).over(_before(partition_by)).alias(c) for c in columns]
    )
    rows, upto = _with_carry(ranged, carry, partition_by, keys)
    filled = [
        (F.last(c, ignorenulls=True).over(upto) if c in columns else F.col(c)).alias(c) for c in df.columns
    ]
    return rows.select(*filled, CARRY).filter(F.col(CARRY) == 1).drop(CARRY)


def running_sum(
    df: DataFrame,
    weight: str,
    order_by,
    partition_by=(),
    name: str = "running_sum",
    ranges: int | Column | None = None,
    group_rows: int = GROUP_ROWS,
    ties=None,
) -> DataFrame:
    """Add the sum of `weight` over all rows up to and including each row."""
    order_by, partition_by = list(order_by), list(partition_by)
    require_columns(df, [weight])
    ranged, keys = _ranged(df, order_by, partition_by, ranges, group_rows, ties)
    if _one(ranges):
        return ranged.select(*df.columns, F.sum(weight).over(_upto([*partition_by, RANGE], keys)).alias(name))
    sums = _cut_rows(ranged, partition_by).groupBy(*partition_by, RANGE).agg(F.sum(weight).alias("__add"))
    carry = sums.select(*partition_by, RANGE, F.sum("__add").over(_before(partition_by)).alias("__add"))
    rows, upto = _with_carry(ranged.withColumn("__add", F.col(weight)), carry, partition_by, keys)
    return (
        rows.select(*df.columns, F.sum("__add").over(upto).alias(name), CARRY).filter(F.col(CARRY) == 1).drop(CARRY)
    )
