"""Drop rows far from the mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import check, require_columns
from ..functions.values import try_num
from .joins import attach
from .ordered import GROUP_ROWS


def _bounds(number: Column, n_std: float) -> list[Column]:
    mean, spread = F.avg(number), F.stddev_pop(number)
    usable = F.when(spread > 0, spread)
    return [(mean - n_std * usable).alias("low"), (mean + n_std * usable).alias("high"), mean.alias("mean")]


def remove_outliers(
    df: DataFrame, column: str, n_std: float = 3, partition_by=(), group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Keep rows within n_std population standard deviations of the mean.

    Bounds are inclusive. Rows without a number are kept, and so is everything
    when all numbers are equal. With `partition_by` each group has its own
    bounds; they come from an aggregate joined back, since a window would pull
    a whole group into one task.
    """
    partition_by = list(partition_by)
    require_columns(df, [column, *partition_by])
    check("remove_outliers", n_std=(n_std, "above zero"))
    n_std = float(n_std)
    number = try_num(F.col(column), df.schema[column].dataType)

    def inside(low, high):
        return number.isNull() | low.isNull() | number.between(low, high)

    if not partition_by:
        stats = df.agg(*_bounds(number, n_std)).select(
            F.when(
                F.col("mean").isNull(),
                F.raise_error(F.lit(f"remove_outliers: column '{column}' has no numeric values")).cast(
                    "struct<low:double,high:double>"
                ),
            )
            .otherwise(F.struct("low", "high"))
            .alias("stats")
        )
        return df.filter(inside(stats.scalar()["low"], stats.scalar()["high"]))

    stats = df.groupBy(*partition_by).agg(
        *[b.alias(f"__{n}") for b, n in zip(_bounds(number, n_std), ("low", "high"))],
        F.count(F.lit(1)).alias("__rows"),
    )
    bounded = attach(df, stats, partition_by, "__rows", group_rows)
    return bounded.filter(inside(F.col("__low"), F.col("__high"))).select(*df.columns)
