"""Keep one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..errors import SpecError, require_columns
from .ordered import row_hash


def first_per_key(df: DataFrame, keys, order_by, keep: str = "first") -> DataFrame:
    """Keep the first (or last) row of each key in the given order.

    Null keys form a group like any other. Rows that the order leaves tied are
    ordered by a hash of the whole row, so the outcome does not depend on how
    the table is partitioned. Spark turns `row_number() = 1` into a limit per
    key that already runs before the shuffle: of a hot key only one row per
    map task travels. Columns the caller does not need should be dropped first.
    """
    keys, order_by = list(keys), list(order_by)
    if not keys:
        raise SpecError("columns must be a non-empty list of column names")
    if not order_by:
        raise SpecError("an explicit order_by is required: Spark tables have no row order")
    if keep not in ("first", "last"):
        raise SpecError("keep must be 'first' or 'last'")
    require_columns(df, keys)
    require_columns(df, [c for c in order_by if isinstance(c, str)])
    marks = [F.col(c) if isinstance(c, str) else c for c in order_by] + [row_hash(df)]
    if keep == "last":
        marks = [m.desc() for m in marks]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*marks))
    return df.withColumn("__nth", nth).filter(F.col("__nth") == 1).drop("__nth")


def remove_duplicates(df: DataFrame, columns, order_by) -> DataFrame:
    return first_per_key(df, columns, order_by)
