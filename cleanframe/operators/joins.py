"""A join against one row per key that stays balanced when a key is hot.

Spark's adaptive execution splits a skewed join only where both inputs come
straight from a shuffle. Where one side is an aggregate by the join key, as
here, the rows of a hot key would all meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordered import GROUP_ROWS, row_hash

SALTS = 1 << 20


def attach(left: DataFrame, right: DataFrame, keys, rows: str, group_rows: int = GROUP_ROWS, large: bool = False) -> DataFrame:
    """Left join on the key columns; null keys are equal. `right` has one row per
    key, and in its column `rows` how many rows of `left` carry the key. A hot
    key that has nothing to attach should be listed too, with nulls.

    The right rows of hot keys are broadcast: there are at most as many as
    left rows / group_rows. The rows they serve get a salt, so that they spread
    over all tasks instead of following their key through the shuffle. `large`
    says that `right` may be large whatever Spark expects: it is joined by sorting.
    """
    payload = [c for c in right.columns if c not in keys and c != rows]

    def named(side, suffix):
        return side.select(
            *[F.col(k).alias(f"__{suffix}_key{i}") for i, k in enumerate(keys)],
            *[F.col(c).alias(f"__{suffix}_{c}") for c in payload],
            F.lit(0 if suffix == "cold" else 1).alias(f"__{suffix}"),
        )

    def same(suffix):
        return [F.col(k).eqNullSafe(F.col(f"__{suffix}_key{i}")) for i, k in enumerate(keys)]

    hot = named(right.filter(F.col(rows) > group_rows), "hot")
    cold = named(right.filter(F.col(rows) <= group_rows), "cold")
    cold = cold.hint("merge") if large else cold
    salt = F.when(F.col("__hot") == 1, 1 + F.pmod(row_hash(left), F.lit(SALTS))).otherwise(0).alias("__salt")
    served = left.join(F.broadcast(hot), on=same("hot"), how="left").select("*", salt)
    joined = served.join(cold, on=[*same("cold"), F.col("__salt") == F.col("__cold")], how="left")
    return joined.select(*left.columns, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in payload])
