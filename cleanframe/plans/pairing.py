"""One-to-one pairs of expected and candidate rows by similarity, inside blocks.

Pairs are fixed in one total order: most equal cells first, then the place of the expected row, then
that of the candidate. Equal rows of a side are one row with copies, at the place of the first, and a
pair takes as many copies as both still have. So the result depends on the rows alone, not on how
they are partitioned.

Rows that the other side has exactly are paired by counting. What is left of a block, if it has
few rows, is paired inside one expression. In larger blocks every round fixes the pairs that come first
in the order for both of their rows, which gives the same pairs, for many blocks and many pairs at a
time. Their rows are compared with one another, so that step grows with the square of what a
block's equal rows leave over: choose block keys that leave little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources import materialize
from .nearest import _shared

#: Pairs of a block that one expression handles.
SMALL = 4096


def _fold(expected: Column, candidate: Column) -> Column:
    """Equal cells in all pairs of a block, given (place, cells, copies) of both sides."""
    pairs = F.flatten(
        F.transform(
            expected,
            lambda e, i: F.transform(
                candidate,
                lambda c, j: F.struct((-_shared(e["cells"], c["cells"])).alias("less"), e["place"].alias("e"), c["place"].alias("c"), i.alias("i"), j.alias("j")),
            ),
        )
    )
    pairs = F.array_sort(F.filter(pairs, lambda p: p["less"] < 0))
    zero = F.struct(
        F.transform(expected, lambda e: e["copies"]).alias("e"), F.transform(candidate, lambda c: c["copies"]).alias("c"), F.lit(0).cast("long").alias("sum")
    )

    def step(at, pair):
        take = F.least(F.get(at["e"], pair["i"]), F.get(at["c"], pair["j"]))
        less = lambda copies, k: F.transform(copies, lambda n, m: F.when(m == k, n - take).otherwise(n))
        taken = F.struct(less(at["e"], pair["i"]).alias("e"), less(at["c"], pair["j"]).alias("c"), (at["sum"] - take * pair["less"]).alias("sum"))
        return F.when(take > 0, taken).otherwise(at)

    return F.aggregate(pairs, zero, step, lambda at: at["sum"])


def _rounds(rows: DataFrame) -> DataFrame:
    """The same for the rows of large blocks; a row for each pair fixed."""
    e = rows.filter("e > 0").select("block", F.col("cells").alias("p"), F.col("e_place").alias("p_place"), F.col("e").alias("le"))
    c = rows.filter("c > 0").select("block", F.col("cells").alias("q"), F.col("c_place").alias("q_place"), F.col("c").alias("lc"))
    less = -_shared(F.col("p"), F.col("q"))
    open_ = e.join(c, "block").select("block", F.struct(less.alias("less"), "p_place", "q_place", "p", "q").alias("key"), "le", "lc")
    open_, fixed = materialize(open_.filter("key.less < 0")), []
    while not open_.isEmpty():
        first_e = open_.groupBy("block", F.col("key.p").alias("p")).agg(F.min("key").alias("key")).select("block", "key")
        first_c = open_.groupBy("block", F.col("key.q").alias("q")).agg(F.min("key").alias("key")).select("block", "key")
        both = open_.join(first_e, ["block", "key"], "left_semi").join(first_c, ["block", "key"], "left_semi")
        taken = materialize(both.select("block", "key", F.least("le", "lc").alias("take")))
        fixed.append(taken)
        by = lambda side: taken.select(F.col("block").alias("b"), F.col(f"key.{side}").alias(side), F.col("take").alias(f"take_{side}"))
        for side, left in (("p", "le"), ("q", "lc")):
            told = by(side)
            met = (F.col("block") == F.col("b")) & (F.col(f"key.{side}") == told[side])
            rest = F.col(left) - F.coalesce(F.col(f"take_{side}"), F.lit(0))
            open_ = open_.join(told, met, "left").withColumn(left, rest).drop("b", side, f"take_{side}")
        open_ = materialize(open_.filter("le > 0 AND lc > 0"))
    pairs = rows.sparkSession.createDataFrame([], "sum long")
    for taken in fixed:
        pairs = pairs.unionByName(taken.select((F.col("take") * -F.col("key.less")).cast("long").alias("sum")))
    return pairs


def equal_cells(sides: DataFrame, width: int, small: int = SMALL) -> Column:
    """Scalar subquery: equal cells in all pairs of (block, cells, c, e, c_place, e_place).

    A row is one block and cells; `c` and `e` are its copies on both sides and the places those of the
    first. Runs jobs: large blocks are stored between rounds.
    """
    sides = materialize(sides)
    same = sides.agg(F.sum(F.least("c", "e")) * F.lit(width)).toDF("sum")
    both = F.least("c", "e")
    rest = materialize(sides.withColumns({"c": F.col("c") - both, "e": F.col("e") - both}).filter("c > 0 OR e > 0"))
    sizes = rest.groupBy("block").agg((F.count_if(F.col("e") > 0) * F.count_if(F.col("c") > 0)).alias("pairs"))
    few = rest.join(sizes.filter((F.col("pairs") > 0) & (F.col("pairs") <= small)).select("block"), "block", "left_semi")
    listed = lambda n: F.array_sort(F.collect_list(F.when(F.col(n) > 0, F.struct(F.col(f"{n}_place").alias("place"), "cells", F.col(n).alias("copies")))))
    folded = few.groupBy("block").agg(listed("e").alias("es"), listed("c").alias("cs")).select(_fold(F.col("es"), F.col("cs")).alias("sum"))
    parts = same.unionByName(folded)
    large = sizes.filter(F.col("pairs") > small).select("block")
    if not large.isEmpty():
        parts = parts.unionByName(_rounds(rest.join(large, "block", "left_semi")))
    return parts.agg(F.coalesce(F.sum("sum"), F.lit(0))).scalar()
