"""Intermediate tables in the shared folder, and labels of connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from cleanframe.sources.tables import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the folder all executors share and read it from there.

    The plan behind it runs once, and a lost executor costs no recomputation of it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of `links` (a, b) reaches.

    Large-star and small-star rounds (Kiveris et al., 2014): each round attaches the neighbours
    of a node to the smallest node among them, so that every component ends as a star around its
    smallest node after about log(n) rounds; links that are stars already take none. A round
    aggregates with partial sums and joins one row per node back to the links, a join whose large
    keys Spark can split. Links may repeat, point at themselves or hold nulls; those say nothing.
    """
    star = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    )
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("tips"), F.max("v").alias("most"))
        least = stored(seen.select("u", F.least("u", "m").alias("m"), F.expr("tips > 1 or tips > 0 and most > u").alias("open")))
        if least.filter("open").isEmpty():  # all stars
            break
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        after = stored(large.join(lowest, "u").select(F.inline(ends)).filter("u != v").distinct())
        dropped(star, least, large, lowest)
        star = after
    dropped(star)
    labels = least.select(F.col("u").alias("node"), F.col("m").alias("label"))
    labels.stored_at = least.stored_at
    return labels
