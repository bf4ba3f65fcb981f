"""The queries by name, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cleanframe.functions.values import computed
from cleanframe.sources import read_table, utc

from .dirt import for_spark

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one data folder, and dirty versions of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = utc(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    @staticmethod
    def dirty(table: DataFrame, columns: dict[str, str]) -> DataFrame:
        """The table with dirt put in, behind a barrier: like columns read from a
        file, the dirty cells are made once and not again in every filter."""
        return computed(table, *[F.expr(e) for e in for_spark(columns)])


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with the equal DuckDB SQL."""

    def register(build):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
