"""Streams: operations that look at one row at a time, dedupe, feeds with precedence, windowed reports.

What needs several rows is kept per event-time window and given out once, in append mode, when the
watermark has passed the window: what comes out equals the batch result over the same rows, as long as no
row is later than `delay`. Later rows are left out and counted (`late_rows`). A restart from the
query's checkpoint goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import SpecError, require_columns
from ..functions.values import as_text, strip
from ..operators.ordered import row_hash
from ..operators.recipe import clean, is_row_local, parse_operations
from ..plans.conform import Feed, bucketed_feeds, conformed
from ..plans.reports import capacity, occupancy_measures


def clean_stream(df: DataFrame, operations, null_like=()) -> DataFrame:
    """clean() for a streaming frame; operations over the whole table are refused."""
    for name, params in parse_operations(operations):
        if not is_row_local(name, params):
            raise SpecError(f"'{name}' needs the whole table and cannot run on a stream")
    return clean(df, operations, null_like=null_like)


def first_arrivals(df: DataFrame, columns, time_column: str, delay: str) -> DataFrame:
    """Keep the first row to arrive per key; a key is remembered for `delay`."""
    require_columns(df, [*columns, time_column])
    return df.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(list(columns))


def conform_stream(feeds: list[Feed], reference, delay: str, units=None, minutes: int = 10, active_days: int = 7, windows: bool = False) -> DataFrame:
    """conform_feeds() for streams: one conformed row per unit, bed and time bucket.

    The earlier feed wins although its row may arrive later, up to `delay` behind the latest time seen.
    The state holds one row per open unit, bed and bucket. With `windows` the bucket is kept as
    `window`, for further windows over it.
    """
    rows, order = bucketed_feeds(feeds, units, minutes)
    rows = rows.withColumn("__tie", row_hash(rows)).withWatermark("__at", delay)
    told = ["source_system", "source_record_id", "__prefix"]
    first = F.min(F.struct(*order, "__tie", F.col("__at").alias("at"), *told)).alias("first")
    kept = rows.groupBy(F.window("__at", f"{minutes} minutes"), "icu_unit", "__bed").agg(first)
    kept = kept.select("window", "icu_unit", "__bed", F.col("first.at").alias("__at"), *[f"first.{c}" for c in told])
    return conformed(kept, reference, active_days, *(["window"] if windows else []))


def capacity_stream(feeds: list[Feed], beds: DataFrame, reference, delay: str, window: str, unit: str = "unit", **how) -> DataFrame:
    """Occupancy against capacity for each unit with patients, per window of admission buckets.

    `beds` is a table. The conformed rows of a window are counted when both watermarks have passed it.
    """
    rows = conform_stream(feeds, reference, delay, windows=True, **how)
    counted = rows.groupBy(F.window(F.window_time("window"), window).alias("window"), "icu_unit").agg(*occupancy_measures())
    joined = counted.join(capacity(beds, unit), "icu_unit", "left")
    return joined.select(
        F.col("window.start").alias("window_start"),
        "icu_unit",
        "current_occupancy",
        F.coalesce("total_capacity", F.lit(0)).alias("total_capacity"),
        "active_count",
    )


def windowed_counts(df: DataFrame, key: str, time_column: str, delay: str, window: str, name: str = "rows") -> DataFrame:
    """Rows per window and normalised key (stripped, upper case), such as admissions per ward."""
    require_columns(df, [key, time_column])
    told = F.upper(strip(as_text(F.col(key), df.schema[key].dataType))).alias(key)
    counted = df.select(told, time_column).withWatermark(time_column, delay).groupBy(F.window(time_column, window), key).agg(F.count(F.lit(1)).alias(name))
    return counted.select(F.col("window.start").alias("window_start"), key, name)


def late_rows(query: StreamingQuery) -> int:
    """State rows that came after their window was given out, in the batches that Spark still reports.

    Spark sums up a batch's rows per window and key within each task before it looks at the
    watermark, so rows that agree in these and came together count once.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
