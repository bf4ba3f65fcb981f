"""Bring differing feeds into one schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..errors import SpecError, require_columns
from ..functions.values import bed_label, computed, mixed_timestamp, recent, strip, time_bucket
from ..operators.columns import map_values
from ..operators.dedupe import first_per_key

# The ward codes of the second feed and the units they stand for.
WARD_CODE_UNITS = {
    "MICU": "ICU_MEDICAL",
    "M-ICU": "ICU_MEDICAL",
    "SICU": "ICU_SURGICAL",
    "SURG-ICU": "ICU_SURGICAL",
    "CCU": "ICU_CARDIAC",
    "CARD-ICU": "ICU_CARDIAC",
    "NCCU": "ICU_NEURO",
    "NEURO-ICU": "ICU_NEURO",
}
ICU_UNITS = sorted(set(WARD_CODE_UNITS.values()))


def tagged_union(feeds: dict[str, DataFrame], tag: str = "source_table") -> DataFrame:
    """Stack feeds with different columns; columns of one name but several types become text."""
    if not feeds:
        raise SpecError("tagged_union needs at least one feed")
    kinds: dict[str, set] = {}
    for df in feeds.values():
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = [n for n, k in kinds.items() if len(k) > 1]

    def shaped(name, df):
        df = df.withColumns({n: F.col(n).cast("string") for n in mixed if n in df.columns})
        return df.select(F.lit(name).alias(tag), *df.columns)

    parts = [shaped(name, df) for name, df in feeds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def known_parents(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose stripped key is not empty and occurs among the parents.

    The join's inputs are plain shuffles, so that adaptive execution can
    broadcast a small parent table or split a hot child key.
    """
    keys, key = _parent_keys(parents, parent_key), strip(F.col(child_key))
    return children.filter(key != "").join(keys, on=key == F.col("__parent"), how="left_semi")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The rows known_parents() would drop."""
    keys, key = _parent_keys(parents, parent_key), F.coalesce(strip(F.col(child_key)), F.lit(""))
    without = children.filter(key == "")  # these must not meet in one task of the join
    return children.filter(key != "").join(keys, on=key == F.col("__parent"), how="left_anti").unionByName(without)


def _parent_keys(parents: DataFrame, parent_key: str) -> DataFrame:
    require_columns(parents, [parent_key])
    return parents.select(strip(F.col(parent_key)).alias("__parent")).filter(F.col("__parent") != "")


def look_up(df: DataFrame, column: str, codes, code: str = "code", value: str = "value") -> DataFrame:
    """Translate codes by a dict or by a table unique in `code`; unknown codes become "".

    No join hint is given for a table: Spark broadcasts it if it measures small.
    """
    if isinstance(codes, dict):
        return map_values(df, column, codes, default="").withColumn(column, F.coalesce(column, F.lit("")))
    table = codes.select(F.col(code).alias("__code"), F.col(value).alias("__value"))
    joined = df.join(table, on=F.col(column) == F.col("__code"), how="left")
    return joined.withColumn(column, F.coalesce("__value", F.lit(""))).select(*df.columns)


@dataclass
class Feed:
    """How one source maps onto the common schema. Earlier feeds win duplicates."""

    name: str
    table: DataFrame
    prefix: str
    record_id: str
    unit: str
    bed: str
    admitted: str
    order_by: str
    codes: object = None
    formats: list[str] | None = None
    code_columns: tuple[str, str] = ("ward_code", "icu_unit")


def _shape(feed: Feed, rank: int) -> DataFrame:
    df = feed.table
    require_columns(df, [feed.record_id, feed.unit, feed.bed, feed.admitted, feed.order_by])
    admitted_type = df.schema[feed.admitted].dataType
    shaped = computed(
        df,
        F.lit(rank).alias("__rank"),
        F.col(feed.order_by).alias(f"__order{rank}"),
        F.lit(feed.prefix).alias("__prefix"),
        F.lit(feed.name).alias("source_system"),
        F.coalesce(F.col(feed.record_id).cast("string"), F.lit("")).alias("source_record_id"),
        F.coalesce(strip(F.col(feed.unit)), F.lit("")).alias("icu_unit"),
        bed_label(F.coalesce(F.col(feed.bed).cast("string"), F.lit(""))).alias("__bed"),
        mixed_timestamp(F.col(feed.admitted), feed.formats, admitted_type, digits=r"^\d+$").alias("__at"),
    )
    if feed.codes is None:
        return shaped
    return look_up(shaped, "icu_unit", feed.codes, *feed.code_columns)


def bucketed_feeds(feeds: list[Feed], units=None, minutes: int = 10) -> tuple[DataFrame, list[str]]:
    """The rows of all feeds with a known unit and a readable time, their bucket in `__bucket`, and
    the columns by which the rows of one unit, bed and bucket take precedence."""
    units = list(ICU_UNITS if units is None else units)
    shaped = [_shape(feed, rank) for rank, feed in enumerate(feeds)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shaped)
    rows = rows.filter(F.col("icu_unit").isin(units) & F.col("__at").isNotNull())
    rows = rows.withColumn("__bucket", time_bucket(F.col("__at"), minutes))
    return rows, ["__rank", *[f"__order{rank}" for rank in range(len(feeds))]]


def conformed(kept: DataFrame, reference, active_days: int = 7, *more: str) -> DataFrame:
    """The shape of conformed rows."""
    minute = F.date_trunc("minute", F.col("__at"))
    return kept.select(
        F.concat("__prefix", F.lit("-"), "source_record_id").alias("patient_uid"),
        "source_system",
        "source_record_id",
        "icu_unit",
        F.concat("__prefix", F.lit("-"), "__bed").alias("bed_number"),
        minute.alias("admitted_at"),
        F.when(recent(minute, reference, active_days), "active").otherwise("inactive").alias("status"),
        *more,
    )


def conform_feeds(feeds: list[Feed], reference, units=None, minutes: int = 10, active_days: int = 7) -> DataFrame:
    """One conformed row per unit, bed and time bucket.

    Copies collapse within and across feeds: the earlier feed wins, then the
    feed's own order. The bed compared is the one without the feed's prefix.
    Rows without a known unit or a readable time are dropped.
    """
    rows, order = bucketed_feeds(feeds, units, minutes)
    return conformed(first_per_key(rows, ["icu_unit", "__bed", "__bucket"], order), reference, active_days)
