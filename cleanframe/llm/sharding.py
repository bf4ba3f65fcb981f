"""Sharding by sampled splitters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import stored

SEED = "shard-1"
#: Sampled keys per range.
SAMPLES = 24
#: Ranges hold about so many bytes of text, and there are several of them in a shard.
RANGE_BYTES = 256 << 20
RANGES_IN_A_SHARD = 8
#: A range over so many times the aim is subdivided.
OVERFULL = 2.0


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _search(key: Column, splitters: Column) -> Column:
    """How many of the sorted `splitters` are <= key, in two steps of about sqrt(n) comparisons."""
    n = F.size(splitters)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    block = F.size(
        F.filter(F.sequence(F.lit(1), n, step), lambda i: F.get(splitters, i - 1) <= key)
    )  # blocks whose first splitter isn't above the key
    return F.when(n == 0, F.lit(0)).when(block == 0, F.lit(0)).otherwise(
        (block - 1) * step + F.size(F.filter(F.slice(splitters, (block - 1) * step + 1, step), lambda s: s <= key))
    )


def _picked(keyed: DataFrame, rate: Column, seed: str) -> DataFrame:
    """Rows drawn with a chance of size * rate, by a seeded hash of the key."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "__key"), F.lit(1 << 53)) / float(1 << 53)
    return keyed.filter(draw < F.col("__size") * rate)


def _ranged(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds `__range`, the number of cuts up to the key. All cuts travel as one value to each task."""
    cuts = cuts.agg(F.array_sort(F.collect_list("__key")).alias("cuts")).scalar()
    # bound once: the plan, which the driver keeps several times, would repeat the subquery at every use
    bound = F.transform(F.array(F.col("__cuts")), lambda found: _search(F.col("__key"), found))[0]
    return keyed.withColumn("__cuts", cuts).withColumn("__range", bound).drop("__cuts")


def splitters(keyed: DataFrame, ranges: int, samples: int = SAMPLES, seed: str = SEED, rounds: int = 3) -> DataFrame:
    """The keys (`__key`) that cut (__key, __size) into ranges of about equal size.

    A sample weighted by size, of about `samples` keys per range, gives the quantiles. The ranges
    are then measured over all rows; inside those over OVERFULL times the aim, a denser sample
    gives further cuts, at most `rounds` times. Rows with one and the same key can't be cut apart.
    There are about `ranges` cuts, a number that the caller chooses.
    """
    total = keyed.agg(F.sum("__size")).first()[0] or 0
    aim = max(total / ranges, 1)

    def every(sample: DataFrame, step: int, order: W) -> DataFrame:
        numbered = sample.select("__key", F.row_number().over(order).alias("i"))
        return numbered.filter(F.col("i") % step == 0).select("__key").distinct()

    cuts = stored(every(_picked(keyed, F.lit(samples / aim), seed), samples, W.orderBy("__key")))
    for turn in range(1, rounds + 1):
        in_range = _ranged(keyed, cuts)
        # whether a range has several keys is told by their hashes, which are summed up without sorting all rows
        measured = in_range.select("__range", "__size", F.xxhash64("__key").alias("hash")).groupBy(F.col("__range").alias("__full")).agg(
            F.sum("__size").alias("bytes"), F.min("hash").alias("lowest"), F.max("hash").alias("highest")
        )
        full = stored(measured.filter((F.col("bytes") > OVERFULL * aim) & (F.col("lowest") < F.col("highest"))).select("__full"))
        if full.isEmpty():
            break
        dense = in_range.join(full, F.col("__range") == F.col("__full"), "left_semi")
        inside = W.partitionBy("__range").orderBy("__key")
        picked = _picked(dense, F.lit(samples / aim * 2**turn), f"{seed}:{turn}")
        cuts = stored(cuts.union(every(picked, samples, inside)).distinct())
    return cuts


def shard(
    docs: DataFrame,
    n_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    range_bytes: int = RANGE_BYTES,
    samples: int = SAMPLES,
    seed: str = SEED,
) -> DataFrame:
    """All rows with `size`, `text_crc32`, `law`, `shard`, `slot` and `grown_shard`.

    Law `bytes`: shards are consecutive ranges of the key (CRC-32 of the text, id, hash of the row)
    whose sizes differ from the mean by no more than the largest document. `slot` numbers a
    shard's rows along the key from 0; equal texts lie next to each other, and a large group of
    them goes on in the next shard.

    Sampled splitters cut the key into several ranges per shard, none over `range_bytes` by much.
    Each range is sorted in a task of its own and summed up; one row per range then tells where
    the range begins among all bytes and rows, which places every row exactly, whatever the
    sample was. Shards are cut there, not at the splitters.

    Null text has no bytes, size 16 and CRC-32 null; null ids sort first. Rows that repeat in all
    columns are interchangeable. An empty table gives an empty result; with fewer rows than shards
    some shards stay empty. Columns named like the new ones are replaced; all others are kept.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in docs.columns if c not in added or c in (id_col, text_col)]
    text, crc = F.col(text_col), F.crc32(F.col(text_col).cast("binary"))
    hashed = [F.col(c) for c, kind in docs.dtypes if c in kept and c not in (id_col, text_col) and "map<" not in kind]
    spread = F.xxhash64(*hashed, F.lit(seed))
    rows = docs.select(
        *kept,
        F.struct(crc.alias("crc"), F.col(id_col).alias("id"), spread.alias("row")).alias("__key"),
        size_of(text).alias("__size"),
    )
    keyed = stored(rows.select("__key", "__size"))
    total = keyed.agg(F.sum("__size")).first()[0] or 0
    cuts = splitters(keyed, max(RANGES_IN_A_SHARD * n_shards, math.ceil(total / range_bytes)), samples, seed)

    def ranged(df: DataFrame) -> DataFrame:
        within = W.partitionBy("__range").orderBy("__key").rowsBetween(W.unboundedPreceding, -1)
        return _ranged(df, cuts).withColumns(
            {"__bytes": F.coalesce(F.sum("__size").over(within), F.lit(0)), "__n": F.coalesce(F.count("*").over(within), F.lit(0))}
        )

    ranges = _ranged(keyed, cuts).groupBy("__range").agg(F.sum("__size").alias("b"), F.count("*").alias("c"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = stored(
        ranges.select(
            F.col("__range").alias("__r"),
            F.coalesce(F.sum("b").over(before), F.lit(0)).alias("__b0"),
            F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__c0"),
        )
    )

    def cut(df: DataFrame) -> DataFrame:
        # one row per range
        at = ranged(df).join(starts, F.col("__range") == F.col("__r"))
        middle = F.col("__b0") + F.col("__bytes") + F.col("__size") / 2
        return at.withColumn("__shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / max(total, 1))).cast("int")).withColumn(
            "__row", F.col("__c0") + F.col("__n")
        )

    # at most n_shards rows
    first = stored(cut(keyed).groupBy(F.col("__shard").alias("__s")).agg(F.min("__row").alias("__first")))
    return cut(rows).join(F.broadcast(first), F.col("__shard") == F.col("__s")).select(
        *kept,
        F.col("__size").alias("size"),
        F.col("__key.crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        (F.col("__row") - F.col("__first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
