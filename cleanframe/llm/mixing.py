"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Mix shards; each gets the same quotas.
SHARDS = 8
#: Blocks in a shard, at least; more sources get more blocks.
BLOCKS = 4096
#: Parts that a source's documents are counted in, so that no source is summed in one task.
PARTS = 256
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds `weight` and `target` to (source, source_size).

    Weights repeat along the sources by code point, null last. The targets share `share` times
    all sizes by weight; one that would pass `most` times its source's size stops there, and the
    excess goes to the rest by weight until none is above. That ends where every other source gets
    the same `level` per unit of weight. Sources stop in order of size per weight; the level that
    is left for the rest rises with each that rightly stops and falls with each that needn't, so it
    is the highest of all. Needs share <= most. Runs on one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighted = sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    )
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        F.sum("source_size").over(whole) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    ) / F.sum("weight").over(onward)
    return (
        weighted.withColumn("level", level)
        .withColumn("level", F.max("level").over(whole))
        .select(
            "source",
            "source_size",
            F.least(F.col("level") * F.col("weight"), F.col("source_size") * most).cast("double").alias("target"),
        )
    )


def quotas(wanted: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """Adds `quota` (blocks of the source in each shard) and `block_words` to (source, target).

    Sainte-Laguë: the blocks of a shard go one by one to the highest quotient target / (2k + 1),
    k being the blocks the source has. All seats but a few per source are certain, as a source's
    share of blocks + or - half a block per source bounds its seats on either side; only the
    quotients between these bounds are ranked, a number of rows in proportion to the sources. A
    block has the most words that leave `blocks` blocks in a shard, or one. Equal quotients go to the first source by code point.
    """
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n, total = F.count("*").over(whole), F.sum("target").over(whole)
    sized = wanted.withColumn("total", total).withColumn("n", n)
    least = F.greatest(F.lit(blocks).cast("long"), F.col("n") * 16)
    sized = sized.withColumn("block_words", F.greatest(F.lit(1), F.floor(F.col("total") / (least * shards))).cast("long"))
    sized = sized.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("total") / (F.col("block_words") * shards))).cast("long"))
    part = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    bounded = sized.withColumn("part", part).select(
        "*",
        F.greatest(F.lit(0), F.floor(F.col("part") * (F.col("blocks") - F.col("n") / 2) - 1)).cast("long").alias("low"),
        F.ceil(F.col("part") * (F.col("blocks") + F.col("n") / 2) + 1).cast("long").alias("high"),
    )
    seats = bounded.withColumn("open", F.col("blocks") - F.sum("low").over(whole)).filter("part > 0")
    ranked = seats.select("source", "low", "open", F.explode(F.sequence("low", "high")).alias("k"), "part").withColumn(
        "rank", F.row_number().over(W.orderBy((F.col("part") / (F.col("k") * 2 + 1)).desc(), F.col("source").asc_nulls_last()))
    )
    won = ranked.filter("rank <= open").groupBy(F.col("source").alias("__source")).agg(F.count("*").alias("won"))
    return bounded.join(won, F.col("source").eqNullSafe(F.col("__source")), "left").select(
        *[F.col(c) for c in wanted.columns],
        F.when(F.col("part") > 0, F.col("low") + F.coalesce("won", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("quota"),
        "block_words",
    )


def _key(id_col: str, text_col: str, seed: str) -> Column:
    whole = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return F.md5(whole)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    shards: int = SHARDS,
    blocks: int = BLOCKS,
    seed: str = SEED,
) -> DataFrame:
    """All rows with `size` (words), `source_size`, `target`, `quota`, `block_words` and `taken`.

    The documents of a source lie one after the other on a tape, in the order of a seeded md5 of
    id and text. The source's quota of blocks is taken from the head of the tape, round again up to
    `most` times; `taken` is how many words of the document that takes, repeats counted. At most
    one document of a source is taken in part.

    The tape is summed in `PARTS` parts of a source by the first md5 digits, so a source with a
    third of all rows meets in no task; the parts' own places come from one row per part.

    Null text has size 0 and is never taken. Null is a source of its own, the last. Rows without id
    count like others. Repeated rows lie next to each other and count each. An empty table gives an
    empty result; a table without any word gives targets and quotas of 0. Columns named like the
    new ones are replaced; all others are kept.
    """
    added = ("size", "source_size", "target", "quota", "block_words", "taken")
    rows = docs.drop(*[c for c in added if c not in (id_col, text_col, source_col)]).select(
        "*", n_words(F.col(text_col)).alias("size"), F.col(source_col).alias("__source"), _key(id_col, text_col, seed).alias("__key")
    )
    return placed(rows, weights, share, most, shards, blocks)


def placed(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """`mix` for rows that have `size`, `__source` and `__key` already."""
    part = F.conv(F.substring("__key", 1, 2), 16, 10).cast("int") % PARTS
    # one key without nulls, by which the rows are dealt out once for the sums and the join
    named = F.when(F.col("__source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("__source").cast("string")))
    rows = rows.withColumn("__part", part).withColumn("__group", F.concat_ws(":", named, "__part"))
    parts = rows.groupBy("__source", "__part", "__group").agg(F.sum("size").alias("part_size"))
    tape = W.partitionBy("__source").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        F.col("__source").alias("__s"),
        F.col("__group").alias("__g"),
        F.coalesce(F.sum("part_size").over(tape), F.lit(0)).alias("__before"),
    )
    sizes = parts.groupBy(F.col("__source").alias("source")).agg(F.sum("part_size").alias("source_size"))
    plan = quotas(targets(sizes, weights, share, most), shards, blocks)
    heads = starts.join(plan, F.col("__s").eqNullSafe(F.col("source"))).drop("source")
    inside = W.partitionBy("__group").orderBy("__key").rowsBetween(W.unboundedPreceding, -1)
    lying = rows.withColumn("__at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # one row per part, PARTS for each source
    lying = lying.join(heads, F.col("__group") == F.col("__g"))
    words = F.least(F.col("quota") * shards * F.col("block_words"), F.col("source_size") * most)
    rounds = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    start = F.col("__before") + F.col("__at")
    rest = words - rounds * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(start + F.col("size"), rest) - start)
    return lying.withColumn("taken", (rounds * F.col("size") + last).cast("long")).drop(
        "__source", "__key", "__part", "__at", "__before", "__s", "__group", "__g"
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The mixed documents, all columns: each row as often as `mix` takes it, parts rounded to whole documents."""
    rows = docs.select(
        F.struct(*docs.columns).alias("__doc"),
        n_words(F.col(text_col)).alias("size"),
        F.col(source_col).alias("__source"),
        _key(id_col, text_col, seed).alias("__key"),
    )
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    return placed(rows, **how).select("__doc", F.explode(F.array_repeat(F.lit(0), times))).select("__doc.*")
