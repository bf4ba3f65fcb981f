"""Near-duplicate vectors by a forest of random-projection trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import components, dropped, stored

#: Trees, vectors that a leaf may hold, and the part of a node's vectors on either side of a cut that go both ways.
TREES, LEAF, SPILL = 5, 200, 0.05
#: A cut's overlap reaches so many standard deviations of a linked pair's difference to either side. A
#: cut that sends more than the part WIDEST of a node one way parts links and saves little, so it isn't
#: made; after so many such directions in a row the node is a leaf.
REACH, WIDEST, NARROW = 0.34, 0.61, 3
#: A leaf that no cut makes smaller is compared in blocks of so many.
BLOCK = 1500
#: Cuts along a path at most; each halves a node, or a bit less.
DEPTH = 40
SEED = 7


def directions(tree: int, level: int, width: int) -> np.ndarray:
    """A random direction for all nodes of a level of a tree."""
    return np.random.default_rng([SEED, tree, level]).standard_normal(width)


def unit(vectors: pa.Array) -> np.ndarray:
    """The rows in double precision at length one. All have the same width."""
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _projected(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, widths = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            vectors = batch.column(batch.schema.get_field_index("vector"))
            out = np.zeros(batch.num_rows)
            for tree, width in {*zip(trees.tolist(), widths.tolist())}:
                some = np.flatnonzero((trees == tree) & (widths == width))
                out[some] = unit(vectors.take(pa.array(some))) @ directions(tree, level, width)
            rest = [i for i, f in enumerate(batch.schema) if f.name != "p"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array(out)], [*(batch.schema.field(i).name for i in rest), "p"]
            )

    return run


def _earlier(leaves: pa.ListArray, mine: int) -> np.ndarray:
    """A row's leaves that come before this one, as a matrix; what fills it up differs from row to row."""
    sizes = leaves.value_lengths().to_numpy(zero_copy_only=False)
    row, leaf = np.repeat(np.arange(len(leaves)), sizes), leaves.flatten().to_numpy(zero_copy_only=False)
    row, leaf = row[leaf < mine], leaf[leaf < mine]
    counts = np.bincount(row, minlength=len(leaves))
    width = int(counts.max(initial=0))
    # no leaf before this one is `mine` or more, so those numbers are free
    out = mine + np.tile(np.arange(len(leaves))[:, None], (1, width))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = leaf
    return out


def _linked(level: float):
    def run(table: pa.Table) -> pa.Table:
        """Links inside one leaf, or inside and between two blocks of one."""
        table = table.sort_by("node").combine_chunks()
        n = table.num_rows
        rows = unit(table.column("vector").chunk(0))
        weight = table.column("weight").to_numpy().astype(np.float64)
        nodes = table.column("node").to_pylist()
        block = table.column("block").to_numpy()
        both = block.min() != block.max()
        earlier = _earlier(table.column("leaves").chunk(0), table.column("leaf")[0].as_py())
        counts, links = np.zeros(n), []
        for lo in range(0, n, 512):
            near = rows[lo : lo + 512] @ rows.T >= level
            if both:
                near &= block[lo : lo + 512, None] != block[None, :]
            near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
            if earlier.shape[1]:
                ones, others = np.nonzero(near)
                for at in range(0, len(ones), 65536):  # a pair counts in the first leaf it shares
                    i, j = ones[at : at + 65536], others[at : at + 65536]
                    told = (earlier[lo + i][:, :, None] == earlier[j][:, None, :]).any(axis=(1, 2))
                    near[i[told], j[told]] = False
            counts[lo : lo + 512] = near @ weight
            links.append(near)
        near = np.concatenate(links)
        labels = np.arange(n)
        while True:  # every row takes the least label among its links
            spread = np.minimum(labels, np.where(near, labels[None, :], n).min(axis=1, initial=n))
            spread = spread[spread]
            if (spread == labels).all():
                break
            labels = spread
        told = np.flatnonzero((counts > 0) | (labels != np.arange(n)))
        return pa.table(
            {
                "node": pa.array([nodes[i] for i in told], pa.string()),
                "links": pa.array(counts[told].astype(np.int64)),
                "least": pa.array([nodes[labels[i]] for i in told], pa.string()),
            }
        )

    return run


def _leaves(made: DataFrame, trees: int, leaf: int, level: float) -> DataFrame:
    """(node, tree, width, kind, path, leaf): the leaves of all trees that each vector falls into.

    Level by level, nodes with more than `leaf` vectors are cut at the median of the vectors'
    projections on a random direction; those near the median go both ways. On such a direction the
    difference of two vectors at the threshold has a standard deviation of sqrt(2 - 2 * level), so the
    overlap is SPILL of the vectors and REACH of these deviations at least, and a pair is parted
    seldom however dense a node is. A node that NARROW directions don't cut (see WIDEST) stays whole
    as a leaf. Each level aggregates per node and joins a row per node back. Labels never share a
    node. Vectors that one tree keeps together whole are in no other tree's leaves.
    """
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    key = ["tree", "width", "kind", "path"]
    columns = ["node", *key, "vector"]
    several = made.groupBy("width", "kind").count().filter(F.col("count") > leaf)
    first = made.select("node", F.lit(0).alias("tree"), "width", "kind", F.lit("").alias("path"), "vector")
    done = [stored(first.join(several, ["width", "kind"], "left_anti").select("node", *key))]
    nodes = first.join(several, ["width", "kind"], "left_semi").withColumn("tree", tree).select(*columns)
    reach = REACH * (2 - 2 * min(level, 1.0)) ** 0.5
    vector = made.schema["vector"].dataType.simpleString()
    shape = f"node string, tree int, width int, kind string, path string, vector {vector}, p double"
    above = []
    for depth in range(DEPTH):
        sizes = stored(nodes.groupBy(*key).count())
        final = (F.col("count") <= leaf) | F.col("path").endswith("-" * NARROW)
        large = sizes.filter(~final)
        done.append(stored(nodes.join(sizes.filter(final), key, "left_semi").select("node", *key)))
        if large.isEmpty():
            dropped(*above, sizes)
            break
        seen = stored(nodes.join(large, key, "left_semi").select(*columns).mapInArrow(_projected(depth), shape))
        ends = F.percentile_approx("p", [1 - WIDEST, 0.5 - SPILL, 0.5, 0.5 + SPILL, WIDEST], 2000)
        cuts = seen.groupBy(*key).agg(ends.alias("at"))
        at = F.col("at")
        low, high = F.least(at[1], at[2] - reach), F.greatest(at[3], at[2] + reach)
        cuts = stored(cuts.select(*key, low.alias("low"), high.alias("high"), ((low < at[0]) | (high > at[4])).alias("narrow")))
        left = F.when(F.col("p") <= F.col("high"), F.concat("path", F.lit("0")))
        right = F.when(F.col("p") > F.col("low"), F.concat("path", F.lit("1")))
        ways = F.when(F.col("narrow"), F.array(F.concat("path", F.lit("-")))).otherwise(F.array_compact(F.array(left, right)))
        nodes = seen.join(cuts, key).select("node", "tree", "width", "kind", F.explode(ways).alias("path"), "vector")
        dropped(*above, sizes)
        above = [seen, cuts]
    else:
        done.append(stored(nodes.drop("vector")))
        dropped(*above)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    whole = every.filter(F.col("path").isin("", "-" * NARROW))
    whole = stored(whole.groupBy("width", "kind").agg(F.min("tree").alias("only")))
    kept = every.join(whole, ["width", "kind"], "left").filter("only is null or tree = only")
    kept = stored(kept.select("node", *key, F.xxhash64(*key).alias("leaf")))
    dropped(*done, whole)
    return kept


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    level: float = 0.93,
    trees: int = TREES,
    leaf: int = LEAF,
) -> DataFrame:
    """id, `n_links`, `component_id` and `kept` of every row.

    Rows of one label are linked at a cosine of `level` or more in double precision; `n_links`
    counts the other rows linked directly, `component_id` is the smallest id that links reach, and
    `kept` marks the row that has it.

    Equal vectors of one label are one node with a weight from the start. The others meet in
    the leaves of `trees` trees; a pair counts in the first leaf it shares. A leaf gives one row
    per node, never its pairs. A pair at the threshold that no tree brings together is lost;
    tests measure the recall against brute force. Nodes too dense to be cut without parting links
    are compared whole, in blocks, which takes the square of their size.

    Null vectors and labels, vectors of zeros and those with a null or non-finite component link
    with nothing and are kept. Vectors of different width aren't compared. Null ids are passed over for `component_id`,
    unless the whole group has none; rows that repeat the smallest id are all kept. An empty
    table gives an empty result. Other columns aren't read.
    """
    plain = F.transform(F.col(vector_col), lambda x: x.cast("double") + 0.0)
    whole = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("kind"), plain.alias("vector"))
    usable = F.col("kind").isNotNull() & F.coalesce(whole, F.lit(False))
    text = F.concat_ws(",", "kind", F.lit(":"), F.transform("vector", lambda x: x.cast("string")))
    rows = stored(rows.withColumn("node", F.when(usable, F.md5(text))))
    grouped = rows.filter("node is not null").groupBy("node")
    given = "array<float>" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    made = stored(
        grouped.agg(
            F.first("kind").alias("kind"), F.first("vector").cast(given).alias("vector"), F.count("*").alias("weight"), F.min("id").alias("first")
        ).withColumn("width", F.size("vector"))
    )
    leaves = _leaves(made, trees, leaf, level)
    by_node = leaves.groupBy("node").agg(F.collect_list("leaf").alias("leaves"))
    told = stored(made.join(by_node, "node").select("node", "vector", "weight", "leaves"))
    key = ["tree", "width", "kind", "path"]
    blocks = stored(leaves.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = leaves.join(blocks, key).select("node", *key, "leaf", "blocks", block.alias("block")).select("*", other.alias("other"))
    pairs = placed.select("node", *key, "leaf", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    compared = pairs.join(told, "node").groupBy(*key, "one", "two").applyInArrow(_linked(level), "node string, links bigint, least string")
    found = stored(compared)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    known = (
        made.select("node", "weight", "first")
        .join(counts, "node", "left")
        .join(labels, "node", "left")
        .select("node", "first", F.coalesce("label", "node").alias("group"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    known = stored(known)
    least = stored(known.groupBy("group").agg(F.min("first").alias("least")))
    told_rows = stored(known.join(least, "group").select("node", "n_links", "least"))
    dropped(made, leaves, told, blocks, found, known, least)
    alone = F.col("node").isNull()
    return (
        rows.join(told_rows, "node", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(alone, F.col("id")).otherwise(F.col("least")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
