"""Near-duplicate documents by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .store import components, dropped, stored
from .text import NOT_SPACE, bounds, bytes_of, mix, salts, small_batches, words

#: Words in a shingle.
WIDTH = 5
#: Bands and coordinates in each. A pair at similarity 0.85 shares no band with a chance of 2.6e-7.
BANDS, ROWS = 32, 6
#: Bands of the first round, and pivots of a bucket in it.
FIRST, PIVOTS = 4, 4
#: Members that a bucket's reference is taken from.
VOTERS = 15
SEED = 6

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles.

    Words are runs of characters other than space and the controls 9 to 13, with A-Z lower-cased.
    A text with fewer words than `width` has its whole sequence as one shingle; one without words
    has none.
    """
    data, offsets = bytes_of(texts)
    hashes, rows = words(data, offsets, NOT_SPACE)
    n, places = len(texts), salts(width, SEED)
    counts = np.bincount(rows, minlength=n)
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for length in range(1, width + 1):
        if len(hashes) < length:
            break
        last = len(hashes) - length + 1
        total = np.full(last, length, np.uint64)
        for i in range(length):
            total += hashes[i : last + i] * places[i]
        whole = rows[:last] == rows[length - 1 :]
        fits = whole if length == width else whole & (counts[rows[:last]] == length)
        found.append(mix(total[fits]))
        owners.append(rows[:last][fits])
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((found, owners))
    found, owners = found[order], owners[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])
    found, owners = found[fresh], owners[fresh]
    at = bounds(owners, n)
    for i in range(n):
        yield found[at[i] : at[i + 1]]


def sketch(values: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch (Dahlgaard, Knudsen and Thorup, 2017) of a set that isn't empty.

    In each of the first `size` rounds every value goes to a bin by a hash of its own and the round's;
    a bin keeps the least hash of the first round that reaches it. Round size + j sends all values
    to bin j, so that every bin is filled. Rounds only count until all bins are full, after about
    size * log(size) / len(values). Two sets agree in a bin with a chance of their Jaccard
    similarity, and the share of equal bins is as concentrated as with independent bins.
    """
    seeds = salts(2 * size, SEED + 1)
    out = np.full(size, _ALL, np.uint64)
    step = max(1, math.ceil(1.5 * size * math.log(size + 1) / len(values)))
    for first in range(0, size, step):
        rounds = np.arange(first, min(size, first + step))
        hashed = mix(values[None, :] ^ seeds[rounds][:, None])
        bins = ((hashed >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        ranked = (rounds.astype(np.uint64) << np.uint64(48))[:, None] | (mix(hashed) & _LOW)
        np.minimum.at(out, bins.ravel().astype(np.int64), ranked.ravel())
        if not (out == _ALL).any():
            return out
    for j in np.flatnonzero(out == _ALL):
        out[j] = (np.uint64(size + j) << np.uint64(48)) | (mix(values ^ seeds[size + j]) & _LOW).min()
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band."""
    coordinates = sketch(values, bands * rows).reshape(bands, rows)
    return mix((mix(coordinates) * salts(rows, SEED + 2)).sum(axis=1) + salts(bands, SEED + 3)).view(np.int64)


def set_key(values: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    a, b = salts(2, SEED + 4)
    return np.array([mix(values ^ a).sum(), mix(values ^ b).sum()], np.uint64).tobytes()


def _sketched(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sizes, keys, found = [], [], []
            for values in shingle_sets(batch.column(batch.schema.get_field_index("text"))):
                sizes.append(len(values))
                keys.append(set_key(values) if len(values) else None)
                found.append(band_keys(values, bands, rows) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                ["id", "n", "node", "bands"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        found = [s for s in shingle_sets(batch.column(batch.schema.get_field_index("text"))) if len(s)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([set_key(s) for s in found], pa.binary()),
                pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
            ],
            ["node", "shingles"],
        )


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), all columns, and whether they are `linked`, by their full sets."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(b, "b").join(a, "a")
    met = both.select(*pairs.columns, (F.size("sa") + F.size("sb")).alias("sizes"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return met.select(*pairs.columns, (F.col("shared") * 100 >= (F.col("sizes") - F.col("shared")) * percent).alias("linked"))


def _differing(left: DataFrame, sets: DataFrame, percent: int, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`left` (bucket, node, label) with `lacks` and `extra`, what tells a node's set from its bucket's reference, and its `cost`.

    The reference is what most of a few members hold; any set would do, but copies differ little from this one.
    Two sets differ in what either has in `lacks` and `extra` that the other hasn't, so they are linked exactly
    where their costs add up to 2 * (100 + percent) for each shingle that both lack or both have extra, or less.
    """
    order = W.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")
    some = kept(left.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {VOTERS}").select("bucket", "node"))
    some = some.join(some.groupBy("bucket").agg(F.count("*").alias("voters")), "bucket").join(sets, "node")
    votes = some.select("bucket", "voters", F.explode("shingles").alias("h")).groupBy("bucket", "voters", "h").agg(F.count("*").alias("votes"))
    reference = kept(votes.filter("2 * votes > voters").groupBy("bucket").agg(F.collect_list("h").alias("reference")))
    sides = left.join(reference, "bucket", "left").withColumn("reference", F.coalesce("reference", F.array().cast("array<bigint>"))).join(sets, "node")
    told = sides.select(
        "bucket", "node", "label", F.size("shingles").alias("n"),
        F.array_except("reference", "shingles").alias("lacks"), F.array_except("shingles", "reference").alias("extra"),
    )
    cost = (F.size("lacks") + F.size("extra")).cast("long") * (100 + percent) - F.col("n") * (100 - percent)
    return told.withColumn("cost", cost).drop("n")


def _near(left: DataFrame, sets: DataFrame, percent: int, kept: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(links, pairs) of rows (bucket, node, label): labels `a` and `b` that are linked for sure, and pairs of nodes
    `a` and `b` with their labels `la` and `lb` to be compared. No other nodes of a bucket link its labels.

    A bucket's node of least cost is linked with all nodes whose costs and its own add up to 0 or less; these
    become one label. Every other link of two labels needs shingles that both nodes lack or both have extra
    (see `_differing`), the more the dearer they are: two nodes meet at such a shingle only where each has enough of them
    from there on, in one order for the bucket, and nodes that are too dear for all others meet none.
    """
    each = 2 * (100 + percent)
    told = kept(_differing(left, sets, percent, kept))
    cheapest = kept(told.groupBy("bucket").agg(F.min(F.struct("cost", "node", "label")).alias("least")))
    told = told.join(cheapest, "bucket")
    links = told.filter("cost + least.cost <= 0 and label != least.label").select(F.col("label").alias("a"), F.col("least.label").alias("b"))
    central = (F.col("cost") + F.col("least.cost") <= 0) | (F.col("label") == F.col("least.label"))
    told = told.select("bucket", "node", "label", "cost", "lacks", "extra", central.alias("central"), F.when(central, F.col("least.label")).otherwise(F.col("label")).alias("now"))

    # of what nodes have extra, only what several labels have can be shared
    extra = told.select("bucket", "node", "now", F.explode("extra").alias("h"))
    several = extra.groupBy("bucket", "h").agg(F.min("now").alias("low"), F.max("now").alias("high")).filter("low != high").select("bucket", "h")
    common = kept(extra.join(several, ["bucket", "h"], "left_semi").groupBy("bucket", "node").agg(F.sort_array(F.collect_list("h")).alias("common")))
    marks = F.concat(F.sort_array("lacks"), F.coalesce("common", F.array().cast("array<bigint>")))
    marked = kept(told.join(common, ["bucket", "node"], "left").select("bucket", "node", "label", "cost", "central", "now", marks.alias("marks")))

    # what the cheapest others cost, and what the others can afford a partner to cost
    spare = F.size("marks").cast("long") * each - F.col("cost")
    inner, outer = F.col("central"), ~F.col("central")
    bounds = kept(
        marked.groupBy("bucket").agg(
            *[F.min(F.when(c, F.col("cost"))).alias(f"{name}_cost") for name, c in (("in", inner), ("out", outer))],
            *[F.max(F.when(c, spare)).alias(f"{name}_spare") for name, c in (("in", inner), ("out", outer))],
        )
    )
    beside = F.when(inner, F.col("out_cost")).otherwise(F.least("in_cost", "out_cost"))
    allowed = F.when(inner, F.col("out_spare")).otherwise(F.greatest("in_spare", "out_spare"))
    open_ = marked.join(bounds, "bucket").withColumn("beside", beside).filter((F.col("cost") <= allowed) & (F.col("beside") <= spare))
    met = open_.select("bucket", "node", "label", "now", "cost", "beside", F.posexplode("marks").alias("place", "h"))
    met = met.withColumn("rest", (F.col("place").cast("long") + 1) * each).filter("rest >= cost + beside")
    met = kept(met.select("bucket", "h", "node", "label", "now", "cost", "rest"))
    x, y = (met.select("bucket", "h", *[F.col(c).alias(c + i) for c in ("node", "label", "now", "cost", "rest")]) for i in "xy")
    near = x.join(y, ["bucket", "h"]).filter("nodex < nodey and nowx != nowy and least(restx, resty) >= costx + costy")
    return links, near.select(F.col("nodex").alias("a"), F.col("nodey").alias("b"), F.col("labelx").alias("la"), F.col("labely").alias("lb")).distinct()


def _moved(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with each `label` that is a node of `labels` replaced by that node's label."""
    known = labels.select(F.col("node").alias("label"), F.col("label").alias("now"))
    return rows.join(known, "label", "left").withColumn("label", F.coalesce("now", "label")).drop("now")


def _links(buckets: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """The components that all similar pairs within a bucket make, as one table (node, label) per round.

    The first says what nodes are labelled, each later one which labels become others (see `_moved`).
    Links join components, and a bucket whose members are one component is done. The first round compares
    some pivots with all members, in FIRST bands only, where most of a large group of copies becomes one
    component at the cost of a few comparisons per member; after it only links between components are
    joined. The second compares one pivot, out of the bucket's largest component, with all members of
    every bucket left. The third compares those pairs of different components that `_near` doesn't
    prove to be too far apart. So each pair in a bucket is compared, known to be connected, or proven
    to be too far apart.
    """
    scratch, moves = [], []

    def kept(df: DataFrame) -> DataFrame:
        scratch.append(stored(df))
        return scratch[-1]

    def unsettled(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components, once links (a, b) have joined labels; `size`:
        the rows of the label in the bucket."""
        moves.append(components(links))
        told = kept(_moved(rows, moves[-1]))
        sizes = kept(told.groupBy("bucket", "label").agg(F.count("*").alias("size")))
        mixed = sizes.groupBy("bucket").count().filter("count > 1").select("bucket")
        return kept(told.join(kept(sizes.join(mixed, "bucket", "left_semi")), ["bucket", "label"]))

    def between(met: DataFrame) -> DataFrame:
        """Links between labels by the linked pairs; few, since most pairs are of one component by then."""
        return met.filter("linked and la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))

    # first round
    few = kept(buckets.filter(F.col("band") < FIRST).select("bucket", "node"))
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")))
    pivots = kept(ranked.filter(f"rank <= {PIVOTS}").select("bucket", F.col("node").alias("p")))
    pairs = few.join(pivots, "bucket").filter("node != p").select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
    links = _compared(kept(pairs.distinct()), sets, percent).filter("linked").select("a", "b")
    left = unsettled(buckets.select("bucket", "node", F.col("node").alias("label")), links)

    # second round
    order = W.partitionBy("bucket").orderBy(F.col("size").desc(), F.xxhash64("node"), "node")
    first = left.withColumn("rank", F.row_number().over(order)).filter("rank = 1")
    first = kept(first.select("bucket", F.col("node").alias("a"), F.col("label").alias("la")))
    beside = kept(left.join(first, "bucket").filter("node != a").select("bucket", "a", "la", F.col("node").alias("b"), F.col("label").alias("lb")))
    met = kept(_compared(kept(beside.drop("bucket").distinct()), sets, percent))
    left = unsettled(beside.select("bucket", F.col("b").alias("node"), F.col("lb").alias("label")), between(met))

    # third round
    if not left.isEmpty():
        links, pairs = _near(left.select("bucket", "node", "label"), sets, percent, kept)
        moves.append(components(links.unionByName(between(_compared(kept(pairs), sets, percent)))))
    dropped(*scratch)
    return moves


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): `id`, `n` and `node` of every row; `node` and its group's `group` and `component_id`.

    A node is a distinct shingle set, so exact copies are one node from the start.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType
    out = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n", T.LongType()),
            T.StructField("node", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    sketched = stored(slim.mapInArrow(_sketched(bands, rows), out))
    nodes = stored(
        sketched.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.first("bands").alias("bands"))
    )
    members = nodes.select(F.posexplode("bands").alias("band", "bucket"), "node")
    shared = members.groupBy("bucket").count().filter("count > 1").select("bucket")
    buckets = stored(members.join(shared, "bucket", "left_semi"))
    # the texts of the nodes that share a bucket, one each
    active = stored(nodes.join(buckets.select("node").distinct(), "node", "left_semi").select(F.col("least").alias("id"), "node"))
    ids = active.select(F.col("id").alias("__id"))
    texts = slim.join(ids, F.col("id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    made = texts.mapInArrow(_sets, "node binary, shingles array<bigint>")
    sets = stored(made.join(active.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    labelled, moves = nodes.select("node", "least", F.col("node").alias("label")), _links(buckets, sets, percent)
    for labels in moves:
        labelled = _moved(labelled, labels)
    grouped = stored(labelled.withColumnRenamed("label", "group"))
    first = stored(grouped.groupBy("group").agg(F.min("least").alias("component_id")))
    found = stored(grouped.join(first, "group").select("node", "group", "component_id"))
    dropped(buckets, active, sets, nodes, grouped, first, *moves)
    return sketched.select("id", "n", "node"), found


def _with_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    joined = rows.join(found, "node", "left").select("id", "n", "node", component.alias("component_id"))
    return joined.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, `n_shingles`, `component_id` and `kept` of every row.

    Rows are linked where 100 * intersection >= percent * union of their sets of five-word
    shingles; `component_id` is the smallest id that links reach, and `kept` marks the row that
    has it. Candidates share a band of the sketch; every link is confirmed on the full sets.

    A text without words (also null) is linked with nothing and kept. Rows with equal sets are
    linked, repeated rows too: all rows with the smallest id are marked as kept. Null ids are
    passed over for `component_id`, unless the whole group has no id. An empty table gives an empty
    result. Other columns aren't read.
    """
    told = _with_components(*classes(docs, id_col, text_col, percent, bands, rows))
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _noded(text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(s) if len(s) else b"" for s in shingle_sets(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "__node"])

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of `docs`, all columns, that `near_duplicates` keeps; of rows with one id and one set of shingles one.

    Where ids repeat or are null, rows are told apart by their sets of shingles, computed anew for those.
    """
    told = stored(_with_components(*classes(docs, id_col, text_col, percent)))
    per_id = told.groupBy("id").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    per_id = per_id.withColumn("once", F.col("id").isNotNull() & (F.col("rows") == 1))
    # ids whose rows don't just stay: far fewer than those that do, so that the texts are seldom dealt out for them
    open_ = stored(per_id.filter("not (once and kept)").select(F.col("id").alias("__id"), "once"))
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    once = docs.join(open_.select("__id"), same, "left_anti")
    repeated = open_.filter("not once").select("__id")
    if repeated.isEmpty():
        return once
    schema = T.StructType([*docs.schema, T.StructField("__node", T.BinaryType())])
    noded = docs.join(repeated, same, "left_semi").mapInArrow(_noded(docs.columns.index(text_col)), schema)
    kept = told.filter("kept").select(F.col("id").alias("__id"), F.coalesce("node", F.lit(b"")).alias("__n"))
    rest = noded.join(kept, same & (F.col("__node") == F.col("__n")), "left_semi").dropDuplicates([id_col, "__node"])
    return once.unionByName(rest.drop("__node"))
