"""A Merkle manifest of a dataset, kept as a postorder append log.

Rows are leaves. The leaves of each group (a source), in order of their ids, form a tree: while more
than one node is left, every FANOUT neighbours (at the end fewer, even one) are hashed into one. The
groups' roots, in order of the groups, form one more tree in the same way.

A tree's log holds its nodes in the order in which they are complete when leaves come in one by one.
Leaf e (counted from 1) completes itself and then every ancestor of which it is the last leaf, so the
node of level l over leaves up to e stands at place

    sum over j of floor((e - 1) / FANOUT**j)  +  l

A subtree over m leaves has sum of ceil(m / FANOUT**j) nodes, which stand side by side before its
parent. So builders can write aligned subtrees of FANOUT**HEIGHT leaves each on its own, as one
segment whose first place is known, further builders the nodes above, and a proof finds all
siblings by their places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import dropped, stored

#: Nodes under a node; fixed by the manifest's definition.
FANOUT = 16
#: Levels that one builder makes at once, from FANOUT**HEIGHT nodes.
HEIGHT = 3
SPAN = FANOUT**HEIGHT
#: FANOUT**j for all levels that 64 bits can count.
POWERS = [FANOUT**j for j in range(15)]
SIZE = 32  # bytes of a digest


def levels(n: int) -> int:
    """Levels above the n leaves of a tree."""
    return sum(p < n for p in POWERS)


def place(level, index, n):
    """Where the log holds a node; for numbers and numpy arrays alike."""
    before = np.minimum((np.asarray(index, np.int64) + 1) * FANOUT**level, n) - 1
    return sum(before // p for p in POWERS) + level


def place_column(level: Column, index: Column, n: Column) -> Column:
    """The same in SQL."""
    powers = F.array(*[F.lit(p).cast("long") for p in POWERS])
    before = F.least((index + 1) * F.get(powers, level.cast("int")), n) - 1
    return F.aggregate(powers, level.cast("long"), lambda sum_, p: sum_ + F.floor(before / p))


def children(index: int, count: int) -> range:
    """The run of nodes that a node among `count` of its level is hashed with."""
    first = index // FANOUT * FANOUT
    return range(first, min(first + FANOUT, count))


def hashed(nodes: bytes) -> bytes:
    """The level above: digests of the hex text of every FANOUT digests."""
    text = nodes.hex().encode()
    step = 2 * SIZE * FANOUT
    return b"".join(sha256(text[i : i + step]).digest() for i in range(0, len(text), step))


def subtree(leaves: bytes, height: int) -> list[bytes]:
    """All levels, the leaves first."""
    out = [leaves]
    for _ in range(height):
        out.append(hashed(out[-1]))
    return out


def in_order(made: list[bytes]) -> bytes:
    """The levels of a subtree as its part of the log."""
    m = len(made[0]) // SIZE
    out = np.empty((sum(map(len, made)) // SIZE, SIZE), np.uint8)
    for level, nodes in enumerate(made):
        out[place(level, np.arange(len(nodes) // SIZE), m)] = np.frombuffer(nodes, np.uint8).reshape(-1, SIZE)
    return out.tobytes()


def out_of_order(log: bytes, m: int, height: int) -> list[bytes]:
    """The levels of a subtree from its part of the log."""
    nodes = np.frombuffer(log, np.uint8).reshape(-1, SIZE)
    counts = [-(-m // FANOUT**level) for level in range(height + 1)]
    return [nodes[place(level, np.arange(n), m)].tobytes() for level, n in enumerate(counts)]


def fold(node: str, index: int, n: int, siblings: str) -> str:
    """The root that a node's hex digest and its siblings lead to, in a tree of n leaves."""
    at, step = 0, 2 * SIZE
    for level in range(levels(n)):
        run = children(index, -(-n // FANOUT**level))
        own = index - run.start
        left, right = at + own * step, at + (len(run) - 1) * step
        node = sha256((siblings[at:left] + node + siblings[left:right]).encode()).hexdigest()
        at, index = right, index // FANOUT
    return node


# -- builders ----------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, run), which come sorted."""
    kept: list[pa.RecordBatch] = []

    def pieces(table: pa.Table) -> list[pa.Table]:
        tree, run = (table.column(c).to_numpy() for c in ("tree", "run"))
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (run[1:] != run[:-1])) + 1
        edges = [0, *cuts.tolist(), len(table)]
        return [table.slice(a, b - a) for a, b in zip(edges, edges[1:])]

    for batch in batches:
        if not batch.num_rows:
            continue
        *whole, last = pieces(pa.Table.from_batches([*kept, batch]).combine_chunks())
        yield from whole
        kept = last.to_batches()
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _bytes(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _by_run(rows: DataFrame, *order: str) -> DataFrame:
    """Each run together in one partition, sorted."""
    return rows.repartition("tree", "run").sortWithinPartitions("tree", "run", *order)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches):
        tree, run, n = (table.column(c)[0].as_py() for c in ("tree", "run", "n"))
        nodes = in_order(subtree(_bytes(table.column("digest")), min(HEIGHT, levels(n))))
        row = [tree, n, run, int(place(0, run * SPAN, n)), nodes]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([v], pa.int64()) for v in row[:4]), pa.array([nodes], pa.binary())], ["tree", "n", "run", "first", "nodes"]
        )


def _upper(base: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            tree, run, n = (table.column(c)[0].as_py() for c in ("tree", "run", "n"))
            made = subtree(_bytes(table.column("digest")), min(HEIGHT, levels(n) - base))
            found = []
            for up, nodes in list(enumerate(made))[1:]:
                for i in range(len(nodes) // SIZE):
                    index = run * FANOUT ** (HEIGHT - up) + i
                    found.append((int(place(base + up, index, n)), base + up, index, nodes[i * SIZE : (i + 1) * SIZE]))
            found.sort()  # in completion order
            places, ups, indexes, digests = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tree] * len(found), pa.int64()),
                    pa.array([n] * len(found), pa.int64()),
                    pa.array(ups, pa.int32()),
                    pa.array(indexes, pa.int64()),
                    pa.array(places, pa.int64()),
                    pa.array(digests, pa.binary()),
                ],
                ["tree", "n", "level", "index", "place", "digest"],
            )

    return run


@dataclass
class Log:
    """The logs of many trees: their segments, the nodes from the segments' tops up, and the roots."""

    segments: DataFrame  # tree, n, run, first, nodes
    upper: DataFrame  # tree, n, level, index, place, digest
    roots: DataFrame  # tree, root


def write_log(leaves: DataFrame) -> Log:
    """The logs of trees given by (tree, n, rank, digest): rank from 0 among the n leaves of a tree.

    One shuffle brings aligned runs of SPAN leaves to their builders. Their tops, SPAN times fewer, go
    to the next builders, and so on; the number of rounds is that of the largest tree's levels.
    """
    rows = leaves.select("tree", "n", "rank", "digest", F.floor(F.col("rank") / SPAN).alias("run"))
    segments = stored(_by_run(rows, "rank").mapInArrow(_segments, "tree long, n long, run long, first long, nodes binary"))
    largest = segments.agg(F.max("n")).first()[0] or 0
    last = F.expr(f"substring(nodes, length(nodes) - {SIZE - 1}, {SIZE})")
    schema = "tree long, n long, level int, index long, place long, digest binary"
    big = segments.filter(F.col("n") > SPAN)
    tops = big.select(
        "tree", "n", F.lit(HEIGHT).alias("level"), F.col("run").alias("index"), place_column(F.lit(HEIGHT), F.col("run"), F.col("n")).alias("place"), last.alias("digest")
    )
    parts, base = [stored(tops)], HEIGHT
    while FANOUT**base < largest:
        more = parts[-1].filter((F.col("level") == base) & (F.col("n") > FANOUT**base))
        more = more.withColumn("run", F.floor(F.col("index") / SPAN))
        parts.append(stored(_by_run(more, "index").mapInArrow(_upper(base), schema)))
        base += HEIGHT
    upper = parts[0]
    for part in parts[1:]:
        upper = upper.unionByName(part)
    height = sum(((F.col("n") > p).cast("int") for p in POWERS), F.lit(0))
    small = segments.filter(F.col("n") <= SPAN).select("tree", last.alias("root"))
    roots = small.unionByName(upper.filter(F.col("level") == height).select("tree", F.col("digest").alias("root")))
    return Log(segments, upper, stored(roots))


def run_paths(log: Log) -> DataFrame:
    """(tree, run, path): for each segment of a tree of several, the siblings of its top and of the nodes above.

    The places of all siblings are computed and looked up in the log.
    """
    height = sum(((F.col("n") > p).cast("int") for p in POWERS), F.lit(0))
    powers = F.array(*[F.lit(p).cast("long") for p in POWERS])
    tops = log.upper.filter(F.col("level") == HEIGHT).select("tree", "n", F.col("index").alias("run"))
    at = tops.select("*", F.explode(F.sequence(F.lit(HEIGHT), height - 1)).alias("level"))
    own = F.floor(F.col("run") / F.get(powers, F.col("level") - HEIGHT))
    count = F.ceil(F.col("n") / F.get(powers, F.col("level")))
    at = at.select("*", own.alias("own"), count.alias("count"))
    first = F.floor(F.col("own") / FANOUT) * FANOUT
    at = at.select("*", F.explode(F.sequence(first, F.least(first + FANOUT, F.col("count")) - 1)).alias("sibling"))
    wanted = at.filter("sibling != own").select("tree", "run", "level", "sibling", place_column(F.col("level"), F.col("sibling"), F.col("n")).alias("place"))
    found = wanted.join(log.upper.select("tree", "place", "digest"), ["tree", "place"])
    steps = F.array_sort(F.collect_list(F.struct("level", "sibling", "digest")))
    return found.groupBy("tree", "run").agg(
        F.aggregate(steps, F.lit("").cast("binary"), lambda all_, s: F.concat(all_, s["digest"])).alias("path")
    )


def _by_leaf(table: pa.Table) -> Iterator[tuple[int, str]]:
    """(rank, siblings as hex up to the tree's root) of each leaf of a run; its first row tells of the run."""
    n, run = table.column("n")[0].as_py(), table.column("run")[0].as_py()
    m, height = min(SPAN, n - run * SPAN), min(HEIGHT, levels(n))
    made = [nodes.hex() for nodes in out_of_order(table.column("nodes")[0].as_py(), m, height)]
    above, step, known = (table.column("path")[0].as_py() or b"").hex(), 2 * SIZE, {}

    def beside(level: int, index: int) -> str:
        """The siblings of a node of the run and of all above it."""
        if level == height:
            return above
        parent = index // FANOUT
        if (level + 1, parent) not in known:
            known[level + 1, parent] = beside(level + 1, parent)
        run = children(index, len(made[level]) // step)
        own, lo, hi = index * step, run.start * step, run.stop * step
        return made[level][lo:own] + made[level][own + step : hi] + known[level + 1, parent]

    for rank in table.column("rank").to_pylist()[1:]:
        yield rank, beside(0, rank - run * SPAN)


def _tree_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches):
        ranks, paths = zip(*_by_leaf(table))
        yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(map(bytes.fromhex, paths), pa.binary())], ["rank", "path"])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches):
        tree, n, trees = (table.column(c)[0].as_py() for c in ("tree", "n", "trees"))
        subroot, root = (table.column(c)[0].as_py().hex() for c in ("subroot", "root"))
        top = (table.column("top")[0].as_py() or b"").hex()
        leaves = [d.hex() for d in table.column("digest").to_pylist()[1:]]
        shown = [d.hex() if d else leaf for d, leaf in zip(table.column("shown").to_pylist()[1:], leaves)]
        proofs, folded = [], []
        for (rank, own), digest in zip(_by_leaf(table), shown):
            proofs.append(sha256((own + top).encode()).hexdigest())
            folded.append(fold(fold(digest, rank, n, own), tree, trees, top))
        ids = table.column("id").slice(1).combine_chunks()
        text = [pa.array(c, pa.string()) for c in (leaves, [subroot] * len(leaves), [root] * len(leaves), proofs, folded)]
        same = pa.array([f == root for f in folded], pa.bool_())
        yield pa.RecordBatch.from_arrays([ids, *text, same], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


# -- whole tables -------------------------------------------------------------


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its text; a missing one as a hyphen."""
    told = [
        F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        for text in (f.cast("string") for f in fields)
    ]
    return F.unhex(F.sha2(F.concat(*told), 256))


def _numbered(rows: DataFrame, group: str | None, *order: str) -> DataFrame:
    """Adds `rank`, from 0 in the order of (group, order) within each group, nulls first.

    Spark's range exchange sorts the table; a row's place in its partition, and the rows of its group
    in earlier partitions, give its rank. Nothing but one row per partition and group is summed up.
    """
    keys = [F.col(c).asc_nulls_first() for c in ((group, *order) if group else order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = stored(dealt.withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumns({"__part": F.shiftright("__at", 33), "__group": F.col(group) if group else F.lit(0)})
    counts = at.groupBy(F.col("__part").alias("__p"), F.col("__group").alias("__g")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = W.partitionBy("__g").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("__p", "__g", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__add"))
    same = (F.col("__part") == F.col("__p")) & F.col("__group").eqNullSafe(F.col("__g"))
    ranked = at.join(counts, same).withColumn("rank", F.col("__at") + F.col("__add"))
    return ranked.select(*rows.columns, "rank")


@dataclass
class Manifest:
    leaves: DataFrame  # tree, n, rank, group, id, digest, shown
    trees: DataFrame  # tree, group, n
    log: Log
    top: Log
    n_trees: int
    root: str | None


def build(docs: DataFrame, digest: Column, id_col: str = "doc_id", group_col: str = "source", shown: Column | None = None) -> Manifest:
    """The manifest of a table: each row's digest as a leaf, per group a tree, one tree over the groups.

    `shown` are the digests that rows have when they are verified, null where nothing was changed.

    A null group is a group and comes first, a null id comes first in its group. Rows with one id are
    ordered by their digests, which tells all but rows that are the same. An empty table has no root.
    """
    rows = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), digest.alias("digest"), (F.lit(None).cast("binary") if shown is None else shown).alias("shown"))
    ranked = stored(_numbered(rows, "group", "id", "digest"))
    counts = ranked.groupBy("group").agg(F.count("*").alias("n"))
    trees = stored(_numbered(counts, None, "group").withColumnRenamed("rank", "tree"))
    known = trees.select(F.col("group").alias("__group"), "tree", "n")
    leaves = stored(ranked.join(known, F.col("group").eqNullSafe(F.col("__group"))).drop("__group"))
    dropped(ranked)
    log = write_log(leaves)
    n_trees = trees.count()
    top = write_log(log.roots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("rank"), F.col("root").alias("digest")))
    root = top.roots.first()
    return Manifest(leaves, trees, log, top, n_trees, root and root["root"].hex())


def _with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of each run behind one that tells of the run."""
    both = runs.withColumn("rank", F.lit(-1).cast("long")).unionByName(rows, allowMissingColumns=True)
    return _by_run(both, "rank")


def prove(manifest: Manifest) -> DataFrame:
    """For each row: id, `leaf`, `subroot`, `root`, `proof_sha256`, `folded_root` and `verified`, as hex.

    The proof is the siblings of the leaf and of all nodes above it, up to the root of its tree and then
    of its group's root, in order. `folded_root` hashes the shown leaf upwards with these
    siblings; `verified` says that it is the root. Siblings come from the log: those below a
    segment's top from the segment, read once for all its leaves, the others by their places.
    """
    if manifest.root is None:
        none = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return manifest.leaves.select("id").filter("false").mapInArrow(lambda batches: iter(()), f"id {manifest.leaves.schema['id'].dataType.simpleString()}, {none}")
    with_path = lambda log: log.segments.join(run_paths(log), ["tree", "run"], "left")
    run = F.floor(F.col("rank") / SPAN).alias("run")
    tops = manifest.trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank")).withColumn("run", run)
    top = stored(_with_runs(tops, with_path(manifest.top)).mapInArrow(_tree_paths, "rank long, path binary"))
    per_tree = manifest.log.roots.join(top.select(F.col("rank").alias("tree"), F.col("path").alias("top")), "tree").select(
        "tree", F.col("root").alias("subroot"), "top", F.lit(manifest.n_trees).cast("long").alias("trees"), F.unhex(F.lit(manifest.root)).alias("root")
    )
    runs = with_path(manifest.log).join(per_tree, "tree").drop("first")
    leaves = manifest.leaves.select("tree", "rank", run, "id", "digest", "shown")
    kind = manifest.leaves.schema["id"].dataType.simpleString()
    return _with_runs(leaves, runs).mapInArrow(
        _proofs, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
