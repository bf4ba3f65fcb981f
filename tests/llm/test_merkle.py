"""The Merkle manifest against plain Python, and the log's places."""

from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from cleanframe.llm import merkle
from pyspark.sql import functions as F


def h(text):
    return sha256(text.encode()).hexdigest()


def told(*fields):
    return "".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields)


def plain_tree(nodes):
    """All levels of a tree of hex digests."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, index):
    out = []
    for level in tree[:-1]:
        run = range(index // 16 * 16, min(index // 16 * 16 + 16, len(level)))
        out += [level[i] for i in run if i != index]
        index //= 16
    return out


def changed(tree, index, digest):
    """The root with another leaf."""
    for level in tree[:-1]:
        first = index // 16 * 16
        digest = h("".join(digest if i == index else level[i] for i in range(first, min(first + 16, len(level)))))
        index //= 16
    return digest


def plain(rows, lowered):
    """{row number: (leaf, subroot, root, proof, folded, verified)} of (id, group, text)."""
    groups = defaultdict(list)
    for k, (i, group, text) in enumerate(rows):
        groups[group].append(((i is not None, i or 0), h(told(i, group, text)), k))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([d for _, d, _ in sorted(groups[g])]) for g in order}
    top = plain_tree([trees[g][-1][0] for g in order])
    out = {}
    for at, g in enumerate(order):
        for index, (_, leaf, k) in enumerate(sorted(groups[g])):
            i, _, text = rows[k]
            path = siblings(trees[g], index) + siblings(top, at)
            shown = h(told(i, g, text.lower())) if lowered(i) and text is not None else leaf
            folded = changed(top, at, changed(trees[g], index, shown))
            out[k] = (leaf, trees[g][-1][0], top[-1][0], h("".join(path)), folded, folded == top[-1][0])
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096, 4097, 70000])
def test_places_follow_the_order_of_completion(n):
    height, want = merkle.levels(n), []
    assert height == (0 if n == 1 else len(plain_counts(n)) - 1)
    for e in range(1, n + 1):
        want.append((0, e - 1))
        for level in range(1, height + 1):
            if e % 16**level == 0 or e == n:
                want.append((level, (e - 1) // 16**level))
    counts = plain_counts(n)
    found = {(level, i): p for level, c in enumerate(counts) for i, p in enumerate(np.atleast_1d(merkle.place(level, np.arange(c), n)).tolist())}
    assert [found[node] for node in want] == list(range(sum(counts)))


def plain_counts(n):
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // 16))
    return out


def manifest_of(spark, rows, parts):
    docs = spark.createDataFrame([(i, g, t, k) for k, (i, g, t) in enumerate(rows)], "doc_id long, source string, text string, digest int").repartition(parts)
    fields = [F.col("doc_id"), F.col("source")]
    shown = F.when(F.col("doc_id") % 5 == 0, merkle.leaf_digest(*fields, F.lower("text")))
    return merkle.build(docs, merkle.leaf_digest(*fields, F.col("text")), shown=shown)


@pytest.mark.parametrize("groups, parts", [([("a", 4097), ("é", 1), (None, 17), ("b", 300)], 3), ([(f"s{i}", 1 + i % 18) for i in range(40)], 2), ([("only", 66000)], 7)])
def test_manifest_against_plain_python(spark, groups, parts):
    rows = [(i * 7 % (n * 7 + 1), g, f"Text {i}" if i % 9 else None) for g, n in groups for i in range(n)]
    manifest = manifest_of(spark, rows, parts)
    got = merkle.prove(manifest).collect()
    want = plain(rows, lambda i: i % 5 == 0)
    by_leaf = {w[0]: (rows[k][0], *w) for k, w in want.items()}
    assert len(got) == len(rows) == len(by_leaf)
    assert {r["leaf"]: tuple(r) for r in got} == by_leaf
    assert {r["verified"] for r in got} == {True, False}
    # the log has every place once
    for tree, n in [(r["tree"], r["n"]) for r in manifest.trees.collect()]:
        segments = manifest.log.segments.filter(F.col("tree") == tree).collect()
        places = [p for s in segments for p in range(s["first"], s["first"] + len(s["nodes"]) // 32)]
        places += [r["place"] for r in manifest.log.upper.filter((F.col("tree") == tree) & (F.col("level") > 3)).collect()]
        assert sorted(places) == list(range(sum(plain_counts(n))))


def test_ties_nulls_and_empty_tables(spark):
    rows = [(None, None, "x"), (None, None, None), (3, None, "A"), (3, None, "A"), (3, None, "B"), (4, "", ""), (5, "s", "Same"), (5, "s", "Same")]
    got = merkle.prove(manifest_of(spark, rows, 2)).collect()
    want = plain(rows, lambda i: i is not None and i % 5 == 0)
    assert sorted(tuple(r)[1:] for r in got) == sorted(want.values())
    one = merkle.prove(manifest_of(spark, rows[:1], 1)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and one["proof_sha256"] == h("")
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    empty = merkle.build(docs, merkle.leaf_digest(F.col("doc_id")))
    assert empty.root is None and merkle.prove(empty).count() == 0


def test_any_changed_sibling_breaks_the_proof():
    tree = plain_tree([h(str(i)) for i in range(300)])
    path = siblings(tree, 77)
    assert merkle.fold(tree[0][77], 77, 300, "".join(path)) == tree[-1][0]
    for i in range(len(path)):
        assert merkle.fold(tree[0][77], 77, 300, "".join([*path[:i], h("x"), *path[i + 1 :]])) != tree[-1][0]
