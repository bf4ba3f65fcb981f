"""Ranked lexical search by scanning the documents' text with an automaton of all terms asked for.

No document index is built. The terms of all items make one Aho-Corasick automaton, each between two
blanks, so that only whole terms match; documents are brought to the same form (A-Z lower-cased,
each character outside terms a blank) and scanned twice. The first scan counts for each term the
documents that hold it, and the documents and terms in all. The second one weighs the counts in a
document, adds them up for the items that ask for the term, and keeps each item's best documents of
a task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import floor, log
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from cleanframe.operators.ordered import running_sum

from .store import dropped, stored
from .text import ALPHANUMERIC, LOWER, bytes_of, small_batches

#: A term: ASCII letters and digits and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents for each item.
BEST = 10
#: (item, term) pairs that one automaton serves, so that what is broadcast stays under some 100 MB.
PAIRS = 1_000_000
#: Scores kept at once, documents times items.
CELLS = 1 << 21

_SCANNED = np.where(ALPHANUMERIC, LOWER, 0x20).astype(np.uint8)


def terms_of(text: Column) -> Column:
    """All terms of a text in order; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))


@dataclass
class Asked:
    """The items of one automaton: the terms, and for each term the items that ask for it."""

    name: str
    items: pa.Array
    terms: list[str]
    starts: np.ndarray  # of each term's items in `askers`
    askers: np.ndarray


def _asked(name: str, pairs: pa.Table) -> Asked:
    items = pairs.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
    terms = pairs.column("term").combine_chunks().dictionary_encode()
    order = np.argsort(terms.indices.to_numpy(), kind="stable")
    starts = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(terms.dictionary) + 1))
    return Asked(name, items.dictionary, terms.dictionary.to_pylist(), starts, items.indices.to_numpy()[order].astype(np.int64))


def _automaton(asked: Asked):
    """Built once in a worker, which serves one lot at a time."""
    import ahocorasick

    kept = vars(sys.modules.setdefault("cleanframe_worker", ModuleType("cleanframe_worker")))
    if kept.get("lot") != asked.name:
        kept.pop("automaton", None)
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(asked.terms):
            made.add_word(f" {term} ", i)
        made.make_automaton()
        kept["lot"], kept["automaton"] = asked.name, made
    return kept["automaton"]


def scan(automaton, n_terms: int, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many terms each text has, and (text, term, times) of those that the automaton knows."""
    data, offsets = bytes_of(texts)
    plain = np.insert(_SCANNED[data], offsets, 0x20)  # a blank before each text and behind the last
    begins = offsets + np.arange(len(offsets)) + 1
    inside = plain != 0x20
    heads = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    counts = np.diff(np.searchsorted(heads, begins))
    characters = np.append(0, np.cumsum((plain & 0xC0) != 0x80))
    found = np.fromiter(chain.from_iterable(automaton.iter(plain.tobytes().decode())), np.int64).reshape(-1, 2)
    rows = np.searchsorted(characters[begins[:-1]], found[:, 0], "right") - 1
    keys, times = np.unique(rows * n_terms + found[:, 1], return_counts=True)
    return counts, keys // n_terms, keys % n_terms, times.astype(np.int64)


def _frequencies(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        holding, documents, length, made = np.zeros(len(asked.terms), np.int64), 0, 0, _automaton(asked)
        for batch in small_batches(batches, "__text", 1 << 22):
            counts, _, terms, _ = scan(made, len(asked.terms), batch.column(0))
            holding += np.bincount(terms, minlength=len(holding))
            documents += int(np.count_nonzero(counts))
            length += int(counts.sum())
        seen = np.flatnonzero(holding)
        rows = np.append(seen, [-1, -2]), np.append(holding[seen], [documents, length])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["term", "n"])

    return run


class Best:
    """The best documents of each item so far: larger scores first, then smaller ids."""

    def __init__(self, n_items: int, most: int, kind: pa.DataType):
        self.most, self.least = most, np.ones(n_items, np.int64)
        self.kept = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], kind)], names=["item", "score", "id"])

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: documents by items."""
        if len(scores) > self.most:
            self.least = np.maximum(self.least, np.partition(scores, -self.most, axis=0)[-self.most])
        rows, items = np.nonzero(scores >= self.least)
        more = [pa.array(items), pa.array(scores[rows, items]), ids.take(pa.array(rows))]
        self.kept = pa.concat_tables([self.kept, pa.table(more, names=self.kept.column_names)])
        order = pc.sort_indices(self.kept, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")
        self.kept = self.kept.take(order).combine_chunks()
        items = self.kept.column("item").to_numpy()
        heads = np.searchsorted(items, items)
        self.kept = self.kept.filter(pa.array(np.arange(len(items)) - heads < self.most)).combine_chunks()
        items, scores = (self.kept.column(c).to_numpy() for c in ("item", "score"))
        full = np.flatnonzero(np.arange(len(items)) - np.searchsorted(items, items) == self.most - 1)
        self.least[items[full]] = np.maximum(self.least[items[full]], scores[full])


def _ranked(sent, weights: np.ndarray, n_docs: int, length: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = sent.value, None
        made, n_items = _automaton(asked), len(asked.items)
        degrees = np.diff(asked.starts)
        for batch in small_batches(batches, "__text", 1 << 22):
            ids = batch.column(1)
            best = best or Best(n_items, most, ids.type)
            counts, rows, terms, times = scan(made, len(asked.terms), batch.column(0))
            damping = 10 + 90 * counts[rows] * n_docs // max(1, length)
            parts = weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * damping))
            step = max(1, CELLS // n_items)
            for lo in range(0, len(ids), step):
                a, b = np.searchsorted(rows, [lo, lo + step])
                n = degrees[terms[a:b]]
                ends = np.cumsum(n)
                at = np.repeat(asked.starts[terms[a:b]] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)
                scores = np.zeros((min(step, len(ids) - lo), n_items), np.int64)
                np.add.at(scores.reshape(-1), np.repeat(rows[a:b] - lo, n) * n_items + asked.askers[at], np.repeat(parts[a:b], n))
                best.add(scores, ids.slice(lo, step))
        if best is not None and len(best.kept):
            items = asked.items.take(best.kept.column("item").combine_chunks())
            for out in pa.table([items, best.kept.column("id"), best.kept.column("score")], names=["item", "id", "score"]).to_batches():
                yield out

    return run


def rank(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most: int = BEST,
    pairs_at_once: int = PAIRS,
) -> DataFrame:
    """(item, `rank`, id, `score`): the `most` documents with the highest scores above 0 for each item.

    Scores and ties are those of the module's two scans; equal scores rank by ascending id, null
    first. Items are searched in lots of about `pairs_at_once` (item, term) pairs, or of one item
    that has more, each lot with an automaton and two scans of its own. Of the corpus only counts
    per term of a lot come to the driver; a task sends `most` rows per item.

    Rows with one item id are one item with the terms of all its texts; a null item id is an item. Items
    and documents without terms, null texts among them, aren't found; repeated documents are
    documents of their own. Empty tables give an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    pairs = items.select(F.col(item_col).alias("item"), F.explode(terms_of(F.col(item_text_col))).alias("term")).distinct()
    sizes = pairs.groupBy("item").agg(F.count("*").alias("n"))
    lots = running_sum(sizes, "n", ["item"], name="upto", ties=()).select(F.col("item").alias("__item"), F.floor((F.col("upto") - F.col("n")) / pairs_at_once).alias("lot"))
    pairs = stored(pairs.join(lots, F.col("item").eqNullSafe(F.col("__item"))).select("lot", "item", "term"))
    n_lots = pairs.agg(F.max("lot")).first()[0]
    slim = docs.select(F.col(text_col).alias("__text"), F.col(id_col).alias("__id"))
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = T.StructType([T.StructField("item", item_kind), T.StructField("id", kind), T.StructField("score", T.LongType())])
    found = spark.createDataFrame([], schema)
    for lot in range(0 if n_lots is None else n_lots + 1):
        own = pairs.filter(F.col("lot") == lot).select("item", "term").orderBy("item", "term").toArrow()
        if not own.num_rows:  # the items before have more than one lot's share
            continue
        asked = _asked(f"{pairs.stored_at}/{lot}", own)
        sent = spark.sparkContext.broadcast(asked)
        counts = slim.select("__text").mapInArrow(_frequencies(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        known = {r["term"]: r["n"] for r in counts.collect()}
        n_docs, length = known.get(-1, 0), known.get(-2, 0)
        weights = [floor(1000 * log((2 * n_docs + 2) / (2 * known.get(i, 0) + 1))) for i in range(len(asked.terms))]
        part = slim.mapInArrow(_ranked(sent, np.array(weights, np.int64), n_docs, length, most), schema)
        found = found.unionByName(part)
    place = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first()))
    top = found.withColumn("rank", place).filter(F.col("rank") <= most)
    dropped(pairs)
    return top.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
