"""Token counts of whole texts, huge ones by overlapping chunks."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .text import small_batches

VOCABULARY = "byte_bpe_50k.json"
#: Characters encoded at a time, and by how many two chunks overlap at first.
CHUNK, OVERLAP = 100_000, 2_000
LIMIT = 1024


def tokenizer(name: str):
    """The public tokenizer of that name, as its library loads it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


def _edges(encoding) -> list[tuple[int, int, int]]:
    """(place, end of the word before, tokens before) wherever a new word begins."""
    offsets, words = encoding.offsets, encoding.word_ids
    return [(offsets[i][0], offsets[i - 1][1], i) for i in range(1, len(offsets)) if words[i] != words[i - 1]]


def spliced_count(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, ahead: int = 1) -> int:
    """The number of tokens of a text, from encodings of overlapping chunks with offsets.

    The tokenizer cuts a text into words from left to right and merges inside words only. Where a
    word begins in the true cut and also in a chunk's own cut, both go on alike: what follows
    depends on the text from there on only. A word that begins in a chunk is true if the words up to
    it are whole in it, with the `ahead` characters after the next word's begin: no cut looks
    further than that word, one character, and the longest special string, which splits the text
    before words are cut. So two chunks are spliced where a word begins in both that is true in the
    left one. If there is none, the overlap is widened, at last to the whole left chunk, and then
    the chunks grow.
    """
    counted = start = 0
    while True:
        end = start + chunk
        if end >= len(text):
            return counted + len(encode(text[start:]).ids)
        left = _edges(encode(text[start:end]))
        true = {}
        for here, following in zip(left, left[1:]):
            if following[0] + ahead < end - start:
                true[here[0] + start] = here[2]
        width = overlap
        while True:
            begin = max(start + 1, end - width)
            common = [e for e in _edges(encode(text[begin : begin + chunk])) if e[0] + begin in true]
            if common or begin == start + 1:
                break
            width *= 2
        if common:
            place = common[0][0] + begin
            counted, start = counted + true[place], place
        else:
            chunk *= 2


#: Space next to more white space, or at an end of the text, in RE2's notation.
UNSURE = r" [\s\pZ\x0b\x1c-\x1f\x85]|[\s\pZ\x0b\x1c-\x1f\x85] |^ | $"
#: Spaces between two characters other than white space.
SURE = re.compile(r"(?<=\S) (?=\S)")


class SegmentCounts:
    """Token counts of texts by the counts of their segments, each encoded once.

    A space between two characters other than white space always begins a word, since a word
    holds a space at its head only, and special strings hold none. So a text falls into segments
    there, and its tokens are those of its segments. Up to about `most` segments are remembered.
    """

    def __init__(self, made, known: dict | None = None, most: int = 1_200_000):
        self.made, self.most, self.known = made, most, {} if known is None else known

    def _encoded(self, segments: list[str]) -> list[int]:
        return list(map(len, self.made.encode_batch_fast(segments, add_special_tokens=False)))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; there must be no nulls."""
        unsure = pc.match_substring_regex(texts, UNSURE)
        cut = pc.split_pattern(pc.if_else(unsure, "", texts), " ")
        counts = self._sums(cut.flatten(), np.asarray(cut.offsets))
        for i in np.flatnonzero(np.asarray(unsure)):
            parts = SURE.split(texts[int(i)].as_py())
            counts[i] = sum(self._encoded([parts[0], *(" " + p for p in parts[1:])]))
        return counts

    def _sums(self, segments: pa.Array, offsets: np.ndarray) -> np.ndarray:
        """Sums of the segments' counts by text; the first of each text has no space before it."""
        coded = segments.dictionary_encode()
        names, places = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        found = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0).tolist()
        found[new] = self._encoded([" " + names[i] for i in new])
        if len(self.known) < self.most:
            self.known.update((names[i], int(found[i])) for i in new)
        counts = found[places]
        heads = offsets[:-1]
        counts[heads] = self._encoded([names[p] for p in places[heads]])
        return np.add.reduceat(counts, heads) if len(heads) else np.zeros(0, np.int64)


def count_batches(name: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a worker has learned outlives the task; Spark keeps workers for later tasks
        kept = vars(sys.modules.setdefault("cleanframe_worker", ModuleType("cleanframe_worker")))
        if name not in kept:
            kept[name] = tokenizer(name), {}
        made, known = kept[name]
        ahead = 1 + max([0, *(len(t.content) for t in made.get_added_tokens_decoder().values())])
        exact = lambda text: made.encode(text, add_special_tokens=False)
        short = SegmentCounts(made, known)
        for batch in small_batches(batches, "__text", 1 << 22):
            texts = pc.fill_null(batch.column(batch.schema.get_field_index("__text")).cast(pa.string()), "")
            huge = pc.greater(pc.utf8_length(texts), chunk)
            counts = short.count(pc.if_else(huge, "", texts))
            for i in np.flatnonzero(np.asarray(huge)):
                counts[i] = spliced_count(exact, texts[int(i)].as_py(), chunk, overlap, ahead)
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.field(i).name != "__text"]
            names = [f.name for f in batch.schema if f.name != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64())], [*names, "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """id, `n_bytes` (UTF-8), `n_tokens` and `over_limit` (n_tokens > limit) of every row.

    Counts are those of the tokenizers library for the whole text, with no added begin or end, the
    vocabulary's special strings taken as its default does. Texts over `chunk` characters are encoded in
    overlapping chunks and spliced, so that the encoder's memory doesn't grow with a text; shorter
    ones by their segments (see SegmentCounts), since most segments of a corpus repeat.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are rows like
    others; an empty table gives an empty result. Other columns aren't read.
    """
    slim = docs.select(F.col(id_col), F.col(text_col).alias("__text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = T.StructType([slim.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = slim.mapInArrow(count_batches(vocabulary, chunk, overlap), out)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
