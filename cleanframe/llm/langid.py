"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import bytes_of, small_batches

#: Hash buckets of byte trigrams.
BUCKETS = 1 << 13
#: Centroids of a language, and documents that they are clustered from, about; the pick is by hash.
CENTROIDS, SAMPLE = 3, 1500
ROUNDS = 8
#: A document is rejected below REJECT of the similarity to a centroid that all but LOWEST of the sampled pieces
#: of its length in the language reach; a length counts from PIECES of them.
REJECT, LOWEST, PIECES = 0.5, 0.01, 20
#: Lengths count by doublings of the number of different trigrams.
LENGTHS = BUCKETS.bit_length()
#: Bytes counted at a time.
PIECE = 1 << 22

_BYTES = np.arange(256)
_SMALL = ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: A-Z in lower case; all other ASCII as a space.
LETTERS = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, np.where(_SMALL, _BYTES, 32)).astype(np.uint32)


@dataclass
class Model:
    """What predictions need: BUCKETS numbers per centroid, whatever the corpus. `floors` has a number per length."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigram buckets of a text's bytes, and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(data), PIECE):
        part = LETTERS[data[max(0, lo - 2) : lo + PIECE]]
        ends = [np.uint32(32)] if lo == 0 else [], [np.uint32(32)] if lo + PIECE >= len(data) else []
        part = np.concatenate([np.array(ends[0], np.uint32), part, np.array(ends[1], np.uint32)])
        if len(part) < 3:
            continue
        first, second, third = part[:-2], part[1:-1], part[2:]
        hashed = (first * np.uint32(0x9E3779B1)) ^ (second * np.uint32(0x85EBCA77)) ^ (third * np.uint32(0xC2B2AE3D))
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        hashed = hashed[(first != 32) | (second != 32) | (third != 32)]
        total += np.bincount(hashed >> np.uint32(19), minlength=BUCKETS)
    seen = np.flatnonzero(total)
    return seen, total[seen]


def vector(data: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their normalised TF-IDF."""
    seen, counts = grams(data)
    weights = np.log1p(counts) * idf[seen]
    return seen, weights / max(float(np.sqrt((weights * weights).sum())), 1e-30)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(BUCKETS, np.int64)
    for batch in small_batches(batches, "text"):
        data, offsets = bytes_of(batch.column(0))
        for i in range(batch.num_rows):
            found[grams(data[offsets[i] : offsets[i + 1]])[0]] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(found)], ["bucket", "n"])


def length_of(seen: np.ndarray) -> int:
    return len(seen).bit_length() - 1


def _floors(texts: list[np.ndarray], centers: np.ndarray, idf: np.ndarray) -> list[float]:
    """The least similarity to a centroid that counts as usual, for each length.

    Besides the texts, pieces of them of 8, 16, 32 and so on bytes count, so that short lengths are
    known as well; a length that too few pieces have takes the level of the next shorter one.
    """
    by_bucket = np.ascontiguousarray(centers.T)
    known: list[list[float]] = [[] for _ in range(LENGTHS)]
    for number, text in enumerate(texts):
        size = 8
        while True:
            lo = number * 7919 % (len(text) - size + 1) if size < len(text) else 0
            seen, weights = vector(text[lo : lo + size], idf)
            if len(seen):
                known[length_of(seen)].append(float((weights @ by_bucket[seen]).max()))
            if size >= len(text):
                break
            size *= 2
    floors, last = [], 0.0
    for values in known:
        last = float(np.quantile(values, LOWEST)) if len(values) >= PIECES else last
        floors.append(last)
    return floors


def _clustered(idf: np.ndarray):
    """Spherical k-means over one language's sample; its rows in hash order, so reruns agree."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("draw").combine_chunks()
        data, offsets = bytes_of(table.column("text"))
        rows = np.zeros((table.num_rows, BUCKETS), np.float32)
        for i in range(table.num_rows):
            seen, weights = vector(data[offsets[i] : offsets[i + 1]], idf)
            rows[i, seen] = weights
        centers = rows[:CENTROIDS].copy()
        for _ in range(ROUNDS):
            near = (rows @ centers.T).argmax(axis=1)
            for k in range(len(centers)):
                if (near == k).any():
                    centers[k] = rows[near == k].sum(axis=0)
                    centers[k] /= max(float(np.linalg.norm(centers[k])), 1e-30)
        floor = _floors([data[offsets[i] : offsets[i + 1]] for i in range(table.num_rows)], centers, idf)
        return pa.table(
            {
                "lang": pa.array([table.column("lang")[0].as_py()] * len(centers)),
                "k": pa.array(range(len(centers)), pa.int32()),
                "weights": pa.array(list(centers), pa.list_(pa.float32())),
                "floor": pa.array([floor] * len(centers), pa.list_(pa.float64())),
            }
        )

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; a row without id isn't held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learn from the text and language of the rows that aren't held out and have both.

    Inverse document frequencies count all these rows. The centroids of a language are clustered
    from about `sample` of its rows, or from all if there are no more; the pick is by hash. None
    if there is no row to learn from.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter(~held_out("id") & F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull()).select("text", "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    counted = known.select("text").mapInArrow(_frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = np.zeros(BUCKETS)
    for row in counted.collect():
        frequency[row["bucket"]] = row["n"]
    idf = np.log((sum(sizes.values()) + 1) / (frequency + 1)) + 1
    draw = F.pmod(F.xxhash64("text", F.lit("centroid")), F.lit(1 << 53)) / float(1 << 53)
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, sample / n)])
    picked = known.withColumn("draw", draw).filter(F.col("draw") < F.element_at(rate, F.col("lang")))
    rows = picked.groupBy("lang").applyInArrow(_clustered(idf), "lang string, k int, weights array<float>, floor array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["k"]))
    if not rows:
        return None
    centers = np.array([r["weights"] for r in rows])
    return Model(idf, [r["lang"] for r in rows], centers, np.array([r["floor"] for r in rows]))


def _identified(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = None if model is None else np.ascontiguousarray(model.centroids.T)
        for batch in small_batches(batches, "__text"):
            at = batch.schema.get_field_index("__text")
            data, offsets = bytes_of(batch.column(at))
            letters = batch.column(batch.schema.get_field_index("__letter")).to_pylist()
            langs, scores, rejected = [], [], []
            for i, letter in enumerate(letters):
                if not letter or model is None:
                    langs.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                seen, weights = vector(data[offsets[i] : offsets[i + 1]], model.idf)
                near = weights @ by_bucket[seen]
                best = int(near.argmax())
                langs.append(model.langs[best])
                scores.append(min(1.0, max(0.0, float(near[best]))))
                rejected.append(bool(near[best] < REJECT * model.floors[best][length_of(seen)]) if len(seen) else True)
            kept = [i for i, f in enumerate(batch.schema) if f.name not in ("__text", "__letter")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                [*(batch.schema.field(i).name for i in kept), "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model | None, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns named, with `lang_pred`, `score` (cosine, 0 to 1) and `rejected`.

    A text without any letter (also null or empty) is `und`, score 0 and rejected; so is every
    text without a model. Others get the language of the nearest centroid, the first by name of
    equals, and are rejected if they are farther from it than REJECT allows for their length. Texts are read whole.
    Repeated rows and null ids are rows like others; an empty table gives an empty result.
    """
    letter = F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")
    columns = [c for c in columns if c not in ("lang_pred", "score", "rejected")]
    slim = docs.select(*columns, F.col(text_col).alias("__text"), letter.alias("__letter"))
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return slim.mapInArrow(_identified(model), T.StructType([*(slim.schema[c] for c in columns), *more]))


def _accepted(model: Model | None, text: int):
    identified = _identified(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slim = pa.RecordBatch.from_arrays([batch.column(text), batch.column(batch.num_columns - 1)], ["__text", "__letter"])
            rejected = pa.concat_arrays([b.column(2) for b in identified(iter([slim]))]) if batch.num_rows else pa.array([], pa.bool_())
            kept = batch.filter(pc.invert(rejected))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

    return run


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that `identify` doesn't reject."""
    letter = F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")
    return docs.withColumn("__letter", letter).mapInArrow(_accepted(model, docs.columns.index(text_col)), docs.schema)
