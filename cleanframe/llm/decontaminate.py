"""Benchmark passages in documents: latent semantic retrieval, then subsequence and answer checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .store import stored
from .text import ALPHANUMERIC, bounds, bytes_of, small_batches, words

#: Hash buckets of words in the TF-IDF model.
BUCKETS = 1 << 16
#: Benchmark passages with one latent space; many make several blocks.
BLOCK = 256
#: Blocks that go through the documents together; more take further passes.
TOGETHER = 16
#: Dimensions of a latent space, further random ones, and power iterations of its randomised SVD.
RANK, EXTRA, POWER = 64, 16, 2
#: A passage of whose squared norm a block's space holds less than this part goes into a further space, of RANK passages.
HELD = 0.2
#: Words in more than this part of all documents have no say, but for passages that consist mostly of such.
COMMON = 0.1
#: No word weighs more than so many times the mean of the passages' words, lest a few replaced words hide a passage.
HEAVIEST = 1.5
#: Words in a step; windows are 2, 4, 8 and so on steps long, up to the longest passage, and overlap by half.
STEP, SHORTEST = 8, 2
#: Cosine from which a window and a passage are compared word by word.
NEAR = 0.4
#: A passage is found if so much of it is a common subsequence, or less with so much of its answer.
MOST, MUCH, ANSWER = 0.8, 0.6, 0.6
SEED = 5


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, n = np.zeros(BUCKETS, np.int64), 0
    for batch in small_batches(batches, "text"):
        hashes, rows = words(*bytes_of(batch.column(0)), ALPHANUMERIC)
        found += np.bincount(np.unique(rows * BUCKETS + _buckets(hashes)) % BUCKETS, minlength=BUCKETS)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.append(n, found))], ["bucket", "n"])


def weights(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequency of each bucket over all documents, and which are common."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_frequencies, "bucket bigint, n bigint")
    rows = {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n = rows.get(-1, 0)
    frequency = np.array([rows.get(i, 0) for i in range(BUCKETS)])
    return np.maximum(np.log((n + 1) / (frequency + 1)), 0.05), frequency > max(COMMON * n, 2)


def randomized_svd(matrix: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """The first `rank` right singular vectors, by random projection and power iterations
    (Halko, Martinsson and Tropp, 2011)."""
    rank = min(rank, *matrix.shape)
    start = np.random.default_rng(seed).standard_normal((matrix.shape[1], min(rank + EXTRA, matrix.shape[1])))
    basis = np.linalg.qr(matrix.T @ (matrix @ start))[0]
    for _ in range(POWER):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    return basis @ np.linalg.svd(matrix @ basis, full_matrices=False)[2][:rank].T


@dataclass
class Space:
    """A latent space of passages of one block."""

    ids: list
    cap: float  # no word weighs more
    place: np.ndarray  # of each bucket in `vectors`, or -1
    vectors: np.ndarray  # one row per word that has a say
    latent: np.ndarray  # one row per passage, divided by the part of its norm that the space holds
    steps: np.ndarray  # length of window for each passage
    words: list[np.ndarray]
    answers: list[np.ndarray]


def _space(idf: np.ndarray, common: np.ndarray):
    """A block's latent spaces, each as one row of bytes. A block has about BLOCK passages.

    The first space spans all of them and has those it holds HELD of. The others, of which many other
    passages leave no room for, come in spaces of RANK passages, which hold them whole.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending")]).combine_chunks()
        hashes, rows = words(*bytes_of(table.column("text")), ALPHANUMERIC)
        cap = HEAVIEST * float(idf[_buckets(hashes)].mean()) if len(hashes) else 1.0
        weight = np.minimum(idf, cap)
        answer_hashes, answer_rows = words(*bytes_of(table.column("answer")), ALPHANUMERIC)
        n, buckets = table.num_rows, _buckets(hashes)
        norms = np.sqrt(np.bincount(rows, weight[buckets] ** 2, minlength=n)) + 1e-12
        rare = np.bincount(rows, weight[buckets] ** 2 * ~common[buckets], minlength=n)
        plain = rare < norms**2 / 2  # passages that are told by their common words
        told = ~common[buckets] | plain[rows]
        at, answer_at = bounds(rows, n), bounds(answer_rows, n)

        def spanned(members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Buckets that have a say among the members, the basis, latent vectors and the part of each norm held."""
            order = np.full(n, -1, np.int64)
            order[members] = np.arange(len(members))
            some = told & (order[rows] >= 0)
            useful = np.unique(buckets[some])
            place = np.full(BUCKETS, -1, np.int64)
            place[useful] = np.arange(len(useful))
            matrix = np.zeros((len(members), max(len(useful), 1)))
            np.add.at(matrix, (order[rows[some]], place[buckets[some]]), weight[buckets[some]])
            matrix /= norms[members, None]
            basis = randomized_svd(matrix, RANK, SEED)
            latent = matrix @ basis
            held = (latent**2).sum(axis=1)
            return useful, basis, latent / np.maximum(held, 1e-12)[:, None], held / np.maximum((matrix**2).sum(axis=1), 1e-12)

        everyone = np.arange(n)
        useful, basis, latent, held = spanned(everyone)
        badly = everyone[(held < HELD) & (np.bincount(rows[told], minlength=n) > 0)]
        well = np.setdiff1d(everyone, badly)
        made = [(well, useful, basis, latent[well])]
        for lo in range(0, len(badly), RANK):
            members = badly[lo : lo + RANK]
            made.append((members, *spanned(members)[:3]))
        ids = table.column("id")
        answers = [answer_hashes[answer_at[i] : answer_at[i + 1]].view(np.int64) for i in range(n)]
        lists = pa.list_(pa.list_(pa.int64()))
        return pa.table(
            {
                "block": [table.column("block")[0].as_py()] * len(made),
                "cap": [cap] * len(made),
                "ids": pa.array([ids.take(pa.array(m)).to_pylist() for m, *_ in made], pa.list_(table.schema.field("id").type)),
                "useful": pa.array([u for _, u, *_ in made], pa.list_(pa.int64())),
                "vectors": [(weight[u][:, None] * b[: len(u)]).astype(np.float32).tobytes() for _, u, b, _ in made],
                "latent": [x.astype(np.float32).tobytes() for *_, x in made],
                "words": pa.array([[hashes[at[i] : at[i + 1]].view(np.int64) for i in m] for m, *_ in made], lists),
                "answers": pa.array([[answers[i] for i in m] for m, *_ in made], lists),
            }
        )

    return run


def spaces(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, text_col: str = "text") -> tuple[np.ndarray, DataFrame]:
    """Word weights over all documents, and a table of the latent spaces of the benchmark's blocks."""
    idf, common = weights(docs, text_col)
    items = benchmark.select(
        F.col(item_col).alias("id"),
        F.coalesce(F.col(item_text), F.lit("")).alias("text"),
        (F.col(answer_col) if answer_col else F.lit("")).alias("answer"),
    )
    blocks = max(1, math.ceil(items.count() / BLOCK))
    # the pick of a block by hash, so that blocks have about the same number of passages
    drawn = items.withColumn("draw", F.xxhash64("text", "answer", F.col("id").cast("string"))).withColumn("block", F.pmod("draw", F.lit(blocks)))
    kind = items.schema["id"].dataType.simpleString()
    schema = f"block bigint, cap double, ids array<{kind}>, useful array<bigint>, vectors binary, latent binary, words array<array<bigint>>, answers array<array<bigint>>"
    return idf, stored(drawn.groupBy("block").applyInArrow(_space(idf, common), schema))


def window_of(length: int) -> int:
    """Steps of the windows that a passage of so many words is compared with."""
    k = SHORTEST
    while length > k * STEP * 1.4:
        k *= 2
    return k


def _opened(row) -> Space:
    useful = np.array(row["useful"], np.int64)
    place = np.full(BUCKETS, -1, np.int64)
    place[useful] = np.arange(len(useful))
    known = [np.array(w, np.int64) for w in row["words"]]
    n = len(known)
    latent = np.frombuffer(row["latent"], np.float32).reshape(n, -1)
    given = [np.array(w, np.int64) for w in row["answers"]]
    answers = [a if len(a) else w[-max(3, len(w) // 4) :] for a, w in zip(given, known)]
    steps = np.array([window_of(len(w)) for w in known])
    vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, latent.shape[1])
    return Space(list(row["ids"]), row["cap"], place, vectors, latent, steps, known, answers)


def common_subsequence(masks: dict, length: int, other: list) -> int:
    """Length of the longest common subsequence, bit-parallel; masks has the places of each word."""
    ones = (1 << length) - 1
    left = ones
    for word in other:
        hit = masks.get(word)
        if hit is not None:
            both = left & hit
            left = ((left + both) | (left - both)) & ones
    return length - left.bit_count()


def _masks(values: np.ndarray) -> dict:
    out: dict = {}
    for i, w in enumerate(values.tolist()):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def candidates(space: Space, idf: np.ndarray, buckets: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, passage, first word, end, cosine) of all windows near a passage in the latent space.

    Each row's words fall into steps; a window is several steps. `at` has where each row's words begin.
    """
    n = len(at) - 1
    lengths = np.diff(at)
    steps = -(-lengths // STEP)
    base = np.concatenate([[0], np.cumsum(steps)])
    row_of = np.repeat(np.arange(n), lengths)
    step_of = base[row_of] + (np.arange(len(buckets)) - at[row_of]) // STEP
    norm = np.bincount(step_of, np.minimum(idf, space.cap)[buckets] ** 2, minlength=base[-1])
    told = np.flatnonzero(space.place[buckets] >= 0)
    sums = np.zeros((base[-1], space.vectors.shape[1]), np.float32)
    if len(told):
        owner = step_of[told]
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sums[owner[heads]] = np.add.reduceat(space.vectors[space.place[buckets[told]]], heads, axis=0)
    rows = np.repeat(np.arange(n), steps)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(steps) - steps, steps)
    k = SHORTEST
    while len(rows) and k <= space.steps.max(initial=0):
        # sums and norm hold half windows; a window is one and the next of its row
        more = np.append(rows[1:] == rows[:-1], False)
        window, size = sums.copy(), norm.copy()
        window[:-1] += sums[1:] * more[:-1, None]
        size[:-1] += norm[1:] * more[:-1]
        yield from _near(space, k, rows, first, window, np.sqrt(size) + 1e-12, lengths)
        whole = first % k == 0
        rows, first, sums, norm, k = rows[whole], first[whole], window[whole], size[whole], 2 * k


def _near(space: Space, k: int, rows: np.ndarray, first: np.ndarray, window: np.ndarray, size: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """What `candidates` gives for the windows of k steps."""
    items = np.flatnonzero(space.steps == k)
    if not len(items):
        return
    reach = np.linalg.norm(space.latent[items], axis=1).max(initial=0.0)
    hot = np.flatnonzero(np.linalg.norm(window, axis=1) * reach >= NEAR * size)  # others can't be near
    cosine = (window[hot] / size[hot, None]) @ space.latent[items].T
    for i, j in zip(*np.nonzero(cosine >= NEAR)):
        row = int(rows[hot[i]])
        begin = int(first[hot[i]]) * STEP
        yield row, int(items[j]), begin, min(begin + k * STEP, int(lengths[row])), float(cosine[i, j])


def found_in(spaces: list[Space], idf: np.ndarray, texts: pa.Array) -> dict:
    """(row, space, passage) -> (cosine, part of the passage, part of the answer) of what is found."""
    hashes, rows = words(*bytes_of(texts), ALPHANUMERIC)
    at, buckets, signed = bounds(rows, len(texts)), _buckets(hashes), hashes.view(np.int64)
    out: dict = {}
    for number, space in enumerate(spaces):
        masks: dict = {}
        for row, item, begin, end, cosine in candidates(space, idf, buckets, at):
            length = len(space.words[item])
            if item not in masks:
                masks[item] = _masks(space.words[item]), _masks(space.answers[item])
            side = max(length - (end - begin), 0) + STEP + length // 4
            span = signed[max(at[row], at[row] + begin - side) : min(at[row + 1], at[row] + end + side)].tolist()
            part = common_subsequence(masks[item][0], length, span) / length
            if part < MUCH:
                continue
            answer = common_subsequence(masks[item][1], len(space.answers[item]), span) / max(len(space.answers[item]), 1)
            if part >= MOST or answer >= ANSWER:
                known = out.get((row, number, item))
                if known is None or (part, cosine) > (known[1], known[0]):
                    out[row, number, item] = cosine, part, answer
    return out


def _pairs(rows: list, idf: np.ndarray, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [_opened(r) for r in rows]
        for batch in small_batches(batches, "__text"):
            found = found_in(opened, idf, batch.column(1))
            keys, values = list(found), list(found.values())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())),
                    pa.array([opened[k[1]].ids[k[2]] for k in keys], kinds.field("item").type),
                    *(pa.array([v[i] for v in values], pa.float64()) for i in range(3)),
                ],
                schema=pa.schema([batch.schema.field(0), *(kinds.field(i) for i in range(4))]),
            )

    return run


def _unspoiled(rows: list, idf: np.ndarray, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [_opened(r) for r in rows]
        for batch in small_batches(batches, text_col):
            keep = np.ones(batch.num_rows, bool)
            keep[[k[0] for k in found_in(opened, idf, batch.column(batch.schema.get_field_index(text_col)))]] = False
            yield batch.filter(pa.array(keep))

    return run


def _passes(made: DataFrame) -> Iterator[list]:
    """The spaces in lots of TOGETHER, each at most some MB."""
    numbers = sorted({r["block"] for r in made.select("block").collect()})
    for i in range(0, len(numbers), TOGETHER):
        yield [r.asDict() for r in made.filter(F.col("block").isin(numbers[i : i + TOGETHER])).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """(id, item, `similarity`, `subsequence`, `answer`) for each document and passage found in it.

    TF-IDF weights count all documents. The passages of a block span a latent space by randomised
    SVD, and those it holds badly further ones (see `_space`); all overlapping windows of all documents, as long as the passage or somewhat longer, are
    compared in it by cosine. A near window is confirmed if the longest common subsequence of
    words with the passage covers MOST of it, or MUCH of it while that with its answer covers
    ANSWER of the answer (the answer column, or the last quarter of the passage, three words at least).
    Paraphrases with words put in, left out or replaced are found that way; words compare in lower case.

    Null and empty texts hold nothing, and passages without words are never found. Repeated
    documents and passages give a row each; null ids stay null. An empty table on either side gives
    an empty result. Other columns aren't read.
    """
    idf, made = spaces(docs, benchmark, item_col, item_text, answer_col, text_col)
    item = benchmark.schema[item_col]
    slim = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    out = T.StructType(
        [docs.schema[id_col], T.StructField(item_col, item.dataType), *(T.StructField(c, T.DoubleType()) for c in ("similarity", "subsequence", "answer"))]
    )
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = pa.schema([("item", to_arrow_type(item.dataType)), *((c, pa.float64()) for c in ("similarity", "subsequence", "answer"))])
    kinds = kinds.set(0, kinds.field(0).with_name("item"))
    found = docs.sparkSession.createDataFrame([], out)
    for lot in _passes(made):
        found = found.unionByName(slim.mapInArrow(_pairs(lot, idf, kinds), out))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs`, all columns, in which no passage is found (see `leaks`)."""
    idf, made = spaces(docs, benchmark, text_col=text_col, **how)
    kept = docs
    for lot in _passes(made):
        kept = kept.mapInArrow(_unspoiled(lot, idf, text_col), docs.schema)
    return kept
