"""Words of whole Arrow text columns by numpy, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; a longer single word is hashed alone.
PIECE = 1 << 18
#: Bytes of text that an operator takes at a time. It makes arrays of some ten times that, and a Python
#: worker keeps what it once took while later stages run beside it.
BATCH = 1 << 21

_BYTES = np.arange(256)
#: `[^\x20\x09-\x0D]`; these bytes never occur inside a longer UTF-8 character.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: ASCII letters and digits, and all characters beyond ASCII.
ALPHANUMERIC = (
    ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
)
#: A-Z to a-z.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """n numbers that depend on the seed only."""
    return mix(mix(np.arange(1, n + 1, dtype=np.uint64)) + np.uint64(seed)) | np.uint64(1)


_LETTERS = salts(256, 1)[LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one piece, and where each row begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that cut no word."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n:
            gaps = np.flatnonzero(~is_word[data[lo:hi]])
            at = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            cut = max(at, lo + int(gaps[-1]) + 1 if len(gaps) else lo)
            if cut > lo:
                hi = cut
                break
            hi = min(n, hi + PIECE)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lower-cased, and the row it is in, in order."""
    hashes, rows = [], []
    for lo, hi in _pieces(data, offsets, is_word):
        part = data[lo:hi]
        inside = is_word[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offsets[(offsets >= lo) & (offsets < hi)] - lo
        begins[at] |= inside[at]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        first = starts[0]
        place = np.arange(first, len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))
        powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
        values = _LETTERS[part[first:]] * powers[place]
        values[~inside[first:]] = 0
        hashes.append(mix(np.add.reduceat(values, starts - first)))
        rows.append(np.searchsorted(offsets, starts + lo, "right") - 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins and ends in an array sorted by row."""
    return np.searchsorted(rows, np.arange(n + 1))


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `limit` bytes of text at most (or one row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
