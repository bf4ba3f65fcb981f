"""Token ids of whole documents in files of fixed-width bits, as a Spark data source.

A file holds, in this order: the magic word; blocks of `block` ids, each id in `width` bits from the
lowest bit on, so that 8 ids fill `width` bytes and every block begins at a byte; the documents, as
one Arrow record batch of (id, first id in the file); offset and CRC-32 of every block; and a tail of
fixed size that tells where these are. Any id is found without reading what stands before it. A
folder's `_manifest.json` lists its files in order with the number of ids before each.
"""

from __future__ import annotations

import io
import json
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .text import bytes_of, small_batches
from .tokens import tokenizer

VOCABULARY = "word_bpe_49k.json"
#: The id after each document.
END = 1
#: Ids in a block, a multiple of 8.
BLOCK = 1 << 16
#: Bytes of text in a file, about.
FILE_BYTES = 64 << 20
MAGIC = b"CFPACK01"
#: A word that no other merges with, for between segments.
MARK = "\0"
#: ids, documents, where documents and blocks are described, width, ids in a block, magic word.
TAIL = "<QQQQII8s"
MANIFEST = "_manifest.json"

_BYTES = np.arange(256)
#: ASCII white space becomes a blank.
BLANK = np.where((_BYTES >= 0x09) & (_BYTES <= 0x0D), 0x20, _BYTES).astype(np.uint8)


def bits_for(size: int) -> int:
    """The fewest bits that tell `size` ids apart."""
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """`width` bits for each id; the last 8 ids are filled up with zeros."""
    rows = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), width), np.uint8)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        word = rows[:, j] << np.uint64(shift)
        for k in range(first, (j * width + width - 1) // 8 + 1):
            out[:, k] |= (word >> np.uint64(8 * (k - first))).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    """The ids of packed bytes, a multiple of 8."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.empty((len(rows), 8), np.uint32)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        word = rows[:, first].astype(np.uint64)
        for k in range(first + 1, (j * width + width - 1) // 8 + 1):
            word |= rows[:, k].astype(np.uint64) << np.uint64(8 * (k - first))
        out[:, j] = (word >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.reshape(-1)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Where a Hadoop path lies for Arrow."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class PackedFile:
    """One file, read from any place in it."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        size = source.size()
        source.seek(size - struct.calcsize(TAIL))
        self.n_ids, self.n_docs, docs_at, blocks_at, self.width, self.block, magic = struct.unpack(TAIL, source.read(struct.calcsize(TAIL)))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids, or cut off")
        source.seek(docs_at)
        self.docs = pa.ipc.open_stream(source.read(blocks_at - docs_at)).read_all().combine_chunks()
        source.seek(blocks_at)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(source.read(8 * (n_blocks + 1)), np.int64)
        self.checks = np.frombuffer(source.read(4 * n_blocks), np.uint32)
        self.starts = np.append(self.docs.column("start").to_numpy(), self.n_ids)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to before stop; only the blocks that hold them are read."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        for b in range(first, last + 1):
            lo, hi = (int(self.offsets[i] - self.offsets[first]) for i in (b, b + 1))
            if zlib.crc32(data[lo:hi]) != self.checks[b]:
                raise ValueError(f"block {b} is damaged")
        return unpack(data, self.width)[start - first * self.block : stop - first * self.block]

    def groups(self, most: int) -> Iterator[tuple[int, int]]:
        """Runs of documents of about `most` ids together, or of one document."""
        lo = 0
        while lo < self.n_docs:
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + most, "right")) - 1)
            yield lo, hi
            lo = hi


@dataclass
class Written(WriterCommitMessage):
    order: int
    name: str
    n_ids: int
    n_docs: int


@dataclass
class FilePart(InputPartition):
    name: str
    first: int
    id: str


class PackedWriter(DataSourceArrowWriter):
    """Every task writes one file of its rows in their order; they count once the manifest names them.

    Rows are (id, text), to be encoded by the `vocabulary` with the `end` id after each, or without a
    vocabulary (id, binary) of ids.
    """

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.width, self.block = options["path"], int(options["width"]), int(options.get("block", BLOCK))
        self.id_type = schema.fields[0].dataType.simpleString()
        self.id_name, self.run = schema.fields[0].name, uuid.uuid4().hex
        end = options.get("end")
        self.vocabulary, self.end = options.get("vocabulary"), None if end is None else int(end)

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        return encoded(batches, self.vocabulary, self.end) if self.vocabulary else _given(batches)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{self.run}.ids"
        system, base = filesystem(self.path)
        system.create_dir(base, recursive=True)
        offsets, checks, docs, starts, n_ids, rest = [len(MAGIC)], [], [], [], 0, np.zeros(0, np.uint32)
        with system.open_output_stream(f"{base}/{name}") as out:
            out.write(MAGIC)

            def put(ids: np.ndarray) -> None:
                data = pack(ids, self.width)
                out.write(data)
                offsets.append(offsets[-1] + len(data))
                checks.append(zlib.crc32(data))

            for names, ids, sizes in self.rows(iterator):
                ends = n_ids + len(rest) + np.cumsum(sizes, dtype=np.int64)
                docs.append(names)
                starts.append(ends - sizes)
                ids = np.concatenate([rest, ids])
                whole = len(ids) // self.block * self.block
                for lo in range(0, whole, self.block):
                    put(ids[lo : lo + self.block])
                n_ids, rest = n_ids + whole, ids[whole:].copy()
            if len(rest):
                put(rest)
            n_ids += len(rest)
            docs_at, sink = offsets[-1], io.BytesIO()
            if docs:
                table = pa.table([pa.chunked_array(docs), pa.array(np.concatenate(starts), pa.int64())], names=["id", "start"])
                with pa.ipc.new_stream(sink, table.schema) as stream:
                    stream.write_table(table)
            out.write(sink.getvalue())
            out.write(np.array(offsets, np.int64).tobytes())
            out.write(np.array(checks, np.uint32).tobytes())
            n_docs = sum(map(len, docs))
            out.write(struct.pack(TAIL, n_ids, n_docs, docs_at, docs_at + len(sink.getvalue()), self.width, self.block, MAGIC))
        return Written(task.partitionId(), name, n_ids, n_docs)

    def commit(self, messages: list) -> None:
        files, first = [], 0
        for m in sorted((m for m in messages if m is not None and m.n_docs), key=lambda m: m.order):
            files.append({"name": m.name, "first": first, "ids": m.n_ids, "docs": m.n_docs})
            first += m.n_ids
        told = {"id": self.id_name, "type": self.id_type, "width": self.width, "block": self.block, "ids": first, "files": files}
        system, base = filesystem(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{MANIFEST}.{self.run}") as out:
            out.write(json.dumps(told).encode())
        system.move(f"{base}/{MANIFEST}.{self.run}", f"{base}/{MANIFEST}")
        named = {f["name"] for f in files}
        for info in system.get_file_info(fs.FileSelector(base)):  # earlier tables and lost attempts
            if info.base_name.endswith(".ids") and info.base_name not in named:
                system.delete_file(info.path)

    def abort(self, messages: list) -> None:
        system, base = filesystem(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{base}/{m.name}")


class PackedReader(DataSourceReader):
    """One task a file; rows come in the files' order within a task."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("ids_at_once", 1 << 21))

    def partitions(self) -> list[FilePart]:
        told = manifest(self.path)
        return [FilePart(f["name"], f["first"], told["id"]) for f in told["files"]]

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file
            return
        system, base = filesystem(self.path)
        with system.open_input_file(f"{base}/{part.name}") as source:
            file = PackedFile(source)
            for lo, hi in file.groups(self.most):
                starts = file.starts[lo : hi + 1]
                data = file.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
                ids = _binaries(data, 4 * (starts - starts[0]))
                columns = [
                    file.docs.column("id").slice(lo, hi - lo).combine_chunks(),
                    pa.array(starts[:-1] + part.first, pa.int64()),
                    pa.array(np.diff(starts), pa.int64()),
                    ids,
                ]
                yield pa.RecordBatch.from_arrays(columns, [part.id, "start", "n_tokens", "ids"])


class PackedIds(DataSource):
    """`spark.read.format("packed_ids").load(folder)`: id, `start`, `n_tokens`, `ids` (little-endian unsigned 32-bit integers)."""

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        told = manifest(self.options["path"])
        return f"`{told['id']}` {told['type']}, start long, n_tokens long, ids binary"

    def reader(self, schema: T.StructType) -> PackedReader:
        return PackedReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> PackedWriter:
        if not overwrite:
            raise ValueError("packed ids are written whole: use mode('overwrite')")
        return PackedWriter(dict(self.options), schema)


def manifest(path: str) -> dict:
    system, base = filesystem(path)
    with system.open_input_stream(f"{base}/{MANIFEST}") as source:
        return json.loads(source.read())


def _binary(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all rows in one piece, and where each begins and ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(data or b"")[offsets[0] : offsets[-1]], offsets


def _binaries(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


class SegmentIds:
    """Ids of whole texts by those of their segments between ASCII white space, each encoded once.

    A vocabulary that drops white space (word_bpe_49k) merges nothing across it: no special string holds
    any, no letter composes with it, and words are cut there. So a text's ids are those of its
    segments. Up to about `most` segments of up to `longest` characters are remembered, as Arrow text.
    New ones are encoded as texts of `run` segments with a MARK after each, which is cheaper than a
    text for each; its id tells them apart.
    """

    def __init__(self, made, most: int = 500_000, longest: int = 64, at_once: int = 6_400, run: int = 400):
        self.made, self.most, self.longest, self.at_once, self.run = made, most, longest, at_once, run
        self.mark = made.encode(MARK, add_special_tokens=False).ids
        self.known = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encoded(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(segments), self.at_once):
            names = segments.slice(lo, self.at_once).to_pylist()
            runs = [names[i : i + self.run] for i in range(0, len(names), self.run)]
            made = self.made.encode_batch_fast([f" {MARK} ".join([*run, ""]) for run in runs], add_special_tokens=False)
            for run, e in zip(runs, made):
                found = np.array(e.ids, np.uint32)
                marks = found == self.mark[0] if len(self.mark) == 1 else np.zeros(len(found), bool)
                if np.count_nonzero(marks) == len(run):
                    ids.append(found[~marks])
                    sizes.append(np.diff(np.flatnonzero(marks), prepend=-1) - 1)
                else:  # a segment holds the mark itself
                    alone = [e.ids for e in self.made.encode_batch_fast(run, add_special_tokens=False)]
                    sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
                    ids.append(np.fromiter(chain.from_iterable(alone), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has; null is empty."""
        data, offsets = bytes_of(texts)
        plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(BLANK[data]))
        cut = pc.split_pattern(plain, " ")
        segments = cut.flatten()
        places = pc.index_in(segments, value_set=self.known)
        new = segments.filter(places.is_null()).dictionary_encode()
        places = places.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        places[places < 0] = len(self.known) + new.indices.to_numpy()
        ids, sizes = self._encoded(new.dictionary)
        all_ids, all_sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        out, per_segment = _taken(all_ids, all_sizes, places)
        if len(self.known) < self.most:
            short = pc.less_equal(pc.utf8_length(new.dictionary), self.longest)
            self.known = pa.concat_arrays([self.known, new.dictionary.filter(short)])
            kept = np.append(np.arange(len(self.sizes)), len(self.sizes) + np.flatnonzero(short.to_numpy(zero_copy_only=False)))
            self.ids, self.sizes = _taken(all_ids, all_sizes, kept)
        return out, np.diff(np.append(0, np.cumsum(per_segment))[np.asarray(cut.offsets)])


def _taken(ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the runs at `places`, of runs that lie side by side with the given sizes; and their sizes."""
    starts, each = np.cumsum(sizes) - sizes, sizes[places]
    ends = np.cumsum(each)
    return ids[np.repeat(starts[places] - ends + each, each) + np.arange(int(ends[-1]) if len(ends) else 0)], each


def encoded(batches: Iterator[pa.RecordBatch], name: str, end: int | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(documents, ids, how many of each document) of (id, text) batches."""
    # what a worker has learned outlives the task; Spark keeps workers for later tasks
    kept = vars(sys.modules.setdefault("cleanframe_worker", ModuleType("cleanframe_worker")))
    if ("ids", name) not in kept:
        kept["ids", name] = SegmentIds(tokenizer(name))
    for batch in batches:
        for part in small_batches(iter([batch]), batch.schema.field(1).name, 1 << 22):
            ids, sizes = kept["ids", name].encode(part.column(1))
            if end is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), end), sizes + 1
            yield part.column(0), ids, sizes


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The same of (id, binary ids) batches."""
    for batch in batches:
        data, offsets = _binary(batch.column(1))
        yield batch.column(0), np.frombuffer(data, "<u4"), np.diff(offsets) // 4


def write_packed(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end: int | None = END,
    file_bytes: int = FILE_BYTES,
    block: int = BLOCK,
) -> None:
    """Encode every whole text and write the ids, in ascending order of the ids of documents, to `path`.

    The vocabulary must drop white space, as word_bpe_49k does. Each token's id takes the fewest bits
    that the vocabulary's size allows. Texts are dealt once into ranges of the documents' ids, of
    about `file_bytes` of text; each range is sorted, encoded and written as one file by one task.
    Tasks that are repeated write files of their own, and the manifest, written last, names one file
    per range. A path that holds packed ids is replaced. The folder must be one that Arrow's file
    systems reach (local, HDFS, S3, GCS).

    Null and empty texts are documents with the end id alone (none, if `end` is None). Null ids sort
    first; rows with one id lie side by side in no order of meaning and may go on in the next file, so
    that no id makes a file grow. Other columns aren't read. An empty table gives a folder without files.
    """
    spark = docs.sparkSession
    made = tokenizer(vocabulary)
    size = 1 + max([end or 0, *made.get_vocab(with_added_tokens=True).values()])
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.monotonically_increasing_id().alias("__place"))
    order = [F.col("__id").asc_nulls_first(), F.col("__place").asc()]
    dealt = slim.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)
    spark.dataSource.register(PackedIds)
    out = dealt.select(F.col("__id").alias(id_col), F.col("__text").alias("text")).write.format("packed_ids").mode("overwrite")
    options = {"vocabulary": vocabulary, "width": bits_for(size), "block": block} | ({} if end is None else {"end": end})
    out.options(**options).save(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The documents of `path`: id, `start` (ids of all documents before it), `n_tokens`, `ids` (binary)."""
    spark.dataSource.register(PackedIds)
    return spark.read.format("packed_ids").load(path)


def read_ids(path: str, start: int, stop: int) -> np.ndarray:
    """The ids from start to before stop of the whole folder, on the driver: reads the blocks that hold them."""
    system, base = filesystem(path)
    out = [np.zeros(0, np.uint32)]
    for f in manifest(path)["files"]:
        lo, hi = max(start, f["first"]), min(stop, f["first"] + f["ids"])
        if lo < hi:
            with system.open_input_file(f"{base}/{f['name']}") as source:
                out.append(PackedFile(source).ids(lo - f["first"], hi - f["first"]))
    return np.concatenate(out)
