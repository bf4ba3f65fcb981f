"""Packed ids: bits, segments, files and the whole round trip."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import pyarrow as pa
from cleanframe.llm import packing
from cleanframe.llm.tokens import tokenizer


@given(st.integers(1, 32), st.data())
@settings(max_examples=60, deadline=None)
def test_bits_there_and_back(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << width) - 1), max_size=70)), np.uint32)
    packed = packing.pack(ids, width)
    assert len(packed) == -(-len(ids) // 8) * width
    assert packing.unpack(packed, width)[: len(ids)].tolist() == ids.tolist()
    whole = sum(int(x) << (i * width) for i, x in enumerate(ids))
    assert int.from_bytes(packed, "little") == whole


def test_the_fewest_bits():
    assert [packing.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


PARTS = ["a", "Word", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", " ", "　", "é", "́", "<|endoftext|>", "<|startof", "text|>", "'S", "don't", "12", "İ", "\U0001f600", "...", "Σ"]


@given(st.lists(st.text(max_size=8) | st.lists(st.sampled_from(PARTS), max_size=8).map("".join), max_size=6))
@settings(max_examples=150, deadline=None)
def test_segments_give_the_ids_of_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    made = tokenizer(packing.VOCABULARY)
    ids, sizes = packing.SegmentIds(made, most=5).encode(pa.array(texts, pa.string()))
    want = [made.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_segments_are_encoded_many_at_a_time():
    made, seen = tokenizer(packing.VOCABULARY), []

    class Counted:
        encode = made.encode

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return made.encode_batch_fast(texts, **options)

    texts = [f"w{i}, Ǆ{i} \u0301x{i}  <|endoftext|>{i}<|startof {i}.\u3000{i}" for i in range(3000)]
    want = [made.encode(t, add_special_tokens=False).ids for t in texts]
    ids, sizes = packing.SegmentIds(Counted()).encode(pa.array(texts))
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert 0 < len(seen) < 100
    odd = ["\0", "a\0b \0 c", *texts[:900], "x\0"]
    want = [made.encode(t, add_special_tokens=False).ids for t in odd]
    ids, sizes = packing.SegmentIds(Counted()).encode(pa.array(odd))
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("file_bytes, block", [(1 << 26, 1 << 16), (4000, 16)])
def test_files_give_back_all_ids(spark, tmp_path, file_bytes, block):
    chance = random.Random(block)
    texts = [" ".join(chance.choices(["One", "two,", "<|endoftext|>", "café", "\n", "x" * 40], k=chance.choice((0, 1, 9, 400)))) for _ in range(300)]
    rows = [(i * 7 % 300, t) for i, t in enumerate(texts)] + [(None, "nobody's"), (None, None), (301, None), (302, ""), (303, "same"), (303, "same"), (303, "other")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, ids int").repartition(5)
    made, path = tokenizer(packing.VOCABULARY), str(tmp_path / "packed")
    packing.write_packed(docs, path, file_bytes=file_bytes, block=block)
    told = packing.manifest(path)
    assert told["width"] == 16 and told["block"] == block and (len(told["files"]) > 3) == (file_bytes < 5000)
    got = packing.read_packed(spark, path).orderBy("start").collect()
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    start, whole = 0, []
    encoded = {}
    for i, t in rows:
        encoded.setdefault(i, []).append(made.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == start and r["n_tokens"] == len(ids)
        encoded[r["doc_id"]].remove(ids)
        whole += ids
        start += len(ids)
    assert not any(encoded.values()) and start == told["ids"]
    for _ in range(20):
        lo = chance.randrange(start)
        hi = min(start, lo + chance.choice((1, 15, 3000)))
        assert packing.read_ids(path, lo, hi).tolist() == whole[lo:hi]


def test_replacing_empty_tables_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one")], "name string, body string")
    path = str(tmp_path / "packed")
    for end, rows in ((1, [("a", 0, 2), ("b", 2, 3)]), (None, [("a", 0, 1), ("b", 1, 2)])):
        packing.write_packed(docs, f"file://{path}", "name", "body", end=end)
        back = packing.read_packed(spark, path)
        assert [tuple(r)[:3] for r in back.orderBy("start").collect()] == rows
    assert len(list((tmp_path / "packed").glob("*.ids"))) == len(packing.manifest(path)["files"])
    name = tmp_path / "packed" / packing.manifest(path)["files"][0]["name"]
    whole = bytearray(name.read_bytes())
    whole[len(packing.MAGIC)] ^= 1
    name.write_bytes(whole)
    with pytest.raises(ValueError, match="damaged"):
        packing.read_ids(path, 0, 1)
    packing.write_packed(docs.limit(0), path, "name", "body")
    assert packing.read_packed(spark, path).count() == 0 and not list((tmp_path / "packed").glob("*.ids"))


def test_the_query_against_whole_encodings(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in entry.queries()["op11_bit_packing"](spark, folder).collect()}
    made, start, want = tokenizer(packing.VOCABULARY), 0, {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        ids = made.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
