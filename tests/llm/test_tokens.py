"""Token counts against the tokenizer's library."""

import random

import pytest

from cleanframe.llm import tokens
from pyspark.sql import functions as F

PIECES = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "é", "日本", "<|endoftext|>", "<|end", "oftext|>", "\t", "😀", ".", "!!", " \n ", "\x1c", " "]


@pytest.fixture(scope="module")
def encode():
    made = tokens.tokenizer(tokens.VOCABULARY)
    return lambda text: made.encode(text, add_special_tokens=False)


def test_spliced_counts_are_exact(encode):
    chance = random.Random(1)
    for _ in range(600):
        text = "".join(chance.choices(PIECES, k=chance.randint(10, 200)))
        for chunk, overlap in ((40, 8), (100, 10), (25, 20)):
            assert tokens.spliced_count(encode, text, chunk, overlap, 14) == len(encode(text).ids)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "ab " * 3000, " \n" * 3000, "1" * 3000, "<|endoftext|>" * 900, "é" * 4000])
def test_overlaps_widen_where_nothing_aligns(encode, text):
    for chunk in (100, 1000):
        assert tokens.spliced_count(encode, text, chunk, 10, 14) == len(encode(text).ids)


def test_counts_of_a_table(spark, encode):
    chance = random.Random(2)
    given = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    made = ["".join(chance.choices(PIECES, k=chance.randint(0, 60))) for _ in range(2000)]
    texts = [None, "", " ", " a", "a ", " ".join(given), *given, *made, *made[:10]]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = tokens.count_tokens(docs, chunk=20_000, overlap=200)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect())
    want = []
    for i, t, _ in rows:
        n = len(encode(t or "").ids)
        want.append((i or -1, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert tokens.count_tokens(docs.filter(F.lit(False))).count() == 0
