"""Ranked lexical search against a plain scoring of all pairs."""

import math
import random
import re
from collections import Counter

import pytest

from cleanframe.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(docs, items, most):
    """{(item, rank): (id, score)}; documents that tie in id and score are alike."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = {}
    for item, wanted in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        for rank, (score, known, i) in enumerate(sorted(scored)[:most], 1):
            out[item, rank] = (i if known else None, -score)
    return out


@pytest.mark.parametrize("pairs_at_once, most", [(1_000_000, 10), (12, 3)])
def test_ranks_are_those_of_all_pairs(spark, pairs_at_once, most):
    chance = random.Random(most)
    words = ["The", "the", "cat", "Cat", "café", "CAFÉ", "x1", "naïve", "日本", "a", "\U0001f600z", "w"]
    made = lambda n: "".join(chance.choice(words) + chance.choice((" ", "-", "\n", "  ", "_", ".", "é", "\x7f")) for _ in range(n))
    docs = [(i, made(chance.choice((0, 1, 3, 30)))) for i in range(200)]
    docs += [(300 + i, "cat cat naïve") for i in range(40)] + [(None, "cat cat naïve"), (None, None), (500, None), (501, ""), (502, "- ."), (7, "the cat"), (7, "the cat")]
    docs += [(600, "naïve " * 50_000)]
    items = [(i, made(chance.choice((1, 4, 9)))) for i in range(12)] + [(None, "cat"), (None, "x1"), (3, "naïve"), (20, None), (21, "..."), (22, "unknown")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(5)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = lexical.rank(frame, asked, most=most, pairs_at_once=pairs_at_once).collect()
    assert {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got} == plain(docs, items, most)
    assert len({(r["item_id"], r["rank"]) for r in got}) == len(got)


def test_empty_tables_and_other_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "three")], "name string, body string")
    items = spark.createDataFrame([("q", "One"), (None, "nothing")], "q string, text string")
    got = lexical.rank(docs, items, "name", "body", "q").orderBy("rank").collect()
    assert [(r["q"], r["rank"], r["name"]) for r in got] == [("q", 1, "a"), ("q", 2, "b")]
    assert lexical.rank(docs.limit(0), items, "name", "body", "q").count() == 0
    assert lexical.rank(docs, items.limit(0), "name", "body", "q").count() == 0
    assert lexical.rank(docs, items.filter("q is null"), "name", "body", "q").count() == 0
