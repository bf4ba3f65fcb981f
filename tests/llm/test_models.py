"""Language identification and decontamination."""

import random
import zlib

import pytest

from cleanframe.llm import decontaminate, langid

from . import brute

FOLDER = "/root/testdata/sf0.001"


def test_held_out_languages_are_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    told = langid.identify(docs.withColumn("held_out", langid.held_out()), model, ["doc_id", "lang", "held_out"]).collect()
    assert len(told) == 1000
    held = [r for r in told if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in told)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in told)
    assert sum(r["rejected"] for r in told) <= 2
    again = langid.identify(docs.repartition(7), langid.train(docs.repartition(5)), ["doc_id"]).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in again} == {r["doc_id"]: r["lang_pred"] for r in told}


def test_awkward_texts(spark):
    words = {"aa": "the quick brown fox jumps over", "bb": "der schnelle braune fuchs springt"}
    rows = [(i, words[lang], lang, "x") for i in range(30) for lang in words]
    odd = [(100, None, "aa", "x"), (101, "", "aa", "x"), (102, "12 +! 3", "bb", "x"), (None, "The quick brown fox!", None, "x"), (103, "漢字漢字漢字漢字", None, "x")]
    odd += [(104, "the quick brown fox " * 20_000, None, "x"), (104, "the quick brown fox " * 20_000, None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    told = langid.identify(docs, model, docs.columns)
    assert told.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["rejected"]) for r in told.collect()}
    assert got[100, None] == got[101, ""] == got[102, "12 +! 3"] == ("und", True)
    assert got[None, "The quick brown fox!"][0] == got[104, odd[-1][1]][0] == "aa"
    assert got[103, "漢字漢字漢字漢字"][0] in words and got[103, "漢字漢字漢字漢字"][1]
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3
    assert langid.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model, ["doc_id"]).count() == 0


def test_other_languages_and_random_strings_are_rejected_for_their_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    chance = random.Random(2)
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. "
    turkish = "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler. "
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    foreign = [finnish, finnish * 8, turkish, turkish * 8, *("".join(chance.choices(letters, k=n)) for n in (300, 2000))]
    long = [r for r in docs.filter("length(text) > 400 and doc_id % 3 = 1").collect() if r["lang"]]
    short = [" ".join(r["text"].split()[5 : 5 + n]) for r in long[:40] for n in (3, 8, 20)]
    junk = [(-100 - i, chance.choice("xyz"), lang) for i, lang in enumerate(["en", "fr", "de", "es"])]
    model = langid.train(docs.unionByName(spark.createDataFrame(junk, docs.schema)))
    texts = spark.createDataFrame(list(enumerate(foreign + short)), "doc_id long, text string")
    rejected = {r["doc_id"] for r in langid.identify(texts, model, ["doc_id"]).collect() if r["rejected"]}
    assert set(range(len(foreign))) <= rejected
    assert len(rejected) <= len(foreign) + 0.05 * len(short)


def contaminated():
    """Documents with passages whole, changed and in part, and the ids with a leak."""
    chance = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "ptkbdg" for b in ("ar", "el", "ion", "us") for c in ("an", "o", "ist", "ek", "um", "y")]
    draw = lambda n: chance.choices(vocabulary, k=n)
    items = [(i, draw(n)) for i, n in enumerate((15, 20, 30, 38, 45, 60, 70, 40))]
    docs, leaks = [], set()

    def add(words, item=None):
        if item is not None:
            leaks.add((len(docs), item))
        docs.append(" ".join(words))

    for _ in range(150):
        add(draw(chance.randint(1, 400)))
    for i, words in items:
        for at in (0, 3, 100, 397):
            base = draw(400)
            add(base[:at] + words + base[at:], i)
        changed = list(words)
        for k in range(0, len(words), 8):
            changed[k] = "other"
        add(draw(50) + changed + draw(50), i)
        add(draw(30) + [x for w in words for x in ([w, "inserted"] if chance.random() < 0.15 else [w])] + draw(30), i)
        add(["X" + w for w in words] + draw(20))
        add(draw(40) + words[: len(words) // 3] + draw(40))
        shuffled = list(words)
        chance.shuffle(shuffled)
        add(draw(40) + shuffled + draw(40))
        add(words, i)
    return [(i, f"{' '.join(w).capitalize()}.") for i, w in items], docs, leaks


def test_leaks_are_found_and_others_left_alone(spark):
    items, docs, leaks = contaminated()
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(table.drop("item_id"), bench)
    assert found.columns == ["doc_id", "item_id", "similarity", "subsequence", "answer"]
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == leaks
    kept = decontaminate.decontaminated(table, bench)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in leaks}


def test_single_passages_beside_groups_of_variants_are_found(spark):
    chance = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40_000)]
    draw = lambda n: chance.choices(vocabulary, k=n)
    groups = [draw(30) for _ in range(70)]
    items = [[w if chance.random() < 0.95 else chance.choice(vocabulary) for w in group] for group in groups for _ in range(3)]
    items += [draw(30) for _ in range(46)]
    docs = [" ".join(draw(60) + words + draw(60)) for words in items] + [" ".join(draw(150)) for _ in range(200)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, bench).collect()}
    assert {(i, i) for i in range(len(items))} <= got
    assert all(doc < 210 and item // 3 == doc // 3 or doc == item for doc, item in got)


def test_long_passages_are_found(spark):
    chance = random.Random(6)
    vocabulary = [f"w{i}" for i in range(20_000)]
    draw = lambda n: chance.choices(vocabulary, k=n)
    items = [draw(n) for n in (40, 90, 150, 400, 700, 1000, 3000)]
    docs = []
    for words in items:
        for at in (0, 37, 900):
            docs.append(draw(at) + words + draw(300))
        docs.append(draw(211) + [x for w in words for x in ([w, "inserted"] if chance.random() < 0.1 else [w])] + draw(50))
        docs.append(draw(500) + ["other" if chance.random() < 0.1 else w for w in words] + draw(500))
    want = {(i, i // 5) for i in range(len(docs))}
    docs += [draw(100) + words[: len(words) // 3] + draw(400) for words in items] + [draw(chance.randint(1, 2000)) for _ in range(100)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, bench).collect()} == want


def test_given_passages_are_found(spark):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    items = [(r["item_id"], f" {' '.join(brute.plain_words(r['text']))} ") for r in bench.collect()]
    held = {r["doc_id"]: f" {' '.join(brute.plain_words(r['text']))} " for r in docs.collect()}
    want = {(d, i) for d, text in held.items() for i, item in items if item in text}
    assert want <= got and len(got - want) <= 1


@pytest.mark.parametrize("length", [1, 7, 64, 130])
def test_common_subsequence(length):
    chance = random.Random(length)
    for _ in range(50):
        a, b = chance.choices(range(6), k=length), chance.choices(range(7), k=chance.randint(0, 90))
        best = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
        import numpy as np

        assert decontaminate.common_subsequence(decontaminate._masks(np.array(a)), len(a), b) == best[-1]


def test_awkward_documents_and_benchmarks(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [(1, None), (2, ""), (None, f"so {passage} it is"), (3, passage.upper()), (3, passage.upper()), (4, "nothing " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("p", passage), ("q", None), ("r", ""), ("s", "..."), (None, passage)], "item_id string, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontaminate.leaks(docs, bench).collect())
    assert got == sorted([(d, i) for d in ("None", "3", "3") for i in ("p", "None")])
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(docs, bench).count() == 3
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == 6
    answered = spark.createDataFrame([(1, passage, "omicron pi")], "item_id int, text string, answer string")
    assert decontaminate.leaks(docs, answered, answer_col="answer").count() == 3
