import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from tallyjoin.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids:
                    found |= ids
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, 1, "w") for x in docs], "doc_id long, text string, item int, words string")
    b = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, doc_id int")
    return [tuple(r) for r in dc.digest(dc.contamination(d, b)).collect()]


def key(r):
    return (r[0] is None, *map(str, r))


@pytest.mark.parametrize("vocabulary", [2, 3, 30])
def test_random_texts_against_brute_force(spark, vocabulary):
    rnd = random.Random(vocabulary)
    text = lambda n: " ".join(rnd.choice("aBcdéÉfghijklmnopqrstuvwxyz0123")[:1] + str(rnd.randrange(vocabulary)) if vocabulary == 30 else "ab"[rnd.randrange(2)] * rnd.randint(1, vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice((1, 3, 5, 7, 8, 9, 20)) if vocabulary == 30 else rnd.choice((6, 7, 8, 12)))) for i in range(12)] + [(3, "x"), (None, text(10)), (40, None), (41, "-- !"), (10, "one two")]
    docs = [(i, text(rnd.randrange(60))) for i in range(30)]
    for i in range(30, 60):
        a, b = rnd.choice(items)[1] or "", rnd.choice(items)[1] or ""
        cut = words(a)[rnd.randrange(3) :]
        docs.append((i, f"{text(4)} {' - '.join(cut).upper()}. {text(3)}, {b}"))
    docs += [(70, None), (71, ""), (5, docs[5][1]), (5, "another, ONE two!"), (None, "one, two"), (None, None)]
    assert sorted(run(spark, docs, items), key=key) == sorted(brute(docs, items), key=key)


def test_long_repeats_and_one_passage_in_many_documents(spark):
    item = " ".join(f"w{i}" for i in range(9))
    docs = [(i, f"x{i} {item} y{i}") for i in range(300)] + [(900, "a " * 5000), (901, "a " * 7)]
    items = [(1, item), (2, "a " * 20), (3, item)]
    assert sorted(run(spark, docs, items), key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_more_fingerprints_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    item = " ".join(f"w{i}" for i in range(30))
    docs, items = [(i, f"x {item} {i}") for i in range(20)], [(1, item), (2, "x w0 w1")]
    assert sorted(run(spark, docs, items), key=key) == sorted(brute(docs, items), key=key)


def test_clean_keeps_columns_and_rows(spark):
    item = "one two three four five six seven eight"
    d = spark.createDataFrame([(1, item, "a"), (2, "clean", "b"), (2, "clean", "b"), (None, None, None)], "doc_id long, text string, _id string").withColumn("_idt", F.lit(5)).withColumn("a`.b", F.lit(6))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = dc.clean(d, b, 1)
    assert kept.columns == d.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(2, "clean", "b", 5, 6), (2, "clean", "b", 5, 6), (None, None, None, 5, 6)], key=str)
