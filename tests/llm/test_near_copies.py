"""Near copies against fingerprints and Jaccard similarities of all pairs."""

import random

import numpy as np
import pytest

import xxhash

import corpus_pipeline
from tallyjoin.llm import near_copies
from tests.llm.test_simhash import plain_fingerprint


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def plain_words(text):
    """The fingerprint of a text's set of words."""
    h = [xxhash.xxh64_intdigest(w) for w in set((text or "").encode().lower().split())]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def sketch(text):
    return near_copies.sketch(near_copies.shingles(near_copies.word_hashes(text)))


def linked(sets, words, sketches, i, j):
    few = min(len(sets[i]), len(sets[j])) < near_copies.FEW
    return (
        5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
        and (words[i] ^ words[j]).bit_count() <= near_copies.DISTANCE
        and sum((a ^ b).bit_count() for a, b in zip(sketches[i], sketches[j], strict=True)) <= (near_copies.FEW_BITS if few else near_copies.SKETCH_BITS)
    )


def brute(texts):
    """The least index of each text's component."""
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))
    words, sketches = [plain_words(t) for t in texts], [sketch(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and linked(sets, words, sketches, i, j):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def edited(rnd, words, share):
    out = list(words)
    for i in rnd.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


def planted():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = "this very common line stands in every one of these texts".split()
    texts = ["", " \t", None, "one", "One", "one two", "a b c d", "a b c d e"]
    for _ in range(30):
        words = rnd.choices(vocabulary, k=rnd.randrange(20, 160))
        words[rnd.randrange(len(words)) : 0] = line
        texts += [" ".join(words), *(edited(rnd, words, s) for s in (0.01, 0.02, 0.04, 0.06)), " ".join(words[: len(words) * 9 // 10]).upper()]
    hub = rnd.choices(vocabulary, k=100)
    return texts + [edited(rnd, hub, s) for s in (0.01, 0.03) for _ in range(100)]


@pytest.mark.parametrize(("short", "held", "bucket"), [(64, 1 << 16, 1 << 14), (3, 40, 20)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, short, held, bucket):
    """Also where buckets are cut in blocks."""
    for name, value in (("SHORT", short), ("HELD", held), ("BUCKET", bucket)):
        monkeypatch.setattr(near_copies, name, value)
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component for r in near_copies.near_copies(docs).collect()}
    want = brute(texts)
    assert len(found) == len(texts)
    assert len(set(zip(map(found.get, range(len(texts))), want, strict=True))) == len(set(found.values())) == len(set(want))


def test_the_stage_drops_similar_texts_and_no_others(spark):
    """Near copies at more bits of op1's fingerprint than it links go; texts under the similarity stay, however few bits they differ by."""
    rnd = random.Random(4)
    bits = lambda a, b: (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count()
    jaccard = lambda a, b: len(plain_shingles(a) & plain_shingles(b)) / len(plain_shingles(a) | plain_shingles(b))
    far = near = None
    while not (far and near):
        words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        a, b = " ".join(words), edited(rnd, words, rnd.choice((0.02, 0.03, 0.04, 0.05)))
        if jaccard(a, b) >= 0.8 and bits(a, b) > 5:
            far = far or (a, b)
        elif jaccard(a, b) < 0.78 and bits(a, b) <= 4:
            near = near or (a, b)
    rows = [(1, far[0]), (2, far[1]), (3, near[0]), (4, near[1]), (5, far[1]), (None, far[0])]
    docs = spark.createDataFrame([(*r, "xa", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, far[0]), (3, near[0]), (4, near[1])]


def test_shingles():
    shingles = lambda t: near_copies.shingles(near_copies.word_hashes(t))
    assert len(shingles("a b c d e f")) == 2 == len(shingles("A b  c d e f a b c d e f")) - 4
    assert np.array_equal(shingles("Ab c"), shingles(" aB\nc "))
    assert not np.array_equal(shingles("a b"), shingles("b a"))


def test_rows_that_differ_elsewhere_and_clashing_names(spark):
    """Of equal texts of one id the choice doesn't hang on the order of rows; helpers' names may be columns."""
    rows = [(1, "some words that are here", source, i, i, i) for i, source in enumerate("abab")] + [(None, None, "c", 9, 9, 9)] * 2
    schema = "doc_id long, text string, source string, _id long, _hash long, `a``.b` long"
    kept = [sorted(near_copies.distinct_documents(spark.createDataFrame(rs, schema)).collect(), key=str) for rs in (rows, rows[::-1])]
    assert kept[0] == kept[1] and {r.doc_id for r in kept[0]} == {None, 1} and len(kept[0]) == 2


def test_most_similar_pairs_are_candidates():
    """Of pairs of texts just over the similarity, nine in ten lie within DISTANCE and SKETCH_BITS."""
    rnd = random.Random(3)
    caught = every = 0
    while every < 300:
        words = [f"w{int(rnd.paretovariate(0.7)) % 4000}" for _ in range(rnd.randrange(60, 400))]
        texts = [" ".join(words), edited(rnd, words, rnd.choice((0.01, 0.015, 0.02)))]
        sets = [plain_shingles(t) for t in texts]
        if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.9:
            every += 1
            caught += linked(sets, [plain_words(t) for t in texts], [sketch(t) for t in texts], 0, 1)
    assert caught >= 0.9 * every
