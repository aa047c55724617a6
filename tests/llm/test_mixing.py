import re
from collections import defaultdict
from heapq import heappop, heappush

import pytest

from tallyjoin.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target int, parts int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2) for i, t, s in rows], SCHEMA)


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


CORPUS = [(i, words(5 + i * 13 % 90), "src%d" % (0 if i % 3 == 0 else i % 7)) for i in range(300)]
CORPUS += [(900, None, "src1"), (901, "", None), (902, words(40), None), (5, CORPUS[5][1], CORPUS[5][2]), (None, words(30), "src2"), (903, " one\x0btwo ", "alone")]


def test_targets_sizes_and_shares(spark):
    out = mixing.mix(docs(spark, CORPUS)).collect()
    assert len(out) == len(CORPUS)
    sizes = defaultdict(int)
    for _, t, s in CORPUS:
        sizes[s] += size(t)
    targets, taken = water(sizes), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((i or -1, size(t)) for i, t, _ in CORPUS)
    for s, n in taken.items():
        assert abs(n - targets[s]) <= mixing.BLOCK


def test_reruns_agree_whatever_the_partitions(spark):
    a = mixing.mix(docs(spark, CORPUS)).select("doc_id", "size", "taken").collect()
    b = mixing.mix(docs(spark, CORPUS[::-1]).repartition(7)).select("doc_id", "size", "taken").collect()
    key = lambda r: (r.doc_id is None, r)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_seats_go_by_highest_quotients(spark):
    votes = {f"s{i:02d}": v for i, v in enumerate([90_000.0, 17.0, 3.0, 410.0, 55_555.5, 100.0, 100.0, 100.0, 8.0, 0.0, 24.1, 2_000.0])}
    frame = spark.createDataFrame([(i + 1, s, 1, v) for i, (s, v) in enumerate(votes.items())], "_rank int, source string, source_size long, target double")
    got = {r.source: r.seats for r in mixing.source_seats(frame).collect()}
    seats, heap = dict.fromkeys(votes, 0), []
    for i, (s, v) in enumerate(votes.items()):
        heappush(heap, (-v, i, s))
    for _ in range(int(sum(votes.values()) / mixing.BLOCK + 0.5)):
        _, i, s = heappop(heap)
        seats[s] += 1
        heappush(heap, (-votes[s] / (2 * seats[s] + 1), i, s))
    assert got == seats


def test_sample_gives_the_words_taken(spark):
    frame = docs(spark, CORPUS)
    taken = defaultdict(int)
    for r in mixing.mix(frame).collect():
        taken[r.doc_id] += r.taken
    rows = mixing.sample(frame).collect()
    assert mixing.sample(frame).columns == frame.columns
    got, texts = defaultdict(int), defaultdict(set)
    for i, t, _ in CORPUS:
        texts[i].add(" ".join((t or "").split()))
    for r in rows:
        got[r.doc_id] += size(r.text)
        assert r.n_chars == len(r.text) and any(" ".join(r.text.split()) in t for t in texts[r.doc_id])
    assert {k: v for k, v in taken.items() if v} == got


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, "", "b")], [(1, "one", "a")]])
def test_little_or_nothing(spark, rows):
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)


def test_clashing_names_repeated_rows_and_long_texts(spark):
    """A row equal to another in all columns gives its parts as well; a very long text is cut like any other."""
    long = "w " * 300_000
    names = ("_id", "_src", "_parts", "_no", "_size", "_part", "_dsize", "_dno", "_row", "_row2", "a`.b")
    rows = [(1, "one two three", "a"), (1, "one two three", "a"), (None, "x " * 40, "a"), (None, "x " * 40, "b"), (2, long, "b"), (3, None, "c")]
    frame = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n.replace('`', '``')}` long" for n in names))
    got = mixing.sample(frame)
    assert got.columns == frame.columns
    out, taken = got.collect(), mixing.mix(frame).collect()
    assert all(tuple(r)[3:] == tuple(range(len(names))) for r in out)
    assert sum(size(r.text) for r in out) == sum(r.taken for r in taken) and sum(size(r.text) for r in out if r.doc_id == 2) == sum(r.taken for r in taken if r.doc_id == 2) > 0
