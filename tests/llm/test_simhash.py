import random
from itertools import product

import numpy as np
import pytest
import xxhash

from tallyjoin.llm import components as components_module
from tallyjoin.llm import simhash


def plain_fingerprint(text):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "É é\x0bA\x85b c\xa0d e", "a b c " * 50, "x" * 100_000, "w " * 70_000 + "end"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def brute(ids, fps, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in zip(range(len(fps)), ids, strict=True):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def near(rnd, n, chain):
    out = [rnd.getrandbits(64) for _ in range(n)]
    for _ in range(chain):
        out.append(rnd.choice(out) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    return out


@pytest.mark.parametrize(("bucket", "distance", "few"), [(512, 2, 0), (8, 2, 10**6), (64, 4, 10**6)])
def test_links_give_all_components(spark, monkeypatch, bucket, distance, few):
    """Also with a ball of neighbours that no bucket could hold; components in rounds and in one task."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(components_module, "FEW_EDGES", few)
    rnd = random.Random(bucket)
    fps = near(rnd, 200, 300)
    fps += [fps[0] ^ (1 << a) for a in range(0, 64, 2)]
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    from tallyjoin.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(nodes, distance)).collect()}
    got = [roots.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    want = brute(list(range(len(fps))), fps, distance)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(7, base), (3, base), (9, base.replace("word17 ", "other ")), (4, "something else entirely here"), (5, None), (6, ""), (8, "  "), (None, base), (4, "something else entirely here"), (4, "a second text of one id")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component string")
    got = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = brute([d for d, _ in rows], fps, 2)
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=key) == sorted([(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, want, strict=True)], key=key)
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted({(min(d for (d, _), g in zip(rows, want, strict=True) if g == c and d is not None), c) and next((d, t) for (d, t), g in sorted(zip(rows, want, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)) if g == c) for c in want} | {(4, "a second text of one id"), (4, "something else entirely here")})


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_thresholds_are_the_cheapest():
    rnd = random.Random(5)
    for _ in range(30):
        costs = [[rnd.random() * 10**e for e in range(3)] for _ in range(3)]
        best = min((sum(c[t] for c, t in zip(costs, ts, strict=True) if t >= 0), list(ts)) for ts in product((-1, 0, 1, 2), repeat=3) if sum(t + 1 for t in ts) == 3)
        cost, ts = simhash.thresholds(costs, 3)
        assert cost == pytest.approx(best[0]) and ts == best[1]


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(0)
    half = rng.integers(0, 2, (500, 32)).astype(bool)
    bits = np.concatenate([half, half], axis=1)  # bit i goes with bit i + 32
    groups = simhash.grouped_bits((bits.T.astype(int) @ bits.astype(int)).astype(float), 500, 2)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all(sum((b + 32) % 64 in g for b in g) >= len(g) - 2 for g in groups)
