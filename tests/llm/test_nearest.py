import numpy as np

from tallyjoin.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, point string, score int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "p", 1) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(vectors, k=20, every=20):
    x = np.array(vectors, np.float32).astype(np.float64)
    out = {}
    for q in range(0, len(x), every):
        s = np.cumsum(x * x[q], axis=1)[:, -1]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q]
        out[q] = [(int(i), float(s[i])) for i in order[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_against_brute_force_on_clusters_of_any_norm(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))) * rng.uniform(0.5, 2, (1500, 1))
    want, got = brute(x), found(nearest.nearest(table(spark, x)))
    assert want.keys() == got.keys()
    shared = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]
    assert np.mean(shared) >= 0.9
    exact = {q: dict(w) for q, w in brute(x, 1499).items()}
    assert all(s == exact[q][i] for q, rows in got.items() for i, s in rows)


def test_many_equal_vectors_give_the_least_ids(spark):
    x = [[1.0, 2.0]] * 400 + [[0.5, 0.1]] * 5
    got = found(nearest.nearest(table(spark, x)))
    for q in range(0, 400, 20):
        assert [i for i, _ in got[q]] == [i for i in range(21) if i != q][:20]


def test_what_takes_no_part_and_few_rows(spark):
    x = [[1, 0], None, [0, 0], [float("nan"), 1], [None, 1], [float("inf"), 1], [], [0, 1], [2], [1, 1]]
    ids = [0, 1, 2, 3, 4, 5, 6, 20, 7, 8]
    got = found(nearest.nearest(table(spark, x, ids)))
    assert got == {0: [(7, 2.0), (8, 1.0), (20, 0.0)], 20: [(8, 1.0), (0, 0.0), (7, 0.0)]}


def test_repeated_and_null_ids(spark):
    got = found(nearest.nearest(table(spark, [[1.0], [1.0], [2.0], [3.0]], [0, 0, None, 5])))
    assert got == {0: [(5, 3.0), (None, 2.0)]}


def test_empty(spark):
    assert nearest.nearest(table(spark, [])).collect() == []


def test_a_leaf_over_a_shard_is_cut_in_pieces():
    firsts, pieces, shards = nearest.layout([np.array([10, nearest.SHARD_ROWS * 2 + 1, 5, nearest.SHARD_ROWS - 5, 7])])
    assert pieces[0].tolist() == [1, 3, 1, 1, 1] and firsts[0].tolist() == [0, 1, 4, 4, 5] and shards == 6


def plain(rows, k=20, every=20):
    """Sorted lists of (vec_id, score) for each distinct vector of each query id, over all rows."""
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in rows if i is not None and i % every == 0}):
        scores = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for j, v in rows if j != i))
        out.append((i, [(None if no else j, -s) for s, no, j in scores[:k]]))
    return sorted(out, key=str)


def test_ids_that_repeat_on_crowded_and_on_several_vectors(spark):
    crowd = [(0, (1.0, 2.0))] * 25 + [(i, (1.0, 2.0)) for i in range(1, 30)] + [(7, (1.0, 2.0))] * 3
    rows = crowd + [(20, (0.5, 1.0)), (20, (2.0, 1.0)), (20, (2.0, 0.5)), (None, (3.0, 3.0)), (33, (0.25, 0.25))]
    got, lists = nearest.nearest(table(spark, [v for _, v in rows], [i for i, _ in rows])).collect(), {}
    for r in got:
        lists.setdefault((r.query_id, r.rank), []).append((r.vec_id, r.score))
    want = plain(rows)
    for (q, rank), items in lists.items():
        assert sorted(items, key=str) == sorted((w[rank - 1] for i, w in want if i == q), key=str)
    assert len(got) == sum(len(w) for _, w in want)


def test_the_budget_grows_much_slower_than_clustered_rows():
    """Rows in the leaves that hold 96 % of the true neighbours: sixteen times the rows take under four times the budget."""
    budgets = []
    for n in (2000, 32_000):
        rng = np.random.default_rng(2)
        centres = rng.normal(size=(n // 50, 32))
        x = (centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, 32))).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        forest = nearest.Forest([], 32, float((x.astype(np.float64) ** 2).sum(1).max()))
        lifted = forest.lifted(x)
        least = nearest.LEAF_ROWS * min(n, 8192) // n
        forest.trees = [nearest.grow(lifted[:8192], least, np.random.default_rng(t)) for t in range(nearest.TREES)]
        leaf = [t.route(lifted) for t in forest.trees]
        sizes = [np.bincount(at, minlength=t.leaves) for at, t in zip(leaf, forest.trees, strict=True)]
        needs = []
        for q in range(0, n, n // 40):
            before = {(t, at): got + sizes[t][at] for t, at, got in forest.visits(x[q], sizes, float("inf"))}
            needs += [min(before[t, leaf[t][i]] for t in range(nearest.TREES)) for i in np.argsort(-(x @ x[q]))[:20]]
        budgets.append(np.quantile(needs, nearest.RECALL))
    assert budgets[1] < 4 * budgets[0] and budgets[1] < 0.1 * n
