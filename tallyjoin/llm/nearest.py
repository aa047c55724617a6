"""Approximate nearest neighbours by a forest of random-projection trees.

* Index: TREES trees of hyperplanes between two random points each, split at the median, fitted on one in SAMPLE_OF vectors,
  SAMPLE[0] at least and SAMPLE[1] at most (the first in hash order); every vector is routed through every tree. Vectors get
  one more component that makes their norms equal, so that the largest inner product is the smallest angle.
* Search: one priority queue over the nodes of all trees; the leaf whose worst margin on the way is best comes next,
  until the leaves taken hold the budget of rows. The budget is measured: PROBES queries are answered exactly, in blocks,
  over all rows, and it is the number of rows at which RECALL of their true neighbours lie in leaves taken.
* Rerank: the inner products with the leaves' rows in double precision, summed in order of the components.

Equal vectors are one point with the least of its ids, as many as a result can show, and how often each occurs. A tree's
leaves lie in shards of at most SHARD_ROWS rows; a leaf with more is cut by hash into pieces and searched in all of them.

The budget grows much slower than the rows where vectors have near neighbours (see the README for figures); where they have
none, as random directions in many dimensions do, it is a share of all rows, and no index of any kind does better.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; shorter vectors
count as padded with zeros; rows with equal vec_id are candidates of their own, except for a query's own id; a query id with
several different vectors has a list for each of them, all under that id; null vec_ids are candidates after all others, never
queries; fewer candidates than k give all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyjoin.llm import common

TREES = 4
SAMPLE, SAMPLE_OF = (8192, 65_536), 16
LEAF_ROWS = 128
#: Least sampled vectors in a leaf, so that its median means something.
LEAF_SAMPLE = 4
SHARD_ROWS = 32_768
PROBES = 64
RECALL = 0.96
SEED = 11


@dataclass
class Tree:
    """Inner nodes 0.. with plane, offset and two children; a child below 0 is leaf -child - 1."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.planes) else np.full(len(x), -1, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.planes[n]) > self.offsets[n]
            at[inner] = self.children[n, right.astype(np.int64)]
        return -at - 1


def grow(x: np.ndarray, least: int, rng: np.random.Generator) -> Tree:
    planes, offsets, children, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = None
        for _ in range(5 if len(rows) > least else 0):
            a, b = x[rng.choice(rows, 2, replace=False)]
            norm = np.linalg.norm(a - b)
            if norm > 1e-12:
                plane = ((a - b) / norm).astype(np.float32)
                p = x[rows] @ plane
                cut = np.float32(np.median(p))
                right = p > cut
                if 0 < right.sum() < len(rows):
                    split = (plane, cut, right)
                    break
        if split:
            me = len(planes)
            planes.append(split[0])
            offsets.append(split[1])
            children.append([0, 0])
            todo += [(rows[split[2]], me, 1), (rows[~split[2]], me, 0)]
        else:
            me, leaves = -leaves - 1, leaves + 1
        if parent >= 0:
            children[parent][side] = me
    return Tree(np.array(planes, np.float32).reshape(len(planes), x.shape[1]), np.array(offsets, np.float32), np.array(children, np.int64).reshape(-1, 2), leaves)


@dataclass
class Forest:
    trees: list[Tree]
    dim: int
    norm2: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm2 - (vectors.astype(np.float64) ** 2).sum(1), 0))
        return np.concatenate([vectors, rest[:, None].astype(np.float32)], axis=1)

    def visits(self, q: np.ndarray, sizes: list[np.ndarray], budget: float) -> Iterator[tuple[int, int, int]]:
        """(tree, leaf, rows in the leaves taken before) in the order of the shared queue, until budget rows."""
        q = np.append(q, np.float32(0))
        margins = [t.planes @ q - t.offsets for t in self.trees]
        queue = [(-np.inf, k, 0 if len(t.planes) else -1) for k, t in enumerate(self.trees)]
        got = 0
        while queue and got < budget:
            worst, k, n = heapq.heappop(queue)
            if n < 0:
                yield k, -n - 1, got
                got += int(sizes[k][-n - 1])
            else:
                m, (left, right) = float(margins[k][n]), self.trees[k].children[n].tolist()
                heapq.heappush(queue, (max(worst, m), k, left))
                heapq.heappush(queue, (max(worst, -m), k, right))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as float32 rows, padded with zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32), column.offsets.to_numpy()
    lengths = np.diff(offsets)
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.float32)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order of the components."""
    return np.cumsum(a.astype(np.float64) * b.astype(np.float64), axis=1)[:, -1]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the numbers of the k largest, in no order."""
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<float>) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter("embedding IS NOT NULL")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)))


def exact(points: DataFrame, queries: np.ndarray, dim: int, k: int) -> list[set[int]]:
    """The true k nearest points of a bounded number of queries: blocks of rows against all of them."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column("embedding"), dim)
        s = queries @ x.T
        at = best(s, k)
        rows = np.repeat(np.arange(len(queries)), at.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(batch.column("point").to_numpy()[at.ravel()]), pa.array(s[rows, at.ravel()].astype(np.float64))], ["q", "point", "score"])

    found = common.map_batches(points.select("point", "embedding"), block, "q long, point long, score double")
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "point"))).filter(F.col("r") <= k)
    out: list[set[int]] = [set() for _ in queries]
    for r in ranked.select("q", "point").collect():  # k a probe
        out[r.q].add(r.point)
    return out


def plan(points: DataFrame, queries: DataFrame, k: int) -> tuple[Forest, list[np.ndarray], float] | None:
    """The forest, the rows in its leaves, and the budget of rows that reaches RECALL on the probes."""
    about = points.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm2")).first()
    if not about.n:
        return None
    some = points.select("point", "embedding").orderBy(F.xxhash64("point"), "point").limit(min(max(about.n // SAMPLE_OF, SAMPLE[0]), SAMPLE[1])).collect()  # bounded sample
    padded = np.zeros((len(some), about.dim), np.float32)
    for i, r in enumerate(some):
        padded[i, : len(r.embedding)] = r.embedding
    forest = Forest([], about.dim, about.norm2)
    x = forest.lifted(padded)
    least = max(LEAF_SAMPLE, LEAF_ROWS * len(some) // about.n)
    forest.trees = [grow(x, least, np.random.default_rng([SEED, t])) for t in range(TREES)]
    routed = route(points, forest).groupBy("tree", "leaf").count().collect()  # TREES * SAMPLE[1] / LEAF_SAMPLE rows at most
    sizes = [np.zeros(t.leaves, np.int64) for t in forest.trees]
    for r in routed:
        sizes[r["tree"]][r["leaf"]] = r["count"]
    probes = queries.select("point", "embedding").orderBy(F.xxhash64("point", F.lit(SEED)), "point").limit(PROBES).collect()
    q = np.zeros((len(probes), about.dim), np.float32)
    for i, r in enumerate(probes):
        q[i, : len(r.embedding)] = r.embedding
    true = exact(points, q, about.dim, k)
    wanted = points.join(F.broadcast(points.sparkSession.createDataFrame([(p,) for p in sorted(set().union(*true))], "_p long")), F.col("point") == F.col("_p"), "left_semi")
    leaf_of = {(r.tree, r.point): r.leaf for r in route(wanted, forest).collect()}  # PROBES * (k + 1) * TREES rows at most
    needs = []
    for i, near in enumerate(true):
        before = {(t, leaf): got + int(sizes[t][leaf]) for t, leaf, got in forest.visits(q[i], sizes, float("inf"))}
        needs += [min(before[t, leaf_of[t, p]] for t in range(TREES)) for p in near]
    return forest, sizes, float(np.quantile(needs, RECALL, method="higher")) if needs else 0.0


def route(points: DataFrame, forest: Forest) -> DataFrame:
    """tree, leaf, point and embedding for every point and tree."""
    share = points.sparkSession.sparkContext.broadcast(forest)  # TREES * SAMPLE[1] / LEAF_SAMPLE planes at most

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = share.value
        x = f.lifted(matrix(batch.column("embedding"), f.dim))
        leaves = np.concatenate([t.route(x) for t in f.trees])
        n, m = batch.num_rows, len(f.trees)
        again = pa.array(np.tile(np.arange(n), m))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(m, dtype=np.int32), n)), pa.array(leaves.astype(np.int32)), batch.column("point").take(again), batch.column("embedding").take(again)], ["tree", "leaf", "point", "embedding"])

    return common.map_batches(points.select("point", "embedding"), rows, "tree int, leaf int, point long, embedding array<float>")


def layout(sizes: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Per tree the first shard of each leaf and its number of pieces; the number of shards."""
    firsts, pieces, shard = [], [], -1
    for s in sizes:
        first, piece, room = np.zeros(len(s), np.int64), np.ones(len(s), np.int64), -1
        for leaf, n in enumerate(s.tolist()):
            if n > SHARD_ROWS:
                piece[leaf] = -(-n // SHARD_ROWS)
                first[leaf], shard, room = shard + 1, shard + int(piece[leaf]), -1
            else:
                if n > room:
                    shard, room = shard + 1, SHARD_ROWS
                first[leaf], room = shard, room - n
        firsts.append(first)
        pieces.append(piece)
    return firsts, pieces, shard + 1


def search(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, point, score: at least the k nearest points found for each query point."""
    planned = plan(points, queries, k)
    if planned is None:
        return points.sparkSession.createDataFrame([], "query long, point long, score double")
    forest, sizes, budget = planned
    firsts, pieces, shards = layout(sizes)
    spark, dim, keep = points.sparkSession, forest.dim, k
    share = spark.sparkContext.broadcast((forest, sizes, firsts, pieces))
    schema = "shard int, kind int, leaf int, point long, embedding array<float>, leaves array<int>"

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, first, piece = share.value
        tree, leaf, point = (batch.column(c).to_numpy() for c in ("tree", "leaf", "point"))
        a, n = np.zeros(len(tree), np.int64), np.ones(len(tree), np.int64)
        for t in range(len(first)):
            mine = tree == t
            a[mine], n[mine] = first[t][leaf[mine]], piece[t][leaf[mine]]
        salt = (point.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
        return pa.RecordBatch.from_arrays([pa.array((a + salt).astype(np.int32)), pa.array(np.zeros(len(tree), np.int32)), batch.column("leaf"), batch.column("point"), batch.column("embedding"), pa.nulls(len(tree), pa.list_(pa.int32()))], ["shard", "kind", "leaf", "point", "embedding", "leaves"])

    def asked(batch: pa.RecordBatch) -> pa.RecordBatch:
        f, size, first, piece = share.value
        q = matrix(batch.column("embedding"), f.dim)
        at, shard, leaves = [], [], []
        for i in range(len(q)):
            wanted: dict[int, list[int]] = {}
            for t, leaf, _ in f.visits(q[i], size, budget):
                for s in range(int(first[t][leaf]), int(first[t][leaf] + piece[t][leaf])):
                    wanted.setdefault(s, []).append(leaf)
            for s, ls in wanted.items():
                at.append(i)
                shard.append(s)
                leaves.append(ls)
        take = pa.array(at, pa.int64())
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int32)), batch.column("point").take(take), batch.column("embedding").take(take), pa.array(leaves, pa.list_(pa.int32()))], ["shard", "kind", "leaf", "point", "embedding", "leaves"])

    index = common.map_batches(route(points, forest), placed, schema)
    wanted = common.map_batches(queries.select("point", "embedding"), asked, schema)
    dealt = index.unionByName(wanted).repartitionById(max(shards, 1), F.col("shard")).sortWithinPartitions("shard", "kind", "leaf")  # a task for each shard
    out = pa.schema([("query", pa.int64()), ("point", pa.int64()), ("score", pa.float64())])

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's rows come first, by leaf, then the queries that go to it; a batch of queries at a time."""
        now, rows, x, ids, leaf, starts = None, [], None, None, None, None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])]) if len(shard) else []
            for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                part = batch.slice(a, b - a)
                if shard[a] != now:
                    now, rows, x = shard[a], [], None
                if not kind[a]:
                    rows.append(part)
                    continue
                if not rows:
                    continue
                if x is None:
                    x = np.concatenate([matrix(r.column("embedding"), dim) for r in rows])
                    ids = np.concatenate([r.column("point").to_numpy() for r in rows])
                    of_row = np.concatenate([r.column("leaf").to_numpy() for r in rows])
                    starts = np.flatnonzero(np.r_[True, of_row[1:] != of_row[:-1]])
                    leaf = of_row[starts]
                    lengths = np.diff(np.r_[starts, len(x)])
                q, qid = matrix(part.column("embedding"), dim), part.column("point").to_numpy()
                for i in range(0, len(q), 64):
                    some = part.column("leaves").slice(i, 64)
                    owner = np.repeat(np.arange(len(some)), np.diff(some.offsets.to_numpy()))
                    place = np.searchsorted(leaf, some.flatten().to_numpy())
                    real = place < len(leaf)
                    real[real] = leaf[place[real]] == some.flatten().to_numpy()[real]
                    visited = np.zeros((len(some), len(leaf)), bool)
                    visited[owner[real], place[real]] = True
                    used = np.flatnonzero(np.repeat(visited.any(0), lengths))
                    mine = np.repeat(visited, lengths, axis=1)[:, used]
                    scores = np.where(mine, q[i : i + 64] @ x[used].T, -np.inf)
                    near = best(scores, keep)
                    row = np.repeat(np.arange(len(some)), near.shape[1])
                    col = near.ravel()
                    ok = mine[row, col]
                    row, col = row[ok], used[col[ok]]
                    yield common.batch_of(out, [qid[i + row], ids[col], in_order(q[i + row], x[col])])

    return dealt.mapInArrow(rerank, "query long, point long, score double")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each vec_id divisible by every, its k nearest rows found."""
    base = common.materialize(valid(vectors).withColumn("point", F.xxhash64("embedding")), "vectors")
    asks = common.materialize(base.filter(F.col("vec_id") % every == 0).select("vec_id", "point").distinct(), "asks")
    # A query's own id may be on so many points, and stand among the ids of any: so many more of both are kept.
    own = asks.groupBy("vec_id").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    by_id = W.partitionBy("point").orderBy(F.col("vec_id").asc_nulls_last())
    members = base.groupBy("point", "vec_id").agg(F.count("*").alias("copies")).withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= k + 1)
    members = common.materialize(members, "members")
    points = common.materialize(base.groupBy("point").agg(F.min("vec_id").alias("_least"), F.first("embedding").alias("embedding")), "points")
    queries = common.materialize(points.join(asks.select("point").distinct(), "point", "left_semi").select("point", "embedding"), "queries")
    found = search(points.select("point", "embedding"), queries, k + own).distinct()
    top = found.join(points.select("point", "_least"), "point").withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("_least").asc_nulls_last()))).filter(F.col("_r") <= k + own)
    top = common.materialize(top.select("query", "point", "score"), "top")
    rows = asks.select(F.col("vec_id").alias("query_id"), F.col("point").alias("query")).join(top, "query").join(members.select("point", "vec_id", "copies"), "point")
    rows = rows.filter(~F.col("vec_id").eqNullSafe(F.col("query_id"))).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
