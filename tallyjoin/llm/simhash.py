"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are made from all shingles of whole texts. Links between distinct fingerprints at up to ``distance``
differing bits are found through m bit partitions with thresholds t_i whose sums t_i + 1 make distance + 1: two linked
fingerprints differ by at most t_i bits in some partition i.

* Bits that go together (co-occurrence counts over all fingerprints) share a partition.
* For several m around distance + 1, candidates at t = 0 are counted over all fingerprints, those at larger t are estimated from them
  and from the bits' chances to differ, and dynamic programming takes the cheapest thresholds; -1 skips a partition.
* Probing: a fingerprint enters the bucket of each key mask (a partition without t of its bits). A bucket with more
  than BUCKET fingerprints is split again by three parts of its free bits, and so on; as fingerprints are distinct, no
  bucket keeps more than 2 to the number of its last free bits.
* Within a bucket candidates are verified and reduced to a forest, so at most one link a fingerprint leaves it.

Defined results: null text is empty and has fingerprint zero, which is linked like any other; rows with equal doc_id are
rows of their own; null doc_ids get a component but never name one; extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyjoin.llm import common
from tallyjoin.llm.components import components, labelled
from tallyjoin.names import col, free, own

# Fixed values of the fingerprint: words in a shingle, the hash's seed, its bits.
SHINGLE = 3
SEED = 42
BITS = 64
#: What a key row costs against a candidate.
ROW_COST = 20.0
#: Most fingerprints that are compared all with all.
BUCKET = 512
#: Shingles that are held at once.
HELD = 1 << 16

ALL = (1 << BITS) - 1


def fingerprint(text: str | None) -> int:
    """64 bits, each 1 if set in over half the shingles' hashes."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, and only ASCII white space parts
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n, digest = max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest
    return majority((np.fromiter((digest(s, SEED) for s, _ in zip(shingles, range(HELD), strict=False)), np.uint64, min(HELD, n - i)) for i in range(0, n, HELD)), n)[0]


def majority(parts: Iterable[np.ndarray], n: int, words: int = 1) -> list[int]:
    """Numbers whose bits are 1 where they are in over half of n hashes, given in parts; a hash has so many words of 64 bits."""
    ones = np.zeros(BITS * words, np.int64)
    for part in parts:
        for i in range(0, len(part), HELD):
            bits = np.unpackbits(np.ascontiguousarray(part[i : i + HELD]).view(np.uint8), bitorder="little")
            ones += bits.reshape(-1, BITS * words).sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8").tolist()


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the hashes of the text and of the whole row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), common.row_hash(docs).alias("row_hash"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp, a signed 64-bit number, text_hash and row_hash per row."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64()), ("row_hash", pa.int64())])

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        return common.batch_of(out, [batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("text_hash"), batch.column("row_hash")])

    return common.map_batches(identified(docs), batch_of, "doc_id long, fp long, text_hash long, row_hash long")


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """How often bits i and j are 1 together, over all fingerprints: 64 rows from each task, summed by Spark."""
    names = [f"b{j}" for j in range(BITS)]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS, dtype=np.int32)), *map(pa.array, total.T)], ["i", *names])

    rows = nodes.select("fp").mapInArrow(count, "i int, " + ", ".join(f"{n} long" for n in names)).groupBy("i").agg(*(F.sum(n).alias(n) for n in names)).collect()
    out = np.zeros((BITS, BITS))
    for r in rows:
        out[r.i] = r[1:]
    return out


def grouped_bits(counts: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of the bits, each grown from the bit most correlated with the rest by those nearest to it."""
    p = counts.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(near, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [max(left, key=lambda b: (near[b, left].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in left if b not in group), key=lambda b: (near[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        groups.append(sorted(group))
    return groups


def mask_of(bits: Iterable[int]) -> int:
    return sum(1 << b for b in bits)


def few_differ(differ: np.ndarray, most: int) -> np.ndarray:
    """Chances that at most 0, 1, ... most of the bits differ, each by its own chance."""
    p = np.zeros(most + 1)
    p[0] = 1.0
    for d in differ:
        p[1:] = p[1:] * (1 - d) + p[:-1] * d
        p[0] *= 1 - d
    return np.cumsum(p)


def thresholds(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Dynamic programming: t_i >= -1 with the sum of t_i + 1 equal to budget and the least cost; costs[i][t]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for e in range(budget - used + 1):
                c = cost + (row[e - 1] if e else 0.0)
                if used + e not in new or c < new[used + e][0]:
                    new[used + e] = (c, [*ts, e - 1])
        best = new
    return best[budget]


def key_masks(nodes: DataFrame, distance: int, row_cost: float = ROW_COST) -> list[int]:
    """The masks under which linked fingerprints are equal, by the cheapest partitions and thresholds.

    Partitions are tried in numbers that suit thresholds of 0, 1, 2 and 3, and one more.
    """
    n = nodes.count()
    counts = bit_counts(nodes)
    p = counts.diagonal() / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 1)
    groups = {m: grouped_bits(counts, n, m) for m in sorted({max(2, -(-(distance + 1) // k)) for k in range(1, 5)} | {distance + 2})}
    masks = sorted({mask_of(g) for gs in groups.values() for g in gs})
    keyed = nodes.select(F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(x))).alias("key")) for i, x in enumerate(masks)))).alias("x"))
    pairs = keyed.groupBy("x.k", "x.key").count().filter("count > 1").groupBy("k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("c")).collect()
    at_zero = {masks[r.k]: r.c for r in pairs}
    best: tuple[float, list[int]] = (float("inf"), [])
    for gs in groups.values():
        costs = []
        for g in gs:
            chance = few_differ(differ[g], distance)
            zero = max(at_zero.get(mask_of(g), 0.0), 1.0)
            costs.append([min(zero * chance[t] / max(chance[0], 1e-300), n * n / 2) + row_cost * n * comb(len(g), t) if t < len(g) else float("inf") for t in range(distance + 1)])
        cost, ts = thresholds(costs, distance + 1)
        if cost < best[0]:
            best = (cost, [mask_of(set(g) - set(free)) for g, t in zip(gs, ts, strict=True) if t >= 0 for free in combinations(g, t)])
    return best[1]


def finer(mask: int, distance: int) -> list[int]:
    """mask with each of distance + 1 parts of its free bits: what differs in at most distance of those agrees in one."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | mask_of(free[i :: distance + 1]) for i in range(distance + 1)]


def forest(group: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) that join what is linked within each run of equal group numbers; at most one for each u."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    left = np.repeat(starts + sizes, sizes) - np.arange(len(group))  # rows of the run from here on
    us, vs = [], []
    for d in range(1, int(sizes.max(initial=1))):
        i = np.flatnonzero(left > d)
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= distance]
        us.append(i)
        vs.append(i + d)
    if not us:
        return fps[:0], fps[:0]
    u, v = np.concatenate(us), np.concatenate(vs)
    label = np.arange(len(fps))
    found = labelled(u, v)
    label[: len(found)] = found
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) between distinct fingerprints of nodes (fp) that give the same components as all links."""
    masks = key_masks(nodes, distance)
    rows = nodes.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    done = None
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        splittable = [m for m in masks if BITS - m.bit_count() > BUCKET.bit_length() - 1]
        hot = rows.groupBy("mask", "key").count().filter((F.col("count") > BUCKET) & F.col("mask").isin([signed(m) for m in splittable])) if splittable else None
        hot = common.materialize(hot.select("mask", "key"), "hot") if hot is not None else None
        if hot is None or hot.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            break
        cold = rows.join(hot, ["mask", "key"], "left_anti").select("fp", "mask", "key")
        done = cold if done is None else done.unionByName(cold)
        crowded = [r.mask & ALL for r in hot.select("mask").distinct().collect()]  # at most distance + 1 to the number of rounds
        masks = sorted({f for m in crowded for f in finer(m, distance)})
        parts = F.broadcast(nodes.sparkSession.createDataFrame([(signed(m), signed(f)) for m in crowded for f in finer(m, distance)], "mask long, part long"))
        rows = rows.join(hot, ["mask", "key"]).select("fp", "mask").join(parts, "mask").select("fp", F.col("part").alias("mask")).distinct()
        rows = common.materialize(rows, "finer")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            group = np.cumsum(np.r_[False, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            u, v = forest(group, cols[2].view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 16 * BUCKET:
                cols = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3)]
                change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
                cut = change[-1] + 1 if len(change) else 0  # the last run may go on in the next batch
                if cut:
                    yield out([c[:cut] for c in cols])
                held = [pa.RecordBatch.from_arrays([pa.array(c[cut:]) for c in cols], ["mask", "key", "fp"])]
        if held:
            yield out([np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3)])

    dealt = done.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, distance: int = 2) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, the least doc_id that links lead to, text_hash, row_hash."""
    rows = common.materialize(fingerprints(docs), "fingerprints")
    nodes = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(common.materialize(roots, "roots"), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = common.materialize(rooted, "rooted")
    named = common.materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    of_fp = common.materialize(rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id"), "of_fp")
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "row_hash", F.col("root").alias("component"))


def distinct_documents(docs: DataFrame, distance: int = 2) -> DataFrame:
    """docs with one document of each component."""
    return one_of_each(docs, common.materialize(near_duplicates(docs, distance), "components"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one document of each component: the least doc_id, nulls last, then the least hashes of text and whole row.

    So the choice never hangs on the order of rows. Of rows that are equal in all columns one stays: only those are shuffled
    to be told apart. found: doc_id, text_hash, row_hash and component of each row.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row_hash")
    keep = found.groupBy("component").agg(F.min(order).alias("x"))
    keep = common.materialize(keep.select(F.col("x.doc_id").alias("doc_id"), F.col("x.row_hash").alias("row_hash")).distinct(), "keep")
    again = found.groupBy("doc_id", "row_hash").count().filter("count > 1")
    again = keep.join(again.select(F.col("doc_id").alias("id"), F.col("row_hash").alias("hash")), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")), "left_semi")
    again = common.materialize(again, "again")
    id_, hash_ = free("_id", docs), free("_hash", docs)
    row = docs.withColumn(hash_, common.row_hash(docs))
    same = lambda side: (side, col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(free("_hash2", docs))))
    keys = lambda side: side.select(F.col("doc_id").alias(id_), F.col("row_hash").alias(free("_hash2", docs)))
    chosen = row.join(*same(keys(keep)), "left_semi")
    alone = chosen.join(*same(keys(again)), "left_anti")
    one = chosen.join(*same(keys(again)), "left_semi").dropDuplicates(["doc_id", hash_])
    return alone.unionByName(one).select(*own(docs))
