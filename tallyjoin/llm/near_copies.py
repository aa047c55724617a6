"""SimHash near-dedup with verified links: five-word shingles of a Jaccard similarity of 4/5 or more.

Candidates come from the generalised pigeonhole of simhash.py, by its partitions and thresholds, at DISTANCE bits. The
fingerprint here is of a text's set of words, as few edits touch few words but five times as many shingles: similar texts
then differ by 0 to 10 bits instead of 4 to 14. Candidates are verified by

* their numbers of shingles, which a similarity of 4/5 bounds;
* a second SimHash, of SKETCH bits of the shingles themselves: texts at the similarity differ by 78 of 512 bits, give or
  take 8, and pairs of more than SKETCH_BITS go (FEW_BITS where a text has fewer than FEW shingles, so that ties weigh more);
* their whole shingle sets.

A pair is linked where all three hold. Texts of equal shingle sets are one node from the start, and pairs of nodes that are in
one component already aren't verified again: a first round takes each node with the nearest one in its buckets, which makes
most of a group one component; the second takes all nodes of different components, each pair in the first bucket that holds
both. A bucket of more than BUCKET nodes is cut in blocks: those outside its largest component meet
each other's blocks and each block of that component, whose blocks needn't meet each other.

Words are SimHash's. A text of fewer words than SHINGLE has one shingle, all its words; one without words an empty one.
Defined results are those of SimHash's: null text is empty, rows with equal doc_id are rows of their own, null doc_ids come
last, empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyjoin.llm import common, simhash
from tallyjoin.llm.components import components

SHINGLE = 5
#: Bits that fingerprints of similar texts may differ by.
DISTANCE = 10
#: Bits of the second SimHash, and how many of them may differ.
SKETCH, SKETCH_BITS = 512, 94
FEW, FEW_BITS = 32, 150
#: What a key row costs against a candidate, as it carries the second SimHash.
ROW_COST = 3000.0
#: Nodes that one task compares all with all, and most texts to be compared whose ids are broadcast.
BUCKET = 1 << 14
BROADCAST_ROWS = 200_000
#: Rows that are taken up at once, and the longest run that is compared by distance in it.
HELD, SHORT = 1 << 16, 64
#: Rows that are compared at once with a whole run.
BLOCK = 256

SKETCHES = [f"s{i}" for i in range(SKETCH // 64)]
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & simhash.ALL for i in range(1, SKETCH // 64 + 1)], np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    import xxhash

    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(h: np.ndarray) -> np.ndarray:
    """The distinct hashes of the shingles of words, ascending."""
    if not len(h):
        return np.zeros(1, np.uint64)
    size = min(SHINGLE, len(h))
    n, out = len(h) - size + 1, np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(found: np.ndarray) -> list[int]:
    x = (found ^ (found >> np.uint64(31)))[:, None] * _MIX
    return simhash.majority([x ^ (x >> np.uint64(32))], len(found), len(_MIX))


def described(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, row_hash, node (the hash of all shingles), n (their number), fp and the second SimHash."""
    import xxhash

    names = ["doc_id", "text_hash", "row_hash", "node", "n", "fp", *SKETCHES]

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, n, fps = [], [], []
        for text in batch.column("text").to_pylist():
            h = word_hashes(text)
            s = shingles(h)
            node.append(xxhash.xxh64_intdigest(s.tobytes()))
            n.append(len(s))
            words = np.unique(h)
            fps.append([*simhash.majority([words], len(words)), *sketch(s)])
        made = np.array(fps, np.uint64).reshape(len(n), -1).view(np.int64)
        rest = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()), *(pa.array(made[:, i]) for i in range(len(SKETCHES) + 1))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), batch.column("row_hash"), *rest], names)

    schema = ", ".join(f"{c} {'int' if c == 'n' else 'long'}" for c in names)
    return common.map_batches(simhash.identified(docs), batch_of, schema)


def runs(batches: Iterable[pa.RecordBatch], key: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Starts of the runs of rows that are equal in the first key columns, and the columns; runs are never cut."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out(cols: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:key]], axis=0)]), cols

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= HELD:
            starts, cols = out([np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(batch.num_columns)])
            cut = int(starts[-1])  # the last run may go on
            if cut:
                yield starts[:-1], [c[:cut] for c in cols]
            held = [pa.RecordBatch.from_arrays([pa.array(c[cut:]) for c in cols], batch.schema.names)]
            size = 0  # a run longer than HELD is joined once for each HELD more rows
    if sum(b.num_rows for b in held):
        yield out([np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(held[0].num_columns)])


class Rows:
    """What is compared of the nodes in some buckets."""

    def __init__(self, mask: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, fp: np.ndarray, *sketches: np.ndarray):
        self.mask, self.node, self.root, self.n, self.fp = mask, node, root, n.astype(np.int64), fp.view(np.uint64)
        self.sketches = [s.view(np.uint64) for s in sketches]

    def first(self, a: np.ndarray, b: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the row numbers (a, b) those whose mask is the first of masks under which the fingerprints agree."""
        differ = self.fp[a] ^ self.fp[b]
        before, ok = np.zeros(len(a), bool), np.zeros(len(a), bool)
        for m in masks:
            agree = differ & m.view(np.uint64) == 0
            ok |= (self.mask[a] == m) & ~before
            before |= agree
        return a[ok], b[ok]

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits of the second SimHash that rows a and b differ by."""
        return sum((np.bitwise_count(s[a] ^ s[b]).astype(np.int64) for s in self.sketches), np.zeros(len(a), np.int64))

    def close(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the row numbers (a, b) those of different components that may be similar."""
        for fits in (
            lambda: self.root[a] != self.root[b],
            lambda: np.bitwise_count(self.fp[a] ^ self.fp[b]) <= DISTANCE,
            lambda: 5 * np.minimum(self.n[a], self.n[b]) >= 4 * np.maximum(self.n[a], self.n[b]),
            lambda: self.differing(a, b) <= np.where(np.minimum(self.n[a], self.n[b]) < FEW, FEW_BITS, SKETCH_BITS),
        ):
            ok = fits()
            a, b = a[ok], b[ok]
        return a, b

    def every(self, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All rows of different roots in each run, so many pairs at once as are made by BLOCK rows and a run."""
        sizes = np.diff(np.r_[starts, len(self.node)])
        mixed = np.minimum.reduceat(self.root, starts) != np.maximum.reduceat(self.root, starts)
        short = mixed & (sizes <= SHORT)
        left = np.where(np.repeat(short, sizes), np.repeat(starts + sizes, sizes) - np.arange(len(self.node)), 0)  # rows of the run from here on
        for d in range(1, int(sizes[short].max(initial=1))):
            a = np.flatnonzero(left > d)
            yield self.close(a, a + d)
        for at, size in zip(starts[mixed & ~short].tolist(), sizes[mixed & ~short].tolist(), strict=True):
            fp = self.fp[at : at + size]
            for i in range(0, size, BLOCK):
                a, b = np.nonzero(np.bitwise_count(fp[i : i + BLOCK, None] ^ fp[None, i:]) <= DISTANCE)
                later = b > a
                yield self.close(at + i + a[later], at + i + b[later])

    def nearest(self, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the pairs of every() the nearest of each row."""
        least, of = np.full(len(self.node), SKETCH + 1), np.zeros(len(self.node), np.int64)
        for a, b in self.every(starts):
            bits = self.differing(a, b)
            for x, y in ((a, b), (b, a)):
                order = np.lexsort((bits, x))
                x, y, d = x[order], y[order], bits[order]
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else order
                better = first[d[first] < least[x[first]]]
                least[x[better]], of[x[better]] = d[better], y[better]
        a = np.flatnonzero(least <= SKETCH)
        yield a, of[a]


def probed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """nodes once for each mask, with mask and key."""
    many = nodes.withColumn("mask", F.explode(F.array(*(F.lit(simhash.signed(m)) for m in masks))))
    return many.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def crowded(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """mask and key of the buckets with more than BUCKET nodes, and the blocks they make."""
    size = probed(nodes.select("fp"), masks).groupBy("mask", "key").count().filter(F.col("count") > BUCKET)
    return common.materialize(size.select("mask", "key", F.ceil(F.col("count") / BUCKET).alias("blocks")), "crowded")


def candidates(nodes: DataFrame, masks: list[int], hot: DataFrame, choose: Callable, seed: int | None = None) -> DataFrame:
    """Distinct (u, v) of different components that may be similar, as choose takes them: Rows.nearest or every.

    nodes: node, root, n, fp and the second SimHash. seed: nodes meet only in their blocks, which are dealt by that seed.
    """
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    rows = probed(nodes, masks).join(hot, ["mask", "key"], "left")
    block = lambda of, seed: F.pmod(F.xxhash64("node", F.lit(seed)), of)
    if seed is not None:
        pieces = F.struct(F.lit(0).cast("long").alias("a"), F.coalesce(block(F.col("blocks"), seed), F.lit(0)).cast("long").alias("b"))
    else:
        there = rows.filter("blocks IS NOT NULL").groupBy("mask", "key", "root").count()
        there = there.groupBy("mask", "key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.max("count").alias("in_main"), F.sum("count").alias("all"))
        there = common.materialize(there.select("mask", "key", "main", F.ceil(F.col("in_main") / BUCKET).alias("mains"), F.ceil((F.col("all") - F.col("in_main")) / BUCKET).alias("others")), "blocks")
        rows = rows.join(F.broadcast(there) if there.count() <= BROADCAST_ROWS else there, ["mask", "key"], "left")
        main = F.col("root") == F.col("main")
        mine = F.when(main, F.col("others") + block(F.col("mains"), 0)).otherwise(block(F.greatest("others", F.lit(1)), 0))
        met = F.sequence(F.lit(0).cast("long"), F.col("others") + F.when(main, 0).otherwise(F.col("mains")) - 1)
        split = F.when(F.col("others") > 0, F.transform(met, lambda x: F.struct(F.least(mine, x).alias("a"), F.greatest(mine, x).alias("b"))))
        one = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
        pieces = F.explode(F.when(F.col("blocks").isNull(), one).otherwise(split))
    rows = rows.withColumn("piece", pieces).select("mask", "key", F.col("piece.a").alias("a"), F.col("piece.b").alias("b"), "node", "root", "n", "fp", *SKETCHES)

    order = np.array([simhash.signed(m) for m in masks], np.int64)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, cols in runs(batches, 4):
            of = Rows(cols[0], *cols[4:])
            for a, b in choose(of, starts):
                if seed is None:
                    a, b = of.first(a, b, order)
                if len(a):
                    found = np.unique(np.stack([np.minimum(of.node[a], of.node[b]), np.maximum(of.node[a], of.node[b])]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["u", "v"])

    dealt = rows.repartition("mask", "key", "a", "b").sortWithinPartitions("mask", "key", "a", "b", "fp", "node")
    return dealt.mapInArrow(compare, "u long, v long").distinct()


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose similarity is 4/5 or more, by their whole sets. nodes: node, _id and _idt of a row of each."""
    import xxhash

    asked = pairs.select(F.col("u").alias("node")).distinct().unionByName(pairs.select(F.col("v").alias("node")).distinct()).distinct()
    asked = common.materialize(nodes.join(asked, "node", "left_semi").select("_id", "_idt"), "asked")
    texts = simhash.identified(docs).select("doc_id", "text_hash", "text")
    side = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    texts = texts.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_idt")), "left_semi").select("text")

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(word_hashes(t)) for t in batch.column("text").to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["node", "s"])

    sets = common.materialize(common.map_batches(texts, batch_of, "node long, s array<long>"), "sets")  # twice for a repeated row
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    return both.filter(9 * F.size(F.array_intersect("su", "sv")) >= 4 * (F.size("su") + F.size("sv"))).select("u", "v").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, row_hash and component per row; components join what is linked."""
    rows = common.materialize(described(docs), "described")
    firsts = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "n", "fp", *SKETCHES)).alias("x"))
    firsts = common.materialize(firsts.select("node", F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_idt"), *(f"x.{c}" for c in ("n", "fp", *SKETCHES))), "firsts")
    nodes = firsts.select("node", "n", "fp", *SKETCHES)
    masks = simhash.key_masks(nodes, DISTANCE, ROW_COST)
    hot = crowded(nodes, masks)
    links = tried = roots = None
    rooted = nodes.withColumn("root", F.col("node"))
    for choose, seed in ((Rows.nearest, 1), (Rows.every, None)):
        pairs = candidates(rooted.select("node", "root", "n", "fp", *SKETCHES), masks, hot, choose, seed)
        pairs = common.materialize(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = similar(docs, firsts, pairs)
        links = common.materialize(found if links is None else links.unionByName(found), "links")
        roots = common.materialize(components(links), "roots")
        rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    out = rows.select("doc_id", "text_hash", "row_hash", "node")
    if roots is None:
        return out.withColumnRenamed("node", "component")
    return out.join(roots, "node", "left").select("doc_id", "text_hash", "row_hash", F.coalesce("root", "node").alias("component"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the least doc_id, as simhash.one_of_each() has it."""
    return simhash.one_of_each(docs, common.materialize(near_copies(docs), "components"))
