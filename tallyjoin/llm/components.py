"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyjoin.llm import common

#: Most edges that one task takes at once: a few MB.
FEW_EDGES = 200_000


def labelled(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For edges between the numbers 0, 1, ..., the least number of each one's component."""
    label = np.arange(int(max(u.max(initial=-1), v.max(initial=-1))) + 1)
    while True:
        low = np.minimum(label[u], label[v])
        old = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, old[u], low)
        np.minimum.at(label, old[v], low)
        label = label[label]
        if (label == old).all():
            return label


def _in_one_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 2
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = labelled(at[: len(u)], at[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), root being the least node of its component.

    Each round joins every node's neighbours to the least one around it, in O(log^2) rounds. A hub's neighbours are
    never gathered: the least is a partial aggregate, and the join that hands it out can be split by AQE. Every round
    is written to the shared folder, so that a lost executor costs no earlier round. At most FEW_EDGES edges, counted, are
    done in one task instead, which takes less time than the rounds' jobs; the result is the same.
    """
    now = common.materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.count() <= FEW_EDGES:
        return now.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        larger = common.materialize(larger, "larger")
        least = common.materialize(larger.groupBy("u").agg(F.min("v").alias("m")), "least")
        smaller = larger.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        now = common.materialize(smaller, "edges")
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
