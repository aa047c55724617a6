"""Mixing sources to target weights, with DataFrame functions only.

1. Sizes: words of each document; per source the sums, and its target: its weight's share of the whole mix, at most
   ``most`` times its size, the excess shared again by weight (a water level over the sources).
2. Sainte-Lague: the mix is cut into equal blocks of BLOCK words and these go to the sources by highest quotients
   target / (2k + 1); each source's blocks go to its shards the same way, by shard size. A shard is a seeded hash class
   of a source's documents; big sources have more of them, so no task holds a source.
3. Seeded selection: a shard's documents lie on a circle in seeded order; its blocks are consecutive from a seeded word.
   A document's part is what that run covers, more than once if the run goes round.

Highest quotients need no list of all blocks: around the divisor (sum of votes / seats) a party's seats are off by no
more than its share of the number of parties, plus 2, so only those seats are ranked.

Defined results: null text has size 0; a null source is a source, ordered last; sources without words have target 0;
rows with equal doc_id are documents of their own (equal in all columns: interchangeable); null doc_id is allowed; extra
columns, of any names, are kept by sample() and change only which of equal ids and texts comes first; an empty table gives
an empty result. A source has at most MAX_SHARDS shards: beyond 134 million words in a source they only grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyjoin.llm import common
from tallyjoin.names import col, free

# Words, and the weights that the sources take in turn.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words in a block, words a shard should have at least, and most shards of a source.
BLOCK = 16
SHARD_WORDS = 1 << 15
MAX_SHARDS = 4096


def targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """sources (source, source_size) with rank, weight, cap and target: one row a source, on one task."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_rank", F.row_number().over(by_name)).withColumn("_weight", F.get(F.array(*map(F.lit, weights)), (F.col("_rank") - 1) % len(weights)))
    everything = W.partitionBy()
    by_need = W.orderBy("_need", "_rank")
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_weight").over(by_need.rowsBetween(0, W.unboundedFollowing))
    capped = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size")).withColumn("_need", F.col("_cap") / F.col("_weight")).withColumn("_level", level)
    water = F.coalesce(F.max(F.when(F.col("_need") >= F.col("_level"), F.col("_level"))).over(everything), F.max("_need").over(everything))
    return capped.withColumn("target", F.when(F.col("_need") <= water, F.col("_cap")).otherwise(F.col("_weight") * water)).drop("_need", "_level")


def ranked_seats(votes: Column, total_votes: Column, seats: Column, parties: Column) -> tuple[Column, Column]:
    """Seats that a party has for sure, and the numbers k of those that must be ranked by votes / (2k + 1)."""
    fair = F.floor(votes * seats / total_votes + 0.5)
    off = F.ceil(parties * votes / total_votes) + 2
    sure = F.greatest(fair - off, F.lit(0).cast("long"))
    return sure, F.sequence(sure, fair + off)


def source_seats(sources: DataFrame) -> DataFrame:
    """Adds seats: blocks of each source by highest quotients, ties to the earlier source. Few rows a source."""
    everything = W.partitionBy()
    total = F.sum("target").over(everything)
    withal = sources.withColumn("_total", total).withColumn("_seats", F.floor(F.col("_total") / BLOCK + 0.5)).withColumn("_parties", F.count("*").over(everything))
    sure, ks = ranked_seats(F.col("target"), F.col("_total"), F.col("_seats"), F.col("_parties"))
    some = F.col("target") > 0
    bids = withal.withColumn("_sure", F.when(some, sure).otherwise(0)).withColumn("_left", F.col("_seats") - F.sum("_sure").over(everything))
    bids = bids.withColumn("_k", F.explode_outer(F.when(some, ks)))
    order = W.orderBy((F.col("target") / (2 * F.col("_k") + 1)).desc_nulls_last(), "_rank")
    won = bids.withColumn("_won", (F.row_number().over(order) <= F.col("_left")) & F.col("_k").isNotNull())
    return won.groupBy("_rank").agg(F.first("source").alias("source"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), (F.first("_sure") + F.sum(F.col("_won").cast("long"))).alias("seats"))


def shard_seats(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source and shard: its words and its blocks, by highest quotients among the source's shards.

    cells has the words of each source's MAX_SHARDS hash classes; shards fold them to a power of two by the source's
    size. The shards of a source, at most MAX_SHARDS, are ranked within one row's array.
    """
    folded = (
        cells.join(sources.select(F.col("source").alias("_s"), "_shards"), F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("_s", (F.col("_cell") % F.col("_shards")).alias("_shard"))
        .agg(F.sum("words").alias("words"))
        .filter("words > 0")
        .groupBy("_s")
        .agg(F.collect_list(F.struct("_shard", "words")).alias("_list"))
    )
    each = sources.join(folded, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_n", F.size("_list").cast("long"))

    def bid(x: Column) -> Column:
        sure, ks = ranked_seats(x["words"], F.col("source_size"), F.col("seats"), F.col("_n"))
        bids = F.transform(ks, lambda k: F.struct((x["words"] / (2 * k + 1)).alias("q"), (-x["_shard"]).alias("s")))
        return F.struct(x["_shard"].alias("shard"), x["words"].alias("words"), sure.alias("sure"), bids.alias("bids"))

    bids = each.withColumn("_bids", F.transform("_list", bid))
    left = bids.withColumn("_left", (F.col("seats") - F.aggregate("_bids", F.lit(0).cast("long"), lambda a, x: a + x["sure"])).cast("int"))
    last = left.withColumn("_last", F.get(F.sort_array(F.flatten(F.col("_bids.bids")), asc=False), F.col("_left") - 1))
    won = lambda x: x["sure"] + F.when(F.col("_left") > 0, F.size(F.filter(x["bids"], lambda b: b >= F.col("_last")))).otherwise(0)
    shards = last.withColumn("_x", F.explode(F.transform("_bids", lambda x: F.struct(x["shard"].alias("shard"), x["words"].alias("words"), won(x).alias("blocks")))))
    return shards.select("source", "source_size", "target", F.col("_x.shard").alias("_shard"), F.col("_x.words").alias("_shard_words"), F.col("_x.blocks").alias("_blocks"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken and parts, the (from, to) word ranges it gives.

    The text is read once; what goes on from there are a few numbers a document, which are shuffled once by shard.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), common.row_hash(docs).alias("_row"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_key"))
    rows = common.materialize(sized, "sizes")
    cells = rows.groupBy("source", F.pmod("_key", F.lit(MAX_SHARDS)).alias("_cell")).agg(F.sum("size").alias("words"))
    cells = common.materialize(cells, "cells")
    sources = source_seats(targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights))
    shards_of = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("source_size") / SHARD_WORDS, F.lit(1.0)))))
    sources = common.materialize(sources.withColumn("_shards", F.least(shards_of, F.lit(float(MAX_SHARDS))).cast("long")), "sources")
    quotas = shard_seats(cells, sources)
    placed = rows.join(sources.select(F.col("source").alias("_s"), "_shards", F.col("source_size").alias("_z"), F.col("target").alias("_t")), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_shard", F.pmod("_key", F.lit(MAX_SHARDS)) % F.col("_shards"))
    quota = quotas.select(F.col("source").alias("_qs"), F.col("_shard").alias("_qshard"), "_shard_words", "_blocks")
    met = placed.join(quota, F.col("source").eqNullSafe(F.col("_qs")) & (F.col("_shard") == F.col("_qshard")), "left")
    line = W.partitionBy("source", "_shard").orderBy("_key", "doc_id", "_row")
    start = F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    round_ = F.col("_shard_words")
    first = F.pmod(F.xxhash64(F.lit(seed), "source", "_shard"), round_)
    last = first + F.least(F.col("_blocks") * BLOCK, F.floor(F.lit(float(most)) * round_))
    on_line = met.withColumn("_start", start).withColumn("_first", first).withColumn("_last", last)
    laps = F.sequence(F.lit(0), F.lit(int(most) + 1))

    def part(lap: Column) -> Column:
        at = lap * F.col("_shard_words") + F.col("_start")
        return F.struct((F.greatest(F.col("_first"), at) - at).alias("from"), (F.least(F.col("_last"), at + F.col("size")) - at).alias("to"))

    parts = F.filter(F.transform(laps, part), lambda p: p["from"] < p["to"])
    out = on_line.withColumn("parts", F.when(F.col("_last") > F.col("_first"), parts).otherwise(F.filter(parts, lambda p: F.lit(False))))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["to"] - p["from"])
    return out.select("doc_id", "source", "size", F.col("_z").alias("source_size"), F.col("_t").alias("target"), F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "parts", "_row")


def sample(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mixed documents themselves, in docs' columns: a row for each part taken, its text cut to the part's words.

    n_chars, if there, follows the text. Documents of which nothing is taken go. Texts are shuffled once, to their parts; of
    rows that are equal in all columns, which alone can't be told apart, one stands for all and gives the parts of all.
    """
    id_, row_, parts_, part_, size_ = (free(c, docs) for c in ("_id", "_row", "_parts", "_part", "_size"))
    mixed = mix(docs, seed=seed, **options).groupBy(F.col("doc_id").alias(id_), F.col("_row").alias(free("_row2", docs)), F.col("size").alias(size_))
    mixed = mixed.agg(F.flatten(F.collect_list("parts")).alias(parts_), (F.count("*") > 1).alias("again"))
    mixed = common.materialize(mixed.filter(F.size(parts_) > 0), "parts")
    mine = docs.withColumn(row_, common.row_hash(docs))
    same = col("doc_id").eqNullSafe(F.col(id_)) & (F.col(row_) == F.col(free("_row2", docs)))
    again = mixed.filter("again").drop("again")
    one = mine.join(again.select(id_, free("_row2", docs)), same, "left_semi").dropDuplicates(["doc_id", row_])
    met = mine.join(mixed.filter("NOT again").drop("again"), same).unionByName(one.join(again, same))
    met = met.withColumn(part_, F.explode(parts_))
    start, end = F.col(part_)["from"], F.col(part_)["to"]
    whole = (start == 0) & (end == F.col(size_))
    words = F.regexp_extract_all(F.col("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(words, (start + 1).cast("int"), (end - start).cast("int")), ""))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return met.select(*(out[c].alias(c) if c in out else col(c) for c in docs.columns))
