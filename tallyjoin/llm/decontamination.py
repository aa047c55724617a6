"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become words; every GRAM words have a hash, and of each SPAN - GRAM + 1 neighbouring hashes the least (of equals
the last) is kept as a fingerprint with its place. Whatever SPAN consecutive words a document shares with an item, both
keep the same fingerprint inside them, so joining the fingerprints finds every shared span; each match is then extended
to the windows of SPAN words around it, compared word by word. Items shorter than SPAN have one window, all their words:
they are found by the hashes of all runs of their length, for the at most SPAN - 1 such lengths that occur.

Items of equal words are joined once and their ids put in at the end. The item side is broadcast only while its counted
rows are at most BROADCAST_ROWS; beyond that Spark joins by shuffle. Nothing is ever grouped by a fingerprint or passage,
only by document.

Defined results: null text has no words; a document without words, or any document if the benchmark is empty, has
n_hit = n_items = 0; rows equal in doc_id and text each get the same row; null doc_ids are kept; a null item_id counts as
the id "null"; repeated item_ids count once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyjoin.llm import common
from tallyjoin.names import col, free

# What words are, once A-Z are lower case, and before; and the window. Words are all but
# [\x00-\x2F\x3A-\x60\x7B-\x7F]; naming what is in a class is much faster than naming what isn't.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
ANY_CASE_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
SPAN = 8
#: Words in a hashed gram; windows of SPAN - GRAM + 1 grams then lie within SPAN words.
GRAM = 4
GRAMS = SPAN - GRAM + 1
#: Bits of a fingerprint that hold its place; the others hold the hash. A text of more words (268 million) raises.
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1
#: Most fingerprints of the benchmark that are broadcast, about 300 bytes each.
BROADCAST_ROWS = 200_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """lower() changes more than A-Z, so it serves only where a text is all ASCII."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(WORD), F.lit(0))


def _hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(words, at + i) for i in range(n)))


def with_fingerprints(df: DataFrame) -> DataFrame:
    """Adds _prints, the fingerprints of words, each as hash << PLACE_BITS | (PLACES - place); places count from 0.

    Less comes last among equals, so array_min takes the last of equal hashes.
    """
    words, n = F.col("words"), F.size("words")
    grams = F.when(n > PLACES, F.raise_error(F.lit("a text has more words than there are places"))).when(n >= SPAN, F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.shiftleft(_hash(words, i, GRAM), PLACE_BITS).bitwiseOR(F.lit(PLACES) - i)))
    df = df.withColumn("_grams", grams)
    least = F.transform(F.sequence(F.lit(0), F.size("_grams") - GRAMS), lambda i: F.least(*(F.get("_grams", i + j) for j in range(GRAMS))))
    return df.withColumn("_prints", F.when(F.size("_grams") >= GRAMS, F.array_distinct(least))).drop("_grams")


def print_hash(p: Column) -> Column:
    return F.shiftright(p, PLACE_BITS)


def print_place(p: Column) -> Column:
    return (F.lit(PLACES) - p.bitwiseAND(F.lit(PLACES))).cast("int")


def around(words: Column, place: Column) -> Column:
    """The words of all windows that hold the gram at place; null outside the text."""
    first = place - (GRAMS - 1)
    return F.array(*(F.when(first + i >= 0, F.get(words, F.greatest(first + i, F.lit(0)))) for i in range(SPAN + GRAMS - 1)))


def _runs(k: int) -> Column:
    """start, n and hash of all runs of k words; none for fewer words."""
    last = F.size("words") - k
    run = lambda i: F.struct(i.alias("start"), F.lit(k).alias("n"), _hash(F.col("words"), i, k).alias("_hash"))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(F.array().cast("array<struct<start:int,n:int,_hash:bigint>>"))


def _small(side: DataFrame) -> bool:
    return side.count() <= BROADCAST_ROWS


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, _text, item, start, n): each place where a window of an item occurs. docs: doc_id, _text, words.

    explode_outer, as explode() has Catalyst push a filter on the array below the projections that make it, which puts
    one lambda's array into the other lambda, to be made anew for each element. Rows that match, or that are shuffled to
    be matched, carry the words around a fingerprint, never the text's.
    """
    prints = with_fingerprints(items).withColumn("_p", F.explode_outer("_prints")).filter("_p IS NOT NULL")
    side = common.materialize(prints.select(print_hash(F.col("_p")).alias("_hash"), "item", around(F.col("words"), print_place(F.col("_p"))).alias("_iw")).distinct(), "prints")
    long = with_fingerprints(docs).select("doc_id", "_text", "words", F.explode_outer("_prints").alias("_p")).withColumn("_hash", print_hash(F.col("_p")))
    place, here = print_place(F.col("_p")), around(F.col("words"), print_place(F.col("_p"))).alias("_dw")
    keep = ("doc_id", "_text", (place - (GRAMS - 1)).alias("_first"), here)
    if _small(side):
        met = long.join(F.broadcast(side), "_hash").select(*keep, "item", "_iw")
    else:
        met = long.select("_hash", *keep).join(side, "_hash")
    same = [
        F.when(F.get("_dw", F.lit(i)).isNotNull() & F.get("_dw", F.lit(i + SPAN - 1)).isNotNull() & (F.slice("_dw", i + 1, SPAN) == F.slice("_iw", i + 1, SPAN)), F.col("_first") + i)
        for i in range(GRAMS)
    ]
    found = met.select("doc_id", "_text", "item", F.explode(F.array(*same)).alias("start"), F.lit(SPAN).alias("n")).filter("start IS NOT NULL")
    lengths = sorted(r[0] for r in items.select(F.size("words")).filter(F.size("words") < SPAN).distinct().collect())  # under SPAN rows
    if lengths:  # all of them in one pass
        n = F.size("words")
        hash_of = lambda k: _hash(F.col("words"), F.lit(0), k)
        short = items.filter(n.isin(lengths)).select(F.coalesce(*(F.when(n == k, hash_of(k)) for k in lengths)).alias("_hash"), "item", F.col("words").alias("_iw"))
        runs = docs.select("doc_id", "_text", "words", F.explode_outer(F.concat(*(_runs(k) for k in lengths))).alias("_run"))
        runs = runs.select("doc_id", "_text", "words", "_run.start", "_run.n", "_run._hash")
        run = F.slice("words", F.col("start") + 1, F.col("n"))
        if _small(short):
            met = runs.join(F.broadcast(short), "_hash").filter(run == F.col("_iw"))
        else:
            met = runs.filter("_hash IS NOT NULL").select("doc_id", "_text", "start", "n", "_hash", run.alias("_dw")).join(short, "_hash").filter("_dw = _iw")
        found = found.unionByName(met.select("doc_id", "_text", "item", "start", "n"))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items (ids as sorted strings), contaminated, whole.

    whole: whether a window of SPAN words is hit, not short items alone.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    named = common.materialize(items.groupBy("words").agg(F.collect_set("id").alias("ids")).withColumn("item", F.xxhash64("words")), "items")
    read = docs.select("doc_id", F.xxhash64("text").alias("_text"), words_of(F.col("text")).alias("words"))
    found = hits(read, named.select("item", "words"))
    per = found.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("start", "n")).alias("_runs"), F.collect_set("item").alias("_items"), F.max(F.col("n") == SPAN).alias("whole"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1)))))
    per = common.materialize(per.select("doc_id", "_text", covered.cast("long").alias("n_hit"), "_items", "whole"), "hits")
    ids = per.select("doc_id", "_text", F.explode("_items").alias("item")).join(named.select("item", F.explode("ids").alias("id")), "item")
    ids = ids.groupBy("doc_id", "_text").agg(F.sort_array(F.collect_set("id")).alias("items"))
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_idt"), "items")
    hit = per.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_idt"))).select("_id", "_idt", "n_hit", "items", "whole")
    every = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = every.join(common.materialize(hit, "hit"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_idt")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("doc_id", "_text", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), F.coalesce("whole", F.lit(False)).alias("whole"))
    return out.withColumn("contaminated", F.col("n_items") >= least_items)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, whole_suffices: bool = False) -> DataFrame:
    """docs without the contaminated ones, in their own columns. whole_suffices: nor any that a window of SPAN words is hit in."""
    found = contamination(docs, benchmark, least_items)
    id_, text_ = free("_id", docs), free("_idt", docs)
    bad = found.filter(F.col("contaminated") | F.col("whole") if whole_suffices else F.col("contaminated")).select(F.col("doc_id").alias(id_), F.col("_text").alias(text_)).distinct()
    return docs.join(common.materialize(bad, "bad"), col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(col("text")) == F.col(text_)), "left_anti")
