"""Chat formatting as event sourcing, with DataFrame functions only.

A log has one event a row: conv_id, seq, kind, role, text, target. In order of seq, ``message`` opens a message,
``delta`` adds text to the newest one, ``regenerate`` opens one that supersedes the message before it, and ``edit``
replaces the text of message number target (from 1; null: the newest). The fold runs in windows of a conversation
sorted by seq, which spill, then per message, then per conversation, all on one shuffle.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message. Inside texts a control string can't arise: each
``<``, backslashes, ``|`` gets one backslash more, which unescape() takes away again; roles are URL-encoded.

Defined results: null text, role and kind count as empty, empty and message; a null seq comes first; events equal in seq
are ordered by role, then text; repeated rows are messages of their own; rows with a null conv_id form a conversation;
extra columns are ignored; an empty table gives an empty result. A conversation is one string, so it is made by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"

EVENT = ("conv_id", "seq", "kind", "role", "text", "target")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, number, role, text, after deltas, edits and regenerations."""
    clean = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("target").cast("long").alias("target"))
    opens = F.col("kind").isin("message", "regenerate")
    line = W.partitionBy("conv_id").orderBy("seq", "role", "text", "kind", "target").rowsBetween(W.unboundedPreceding, 0)
    placed = clean.withColumn("_newest", F.sum(opens.cast("long")).over(line)).withColumn("_at", F.row_number().over(W.partitionBy("conv_id").orderBy("seq", "role", "text", "kind", "target")))
    mine = placed.withColumn("number", F.when(F.col("kind") == "edit", F.coalesce("target", "_newest")).otherwise(F.col("_newest")))
    event = F.struct("_at", "kind", "role", "text")
    lists = mine.groupBy("conv_id", "number").agg(F.sort_array(F.collect_list(event)).alias("_log"))
    # Whatever replaces the text comes last among those that do; deltas after it add to it.
    base = F.coalesce(F.array_max(F.transform(F.filter("_log", lambda e: e["kind"] != "delta"), lambda e: e["_at"])), F.lit(0))
    text = F.array_join(F.transform(F.filter("_log", lambda e: e["_at"] >= base), lambda e: e["text"]), "")
    opened = F.coalesce(F.get(F.filter("_log", lambda e: e["kind"].isin("message", "regenerate")), 0), F.get("_log", 0))
    made = lists.select("conv_id", "number", opened["role"].alias("role"), text.alias("text"), (opened["kind"] == "regenerate").alias("_again"))
    order = W.partitionBy("conv_id").orderBy("number")
    return made.withColumn("_superseded", F.lead("_again", 1, False).over(order)).filter("NOT _superseded").select("conv_id", "number", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: formatted, and loss, its mask: the ranges (start, end) of formatted, in code points, that are learnt."""
    head, body = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")), escape(F.col("text"))
    made = messages.select("conv_id", "number", (F.col("role") == LEARNT).alias("learnt"), F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body"), F.concat(head, body, F.lit(END)).alias("piece"))
    before = F.coalesce(F.sum(F.length("piece")).over(W.partitionBy("conv_id").orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = before + F.col("head")
    made = made.select("conv_id", "number", "piece", F.when(F.col("learnt"), F.struct(start.alias("start"), (start + F.col("body")).alias("end"))).alias("range"))
    per = made.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("number", "piece", "range"))).alias("all"))
    loss = F.filter(F.transform("all", lambda m: m["range"]), lambda r: r.isNotNull())
    return per.select("conv_id", loss.alias("loss"), F.array_join(F.transform("all", lambda m: m["piece"]), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the learnt text that formatted holds, as digests, from the formatted text and its mask alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), _turn)
    under = lambda r: unescape(F.substr("formatted", (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))
    learnt = F.array_join(F.transform("loss", under), "")
    read = formatted.select("conv_id", turns.alias("_turns"), learnt.alias("_learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_learnt").cast("long").alias("loss_chars"), F.sha2("_learnt", 256).alias("loss_sha256"), "formatted_chars")


def _turn(piece: Column) -> Column:
    """Role and text of a piece that begins with START and has the role up to the first line end."""
    head = F.instr(piece, "\n")
    role = F.substr(piece, F.lit(len(START) + 1), head - len(START) - 1)
    return F.struct(F.url_decode(role).alias("role"), unescape(F.substr(piece, head + 1)).alias("text"))


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, loss (the mask) and formatted of every conversation of an event log."""
    return render(fold(events))


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log of whole messages."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text", F.lit(None).cast("long").alias("target"))
