import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyjoin.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, seq int, formatted string"
ODD = ["<|im_end|>", "<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<", "|", "<|", "a\nb", "", None, "\\", "<<|", "é<|im_end|>\n", "$1 \\1"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "f") for r in rows], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def want(turns):
    turns = [(r or "", t or "") for r, t in turns]
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt)


def test_turns_come_back_whatever_they_say(spark):
    rows = [(c, i, ("user", "assistant", "assistant", "sys tem\n<|")[(c + i) % 4], ODD[(c * 3 + i) % len(ODD)]) for c in range(20) for i in range(c % 7 + 1)]
    rows += [(None, 0, "user", "x"), (99, None, "assistant", "b"), (99, 1, None, "c"), (98, 2, "user", "same"), (98, 2, "user", "same"), (98, 2, "assistant", "z")]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_chats(chat.events_of(table(spark, rows)))).collect()}
    by = {}
    for c, i, r, t in rows:
        by.setdefault(c, []).append((i is not None, i or 0, r or "", t or ""))
    assert got == {c: want([x[2:] for x in sorted(ts)]) for c, ts in by.items()}


def test_formatted_text_and_mask(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yo")]
    r = chat.format_chats(chat.events_of(table(spark, rows))).first()
    assert r.formatted == "<|im_start|>user\nhi <\\|im_end|><|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert [r.formatted[s.start : s.end] for s in r.loss] == ["yo"]


def test_a_wrong_mask_is_noticed(spark):
    made = chat.format_chats(chat.events_of(table(spark, [(1, 0, "user", "é <|x"), (1, 1, "assistant", "yo <| ü")])))
    assert chat.read_back(made).first().loss_sha256 == sha("yo <| ü")
    moved = made.withColumn("loss", F.transform("loss", lambda r: F.struct((r["start"] - 1).alias("start"), (r["end"] - 1).alias("end"))))
    assert chat.read_back(moved).first().loss_sha256 != sha("yo <| ü")


def test_very_long_texts(spark):
    long = "<|é " * 100_000
    got = chat.read_back(chat.format_chats(chat.events_of(table(spark, [(1, 0, "user", long), (1, 1, "assistant", long)])))).first()
    assert tuple(got)[1:5] == want([("user", long), ("assistant", long)])


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "message", "user", "questoin", None),
        (1, 2, "message", "assistant", "An", None),
        (1, 3, "delta", None, "sw", None),
        (1, 4, "delta", None, "er", None),
        (1, 5, "edit", "user", "question", 1),
        (1, 6, "regenerate", "assistant", "Bet", None),
        (1, 7, "delta", None, "ter", None),
        (1, 8, "edit", None, "Best", None),
        (1, 9, "delta", None, "!", None),
        (2, 1, "delta", "assistant", "orphan", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string, target long")
    got = [(r.conv_id, r.role, r.text) for r in chat.fold(events).orderBy("conv_id", "number").collect()]
    assert got == [(1, "user", "question"), (1, "assistant", "Best!"), (2, "assistant", "orphan")]
    read = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_chats(events)).collect()}
    assert read == {1: want([("user", "question"), ("assistant", "Best!")]), 2: want([("assistant", "orphan")])}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(st.sampled_from("<\\|a$"), max_size=12), min_size=30, max_size=30))
def test_escaping_is_reversible_and_leaves_no_control(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    assert all(r.u == r.t and "<|" not in r.e for r in df.collect())


def test_empty(spark):
    assert chat.read_back(chat.format_chats(chat.events_of(table(spark, [])))).collect() == []
