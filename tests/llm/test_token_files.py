import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyjoin.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ENCODER = tf.Encoder(PATH)


def plain(text):
    return TOK.encode(text, add_special_tokens=False).ids


def coded(texts):
    return [np.frombuffer(x, ENCODER.dtype).tolist() for x in ENCODER.encode(pa.array(texts, pa.string()))]


ODD = ["", " ", "a  b", "  a", "a b ", "a\n b", "a \nb", "a  b c", "x <|endoftext|> y", "<|endoftext|>", "don't stop 's it's", "a\tb c", "1 2 33 ! ?? a!b", "​a ​", "日本 語 x", " 　 a", "a \x1c b", "a\x85 b", "re.\n\nThe end", "é è"]


def test_odd_texts_encode_as_the_library_does():
    assert coded(ODD) == [plain(t) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é\n\t.,'s1  　!<|>"), max_size=40), max_size=6))
def test_any_texts_encode_as_the_library_does(texts):
    assert coded(texts) == [plain(t) for t in texts]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start int, part string")


def test_files_give_back_every_document(spark):
    rows = [(i * 7 % 50, f"word{i} and more text {i}\n" * (i % 9), 1, "x") for i in range(50)] + [(3, None, 1, "x"), (3, "", 1, "x"), (None, "no id", 1, "x")]
    out = sorted(tf.token_output(docs(spark, rows).repartition(3), PATH, length=64).collect(), key=lambda r: r.start)
    assert len(out) == len(rows)
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*plain(t or ""), 0], "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in out) == sorted((r[0] or -1, crc(r[1])) for r in rows)


def test_sequences_are_equal_long_masked_and_not_copied(spark, tmp_path):
    rows = [(i, "some words to fill " * 40, 1, "x") for i in range(30)]
    manifest = tf.write_tokens(docs(spark, rows).coalesce(1), f"file://{tmp_path}/t", PATH, length=32).collect()
    whole = np.concatenate([ids for p in sorted(manifest) for _, _, ids in tf.read_documents(p.tokens, p.docs)])
    assert len(whole) == sum(p.n_tokens for p in manifest) == 30 * (len(plain(rows[0][1])) + 1)
    for p in manifest:
        ids, mask = tf.read_sequence(p.tokens, 0)
        assert len(ids) == len(mask) == 32 and not ids.flags.owndata
        last, mask = tf.read_sequence(p.tokens, -(-p.n_tokens // 32) - 1)
        assert mask.sum() == p.n_tokens - p.n_tokens // 32 * 32 or mask.all()


def test_masks_take_no_byte_a_token(tmp_path):
    """Every mask is read back as bytes, not copied, but the equal ones are written once a batch."""
    length, n = 64, 64 * (2 * tf.BATCH_SEQUENCES + 3) + 7
    writer = tf.PartWriter(f"file://{tmp_path}/p", ENCODER.dtype, length)
    for i, size in enumerate([n // 2, n - n // 2 - 2]):
        writer.add(pa.array([i]), [np.full(size, 5, ENCODER.dtype).tobytes()], np.array([0], ENCODER.dtype).tobytes())
    writer.close()
    path = tmp_path / "p.tokens.arrow"
    n_sequences = -(-n // length)
    for i in [0, 1, tf.BATCH_SEQUENCES - 1, tf.BATCH_SEQUENCES, n_sequences - 2, n_sequences - 1]:
        ids, mask = tf.read_sequence(f"file://{path}", i)
        assert mask.tolist() == [1] * min(length, n - i * length) + [0] * max(0, (i + 1) * length - n)
        assert mask.dtype == np.uint8 and not mask.flags.owndata and len(ids) == length
    assert path.stat().st_size < 2.2 * n


def test_empty_table(spark):
    assert tf.token_output(docs(spark, []), PATH).collect() == []


def test_special_strings_can_be_text():
    text = "x <|endoftext|>"
    as_text = np.frombuffer(tf.Encoder(PATH, special_as_text=True).encode(pa.array([text]))[0], "<u2").tolist()
    assert 50256 in coded([text])[0] and 50256 not in as_text
