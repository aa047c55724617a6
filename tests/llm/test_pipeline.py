import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tallyjoin.llm import simhash
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_language_id import text
from tests.llm.test_mixing import size, water
from tests.llm.test_simhash import plain_fingerprint


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(9)
    rows = [(i, text(rnd, lang := rnd.choice(("xa", "xb", "xc")), rnd.randint(20, 120)), lang, f"src{i % 4}") for i in range(150)]
    item = text(rnd, "xa", 12)
    rows += [(200, rows[3][1], "xa", "src0"), (201, rows[3][1], "xa", "src1"), (202, f"{text(rnd, 'xb', 30)} {item.upper()}", "xb", "src2")]
    rows += [(203, "12 .. %%", "xa", "src0"), (204, None, "xa", "src0"), (205, "", None, None), (4, rows[4][1], rows[4][2], rows[4][3])]
    where = str(tmp_path_factory.mktemp("sf"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return rows, item, where


@pytest.fixture(scope="module")
def kept(spark, corpus):
    """The rows that each stage but the last keeps."""
    where = corpus[2]
    docs, out = spark.read.parquet(f"{where}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, where), name)
        assert docs.columns == before.columns
        out[name] = docs.collect()
    return out


def test_stages_against_brute_force(corpus, kept):
    rows, item, _ = corpus
    told = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted((r.doc_id, r.text) for r in kept["language"]) == sorted((r[0], r[1]) for r in told)
    groups = defaultdict(list)
    for r in told:
        groups[plain_fingerprint(r[1])].append(r)
    fps = sorted(groups)
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])  # so components are equal fingerprints
    first = [min(g) for g in groups.values()]
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(r[0] for r in first)
    hit = {d for d, _, n, *_ in contaminated([(r[0], r[1]) for r in first], [(1, item)]) if n}
    assert 202 in hit and sorted(r.doc_id for r in kept["decontaminate"]) == sorted(r[0] for r in first if r[0] not in hit)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in kept["decontaminate"]:
        sizes[r.source] += size(r.text)
    for r in kept["mix"]:
        taken[r.source] += size(r.text)
    assert all(abs(taken[s] - t) <= 16 for s, t in water(sizes).items())


def test_run_gives_the_tokens_of_the_mix(spark, corpus, kept):
    where = corpus[2]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in kept["mix"]:
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 0]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    out = corpus_pipeline.run(spark, where).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == sorted(want)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_names_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "tokens"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11))
    assert simhash.SHINGLE == 3


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_single_short_item_removes_nothing(spark, tmp_path):
    long = " ".join(f"l{i}" for i in range(12))
    spark.createDataFrame([(1, "good morning"), (2, "see you"), (3, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["a good morning to all", "good morning and see you soon", f"x {' '.join(long.split()[2:10])} y", " ".join(long.split()[:7]), "none"]
    docs = spark.createDataFrame([(i, t, "xa", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()) == [0, 3, 4]
