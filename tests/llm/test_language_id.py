import random
import zlib

import numpy as np

from tallyjoin.llm import language_id as li

SYLLABLES = {"xa": "ba be bo ka ke ko", "xb": "str sch pfl ung eit", "xc": "oué ieu aux ère ç"}


def text(rnd, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(s) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    rnd = random.Random(2)
    return [(i, text(rnd, lang := rnd.choice(sorted(SYLLABLES)), rnd.randint(3, 80)), lang) for i in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    more = [(1000, None, "xa"), (1001, "", None), (1002, "12 %% ..", "xb"), (None, "baba keko", "zz"), (1003, "BA-KE 1 KO", None), (7, rows[7][1], rows[7][2]), (1004, "oué " * 50_000, None), (1005, "² ½ ³", "xa")]
    got = li.identify(docs(spark, rows + more)).collect()
    assert len(got) == len(rows) + len(more) and set(docs(spark, rows).columns) <= set(got[0].asDict())
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(out) > 20 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004, 1005, None)] == ["und", "und", "und", "xa", "xc", "und", "xa"]
    assert all(0 <= r.score <= 1 for r in got) and by[1000].score == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = corpus()
    flipped = [(i, t, "xa" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    pred = lambda rs: sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in li.identify(docs(spark, rs)).collect())
    assert pred(rows) == pred(flipped)


def test_nothing_to_learn_and_empty(spark):
    assert [r.lang_pred for r in li.identify(docs(spark, [(1, "words here", None)])).collect()] == ["und"]
    assert li.identify(docs(spark, [])).collect() == []


def test_parts_of_long_texts_hold_the_same_grams(monkeypatch):
    long = text(random.Random(4), "xc", 3000)
    whole = li.slots(long).tolist()
    monkeypatch.setattr(li, "PART", 97)
    assert li.slots(long).tolist() == whole


def test_known_language_keeps_columns(spark):
    """What has no letter goes, and what is written in a script that was never learnt."""
    d = docs(spark, [*corpus(60), (500, "..", "xa"), (501, None, "xa"), (502, "Совсем другой язык и другие буквы", None)])
    kept = li.known_language(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert {r.lang for r in li.known_language(d, ["xb"]).collect()} == {"xb"}


def test_names_that_helpers_might_use(spark):
    schema = "doc_id long, text string, lang string, _id long, _out long, _n string, `a``.b c` long"
    d = spark.createDataFrame([(i, t, lang, i, i, "n", 7) for i, t, lang in corpus(60)], schema)
    got = li.identify(d)
    assert got.columns == [*d.columns, "held_out", "lang_pred", "score"] and all(r._id == r.doc_id and r[6] == 7 for r in got.collect())
    assert li.known_language(d).columns == d.columns


def plain_grams(t):
    """The slots of a text's n-grams, one at a time."""
    words = " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
    out = set()
    for n in range(1, li.MAX_GRAM + 1):
        for i in range(len(words) + 2 - n + 1):
            h = 0
            for c, f in zip(f" {words} "[i : i + n], li._FACTORS.tolist(), strict=False):
                h = (h + ord(c)) * f % 2**32
            out.add(((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 17)
    return out


def test_model_is_kernel_ridge_regression_on_landmarks():
    """Scores from the kernel itself, pair by pair, with every text a landmark."""
    rows = sorted((lang, t) for _, t, lang in corpus(40))
    grams = [plain_grams(t) for _, t in rows]
    x = np.zeros((len(rows), li.FEATURES), np.uint8)
    for i, g in enumerate(grams):
        x[i, sorted(g)] = 1
    model = li.fit(x, [lang for lang, _ in rows])
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(a, b) for b in grams] for a in grams])
    y = np.array([[1.0 if a == b else -1.0 for b in model.languages] for a, _ in rows])
    alpha = np.linalg.solve(k @ k + li.RIDGE * k + 1e-6 * np.eye(len(k)), k @ y)
    new = [text(random.Random(i), lang, 9) for i, lang in enumerate(("xa", "xb", "xc", "xa"))]
    f = li.SHARPNESS * np.array([[kernel(plain_grams(t), g) for g in grams] for t in new]) @ alpha
    share = np.exp(f) / np.exp(f).sum(1, keepdims=True)
    pred, score = model.predict(new)
    assert pred == [model.languages[i] for i in share.argmax(1)] and np.allclose(score, share.max(1), atol=1e-3)


def test_ties_go_to_the_first_language():
    model = li.Model(["xa", "xb"], np.ones((li.FEATURES, 2), np.float32))
    assert model.predict(["abc", "", None]) == (["xa", "und", "und"], [0.5, 0.0, 0.0])
