"""Language identification with a string kernel.

Kernel: the blended spectrum of n-grams of 1 to MAX_GRAM letters, by presence: the number of n-grams two texts share,
over the root of the product of their numbers. N-grams are code points of the lower-cased text, anything but letters
being one space, hashed to FEATURES slots. Nystroem: the kernel against LANDMARKS landmark texts; one-versus-rest kernel
ridge regression on them. As the kernel is a scalar product of presence vectors, landmarks and coefficients multiply out
to one matrix (slots x languages); texts are scored ROWS at a time, by the product of their presence vectors with it.

The model is fitted on at most PER_LANGUAGE texts a language and TRAIN_ROWS in all, the first in hash order of doc_id, each
language's first before any's second; all texts are read whole.

Defined results: a text that is null or has no letter is "und" with score 0; without any learnable row all are "und";
doc_id null is never learnt from and not held out; repeated rows are rows of their own; ties go to the language first by
code point; score is the share of the winner in a softmax over the languages; columns of any names are kept, but for those
named held_out, lang_pred and score, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyjoin.llm import common
from tallyjoin.names import col

MAX_GRAM = 4
FEATURES = 1 << 15
PER_LANGUAGE = 250
TRAIN_ROWS = 2000
LANDMARKS = 256
RIDGE = 0.1
SHARPNESS = 4.0
UNKNOWN = "und"
#: Texts that are scored by one product, and characters whose n-grams are made at once.
ROWS = 64
PART = 1 << 20
#: How far from the even share of all languages to certainty the winner's share must be for known_language() to keep a text.
LEAST_SURE = 0.2
NOT_LETTERS = re.compile(r"[\W\d_]+")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def slots(text: str | None) -> np.ndarray:
    """The sorted slots of the n-grams that occur in text; empty if it has no letter."""
    letters = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    flags = np.zeros(FEATURES, bool)
    if not any(map(str.isalpha, letters)):  # such as superscript digits, which are neither digits nor letters
        return np.empty(0, np.int64)
    code = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for i in range(0, len(code), PART):
        c = code[i : i + PART + MAX_GRAM - 1]
        h = np.zeros(len(c), np.uint32)
        for n in range(MAX_GRAM):
            h = (h[: len(c) - n] + c[n:]) * _FACTORS[n] if n else c * _FACTORS[0]
            flags[((h ^ (h >> 15)) * np.uint32(0x2C1B3C6D)) >> 17] = True
    return np.flatnonzero(flags)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slots x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return pred, score
        for at in range(0, len(texts), ROWS):
            found = [slots(t) for t in texts[at : at + ROWS]]
            sizes = np.array([len(x) for x in found], np.int64)
            x = np.zeros((len(found), FEATURES), np.float32)
            x[np.repeat(np.arange(len(found)), sizes), np.concatenate(found)] = 1.0
            f = SHARPNESS * (x @ self.weights) / np.sqrt(np.maximum(sizes, 1))[:, None]
            p = np.exp(f - f.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, k, share in zip(np.flatnonzero(sizes).tolist(), p.argmax(1)[sizes > 0].tolist(), p.max(1)[sizes > 0].tolist(), strict=True):
                pred[at + i], score[at + i] = self.languages[k], share
        return pred, score


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """x: presence vectors as rows. Landmarks are spread evenly over the rows, which are in language order."""
    languages = sorted(set(labels))

    def unit(rows: np.ndarray) -> np.ndarray:
        return rows.astype(np.float32) / np.sqrt(np.maximum(rows.sum(1, dtype=np.float32, keepdims=True), 1))

    marks = unit(x[np.unique(np.linspace(0, len(x) - 1, min(LANDMARKS, len(x))).astype(int))])
    k = np.concatenate([unit(x[i : i + 128]) @ marks.T for i in range(0, len(x), 128)]).astype(np.float64)
    kk = (marks @ marks.T).astype(np.float64)
    y = np.array([[1.0 if a == b else -1.0 for b in languages] for a in labels])
    alpha = np.linalg.solve(k.T @ k + RIDGE * kk + 1e-6 * np.eye(len(marks)), k.T @ y)
    return Model(languages, (marks.T.astype(np.float64) @ alpha).astype(np.float32))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fits on texts with a language that aren't held out. Ids are chosen first, then only their texts are read."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "lang", "text")
    ids = docs.select("doc_id", "lang", held_out().alias("_out")).filter("NOT _out AND lang IS NOT NULL AND doc_id IS NOT NULL")
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = ids.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= PER_LANGUAGE)
    chosen = ranked.orderBy("_n", F.xxhash64("doc_id"), "doc_id", "lang").limit(TRAIN_ROWS).collect()
    keys = spark.createDataFrame([(i,) for i in sorted({r.doc_id for r in chosen})], "_id long")
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("bits", pa.binary())])

    def bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column("text").to_pylist():
            flags = np.zeros(FEATURES, bool)
            flags[slots(t)] = True
            rows.append(np.packbits(flags).tobytes())
        return common.batch_of(out, [batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())])

    texts = docs.filter("text IS NOT NULL AND lang IS NOT NULL").join(F.broadcast(keys), F.col("doc_id") == F.col("_id"), "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    rows = sorted((r.lang, r.doc_id, bytes(r.bits)) for r in common.map_batches(texts, bits, "doc_id long, lang string, bits binary").collect() if any(r.bits))
    per: dict[str, int] = {}
    kept = []
    for r in rows:  # repeated ids can't make a language larger
        per[r[0]] = per.get(r[0], 0) + 1
        if per[r[0]] <= PER_LANGUAGE and len(kept) < TRAIN_ROWS:
            kept.append(r)
    if not kept:
        return Model([], np.zeros((FEATURES, 0), np.float32))
    x = np.unpackbits(np.frombuffer(b"".join(r[2] for r in kept), np.uint8).reshape(len(kept), -1), axis=1)
    return fit(x, [r[0] for r in kept])


def identify(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score added (taking the place of columns of these names). Narrow after training."""
    model = train(docs)
    share = docs.sparkSession.sparkContext.broadcast(model)  # slots x languages floats
    kept = [c for c in docs.columns if c.lower() not in ("held_out", "lang_pred", "score")]
    table = docs.select(*map(col, kept), held_out().alias("held_out"))

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        pred, score = share.value.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*table.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return common.map_batches(table, batch_of, schema)


def known_language(docs: DataFrame, languages: Sequence[str] | None = None, least: float = LEAST_SURE) -> DataFrame:
    """docs, in their own columns, of those languages (of any learnt one, if none are named) that the model is sure of.

    A text goes if it has no letter, if the winner's share is less than least of the way from the even share to 1 (as that of
    a text in a language or script that was never learnt is), or if the winner isn't among languages. Where nothing could be
    learnt all texts go.
    """
    share = docs.sparkSession.sparkContext.broadcast(train(docs))

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        won, s = share.value.predict(batch.column("text").to_pylist())
        even = 1 / max(1, len(share.value.languages))
        return batch.filter(pa.array([w != UNKNOWN and x >= even + least * (1 - even) and (languages is None or w in languages) for w, x in zip(won, s, strict=True)], pa.bool_()))

    return common.map_batches(docs, batch_of, docs.schema)
