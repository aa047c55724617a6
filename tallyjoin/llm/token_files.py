"""Token-ID output: documents in doc_id order become one long run of ids, cut into equal-length sequences.

Format: for each part, ``*.tokens.arrow`` is an Arrow IPC file, uncompressed, whose batches hold ``ids``
(fixed-size list of uint16, or uint32 for large vocabularies) and ``mask`` (fixed-size list of uint8: 1, or 0 on the
padding at the part's end; run-end encoded, as all masks of a part but the last are equal). All batches but the last hold
BATCH_SEQUENCES. Equal lengths and plain buffers let a reader map the file and reach sequence i without copying or
scanning. ``*.docs.arrow`` has doc_id, start and n_tokens, the place of each document in the part.
``manifest`` (Parquet, written by Spark) names the parts that count: files of lost or repeated task attempts have other
names and are not in it. sequences() numbers the sequences of all parts.

Defined results: null text is empty and yields only the end id; empty tables give no parts and no rows; rows with equal
doc_id are all kept, ordered by their text's hash, a null doc_id comes first; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyjoin.llm import common

#: Tokens in a sequence, and sequences in an Arrow batch of the files.
SEQUENCE = 2048
BATCH_SEQUENCES = 256
#: Units and words whose ids a worker remembers, units that go to the library at once, and bytes of text handled at once.
CACHE_UNITS = 200_000
CACHE_WORDS = 200_000
UNITS_AT_ONCE = 400
TEXT_AT_ONCE = 4 << 20

#: A Latin word and ASCII marks after it: two pieces for a byte-level tokenizer.
WORD_AND_MARKS = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: its own if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()

MANIFEST = "part int, tokens string, docs string, n_docs long, n_tokens long, n_sequences long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Encoder:
    """Ids of whole texts by the tokenizers library, with a memory of the units between single spaces.

    For a byte-level tokenizer whose pattern puts one space before the word that follows, a text can be cut before
    every space that stands between two characters that aren't white space, and the units encode independently. A text
    with any other space, or with the string of a special token, goes to the library as a whole.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.tok.encode_special_tokens = special_as_text
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.units: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.model = self.tok.model
        plain = type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and self.tok.normalizer is None and type(self.model).__name__ == "BPE"
        self.by_word = plain and all(self._word(w) == self.whole([f" {w}"])[0] for w in ("the", "strengthlessness", "Gärtnerin", "déjà"))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _stands_alone(self, unit: str) -> bool:
        return bool(unit) and not unit[0].isspace() and not unit[-1].isspace() and not any(s in unit for s in self.special)

    def _encode_units(self, new: list[str]) -> dict[str, bytes | None]:
        """None where a unit doesn't stand alone: it is empty, has white space at an end, or holds a special token.

        Most units are a word and perhaps marks after it, which the tokenizer takes apart into just these; the model
        then turns the word into ids without the rest of the library's work.
        """
        out: dict[str, bytes | None] = {}
        words, tails, rest = self.words, self.tails, []
        if len(words) > CACHE_WORDS:
            words.clear()
        match = WORD_AND_MARKS.fullmatch if self.by_word else lambda u: None
        for u in new:
            m = match(u)
            if m is None:
                rest.append(u)
                continue
            word, tail = m.groups()
            ids = words.get(word)
            if ids is None:
                ids = words[word] = self._word(word)
            if tail:
                more = tails.get(tail)
                if more is None:
                    more = tails[tail] = self.whole([tail])[0]
                ids += more
            out[u] = ids
        groups = []
        for i in range(0, len(rest), UNITS_AT_ONCE):
            some = [u for u in rest[i : i + UNITS_AT_ONCE] if self._stands_alone(u)]
            out.update(dict.fromkeys(set(rest[i : i + UNITS_AT_ONCE]).difference(some)))
            groups.append(some)
        for some, e in zip(groups, self.tok.encode_batch([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            if some:
                ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
                starts = np.fromiter(map(itemgetter(0), e.offsets), np.int64)
                cuts = (np.searchsorted(starts, np.concatenate([[0], ends])) * self.dtype.itemsize).tolist()
                ids = np.array(e.ids, self.dtype).tobytes()
                out.update(zip(some, map(ids.__getitem__, map(slice, cuts, cuts[1:])), strict=False))
        return out

    def _word(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self.code, [t.id for t in self.model.tokenize(BYTE_LETTERS[32] + spelt)]).tobytes()

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """The memory keeps the first units seen, the frequent ones among them; others last for one call."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return []
        parts = pc.split_pattern(texts, " ")
        of_doc = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        head_at = of_doc[:-1] - of_doc[0]
        of_doc = of_doc - of_doc[0]
        is_unit = np.ones(len(index), bool)
        is_unit[head_at] = False
        used = np.zeros(len(words), bool)
        used[index[is_unit]] = True
        ids = list(map(self.units.get, words, repeat(0)))
        new = [i for i, (known, use) in enumerate(zip(ids, used.tolist(), strict=True)) if known == 0 and use]
        learnt = self._encode_units([words[i] for i in new])
        for i in new:
            ids[i] = learnt[words[i]]
        for i in np.flatnonzero(~used).tolist():  # words that only begin texts
            ids[i] = None
        heads = sorted(set(index[head_at].tolist()))
        good = [h for h in heads if not words[h] or self._stands_alone(words[h])]
        place = np.full(len(words), len(words), np.int64)  # the entry after the words is for heads that don't stand alone
        place[good] = len(words) + 1 + np.arange(len(good))
        index[head_at] = place[index[head_at]]
        values = [*ids, None, *self.whole([words[h] for h in good])]
        got = pa.array(values, pa.large_binary()).take(pa.array(index))
        bad = np.unique(np.searchsorted(of_doc, np.flatnonzero(got.is_null().to_numpy(zero_copy_only=False)), "right") - 1)
        at = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1][of_doc].tolist()
        data = got.buffers()[2].to_pybytes() if got.buffers()[2] else b""
        out = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        for i, x in zip(bad.tolist(), self.whole(texts.take(pa.array(bad)).to_pylist()), strict=True):
            out[i] = x
        if len(self.units) < CACHE_UNITS:
            self.units.update(learnt)
        return out


class PartWriter:
    """Gathers the ids of documents and writes full sequences as they come."""

    def __init__(self, base: str, dtype: np.dtype, length: int):
        self.fs, at = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.length, self.dtype, self.at = length, dtype, 0
        self.kind = pa.from_numpy_dtype(dtype.newbyteorder("="))
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.run_end_encoded(pa.int32(), pa.list_(pa.uint8(), length)))])
        self.tokens = ipc.new_file(self.fs.open_output_stream(at + ".tokens.arrow"), self.schema)
        self.docs = ipc.new_file(self.fs.open_output_stream(at + ".docs.arrow"), DOCS)
        self.held, self.size, self.n_docs = [], 0, 0
        self.sinks = (self.tokens, self.docs)

    def add(self, doc_ids: pa.Array, ids: list[bytes], end: bytes) -> None:
        n = np.array([(len(x) + len(end)) // self.dtype.itemsize for x in ids], np.int64)
        starts = self.at + np.cumsum(n) - n
        self.docs.write_batch(common.batch_of(DOCS, [doc_ids, starts, n]))
        for x in ids:
            self.held += (x, end)
        self.at, self.n_docs, self.size = self.at + int(n.sum()), self.n_docs + len(ids), self.size + int(n.sum())
        if self.size >= self.length * BATCH_SEQUENCES:
            self._flush(self.length * BATCH_SEQUENCES)

    def _flush(self, multiple: int) -> None:
        """Writes whole batches, in which a sequence is found by its number; with multiple 1 also the padded rest."""
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        whole = len(flat) // multiple * multiple
        rest = flat[whole:]
        for i in range(0, whole, self.length * BATCH_SEQUENCES):
            part = flat[i : min(i + self.length * BATCH_SEQUENCES, whole)]
            pad = -len(part) % self.length
            ids = np.concatenate([part, np.zeros(pad, self.dtype)])
            self.tokens.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.length), self._masks(len(part))], schema=self.schema))
        self.held, self.size = [rest.tobytes()], len(rest)

    def _masks(self, n: int) -> pa.RunEndEncodedArray:
        """The masks of the sequences of n tokens: those of full ones as one run, then that of a padded one."""
        full, rest = divmod(n, self.length)
        runs = [(full, self.length)] * (full > 0) + [(full + 1, rest)] * (rest > 0)
        masks = np.array([np.arange(self.length) < k for _, k in runs], np.uint8).ravel()
        return pa.RunEndEncodedArray.from_arrays(pa.array([end for end, _ in runs], pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(masks), self.length))

    def close(self) -> None:
        self._flush(1)
        for x in self.sinks:
            x.close()


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins small batches until they hold TEXT_AT_ONCE bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= TEXT_AT_ONCE:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _open(uri: str) -> ipc.RecordBatchFileReader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def read_sequence(uri: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence i of a tokens file; on a local file both are views of the mapped file."""
    reader = _open(uri)
    per = BATCH_SEQUENCES
    batch = reader.get_batch(i // per)
    ids, mask = batch.column("ids"), batch.column("mask")
    run = int(np.searchsorted(mask.run_ends.to_numpy(), i % per, "right"))
    return ids[i % per].values.to_numpy(zero_copy_only=True), mask.values[run].values.to_numpy(zero_copy_only=True)


def sequences(manifest: DataFrame) -> DataFrame:
    """The manifest with first, the number, from 0 over all parts, of each part's first sequence. One row a part."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_sequences").over(before), F.lit(0)))


def read_documents(tokens: str, docs: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the part, ids) of each document, in order, holding one batch and one document at a time."""
    reader, index = _open(tokens), _open(docs)
    runs = (reader.get_batch(i).column("ids").values.to_numpy(zero_copy_only=True) for i in range(reader.num_record_batches))
    run, at = np.empty(0, np.uint16), 0
    for k in range(index.num_record_batches):
        b = index.get_batch(k)
        for doc, start, n in zip(*(b.column(c).to_pylist() for c in DOCS.names), strict=True):
            got = [run[at : at + n]]
            at += n
            while at > len(run):
                at -= len(run)
                run = next(runs)
                got.append(run[:at])
            yield doc, start, np.concatenate(got) if len(got) > 1 else got[0]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, length: int = SEQUENCE, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """Writes the files of docs (doc_id, text) under out, which executors must reach, and returns the manifest.

    The texts are dealt by range of doc_id (equal ids by text hash, so that one id can't fill a part), so each part is a
    contiguous run of documents; ids are made after the shuffle, once.
    """
    common.bound_batches(docs.sparkSession)
    spark, path = docs.sparkSession, tokenizer

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer = TaskContext.get(), None
        part = task.partitionId()
        base = f"{out}/part-{part:06d}-{task.taskAttemptId()}"
        for batch in gathered(batches):
            if writer is None:
                enc = Encoder(path, special_as_text)
                writer, end = PartWriter(base, enc.dtype, length), np.array([end_id], enc.dtype).tobytes()
            writer.add(batch.column("doc_id"), enc.encode(batch.column("text")), end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "tokens": [f"{base}.tokens.arrow"], "docs": [f"{base}.docs.arrow"], "n_docs": [writer.n_docs], "n_tokens": [writer.at], "n_sequences": [-(-writer.at // length)]})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    dealt = keyed.repartitionByRange(common.partitions_for(docs), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def digest(manifest: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start over all parts, n_tokens, CRC-32 of its ids as uint32."""
    spark = manifest.sparkSession
    parts = manifest.orderBy("part").collect()  # one short row for each written part
    begin = [0, *accumulate(p.n_tokens for p in parts)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    made = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                rows = []
                for doc, start, ids in read_documents(part["tokens"], part["docs"]):
                    rows.append((doc, part["begin"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 8192:
                        yield common.batch_of(made, list(zip(*rows, strict=True)))
                        rows = []
                if rows:
                    yield common.batch_of(made, list(zip(*rows, strict=True)))

    files = spark.createDataFrame([(p.tokens, p.docs, b) for p, b in zip(parts, begin, strict=False)], "tokens string, docs string, begin long")
    return files.repartition(max(1, len(parts))).mapInArrow(read, schema)


def token_output(docs: DataFrame, tokenizer: str, out: str | None = None, **options) -> DataFrame:
    """Writes the token files of docs (under the shared folder unless out is given) and returns digest() of them."""
    return digest(write_tokens(docs, out or common.new_path(docs.sparkSession, "tokens"), tokenizer, **options))
