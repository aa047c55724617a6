"""A corpus, from documents to token files, in five stages.

Each stage takes what its predecessor kept, as Parquet, and all but the last return the columns of documents:

1. language: documents whose language the model can't tell, or isn't sure of, go;
2. near_duplicates: one document of each component stays, that of the least doc_id; SimHash finds the candidates, and links are
   those whose five-word shingles have a Jaccard similarity of 4/5 or more;
3. decontaminate: documents that hold eight words in a row of any benchmark item go, or the whole of two shorter items;
4. mix: documents as often, and in part, as the target weights of their sources ask;
5. tokens: equal-length token sequences in Arrow files; returns a digest of each document, read back from them.

Nulls, empty texts, repeated rows and empty tables are handled as each operator states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyjoin.llm import decontamination, language_id, mixing, near_copies, token_files
from tallyjoin.llm.common import materialize, table

TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.distinct_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A single item's window of eight words is enough to go: a leak is mostly one item in one document. An item of fewer words
    may be an everyday phrase, so where only such ones are hit it takes two, as in op4."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), whole_suffices=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_output(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
