"""Corpus pipeline: from the documents table to encoded training documents.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All stages but the last return the columns of documents.

1. language_id: texts without a letter, or unlike every learned language, go.
2. line_dedup: lines that repeat an earlier line, or are one word from it, leave
   their texts; a document that keeps no line goes.
3. simhash_near_dedup: one document of each group of near copies stays.
4. mixing: documents are taken 0, 1 or 2 times so that sources meet their targets.
5. bpe: token ids and decoded text of each document taken.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, langid, linededup, mixing, simhash
from tessera.llm.common import table
from tessera.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.without_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mix_sources), ("bpe", encode)]

#: SQL cannot express the stages; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
