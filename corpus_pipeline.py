"""Corpus pipeline over documents: each stage's result is written as Parquet and is the next one's input.

Language identification, exact and near deduplication keep whole rows with all the columns of documents;
packing, the last stage, returns the pieces of the packed sequences. No stage looks at the labels that
another would have to agree with, and each works on all rows that the stage before it kept.

Ids may be null or repeat: the deduplicating stages write a numbered copy of their rows once and decide by
its numbers, which every later read finds again. Null texts count as empty; language identification drops
them, as they have no letter, and the other stages keep one of them. Columns of any name are carried along,
but for "__row_key", which the stages use. An empty table gives no rows in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curavine.llm import exact_dedup as exact
from curavine.llm import language, packing
from curavine.llm import near_dedup as near
from curavine.llm.common import ROW_KEY, materialise, numbered
from curavine.session import find_package

#: Percent of their five-word shingles that near-duplicates share at least.
NEAR_PERCENT = 80


def _kept(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of a numbered table with these row keys, with all their other columns."""
    return rows.join(keys.select(ROW_KEY), ROW_KEY, "left_semi").drop(ROW_KEY)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: without letters, or far from every language."""
    find_package(spark)
    return language.keep_known(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id; of texts without ids, any one."""
    find_package(spark)
    rows = numbered(docs, "rows")
    return _kept(rows, exact.exact_dedup(rows, key_col=ROW_KEY).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; texts without words all stay."""
    find_package(spark)
    rows = numbered(docs, "rows")
    return _kept(rows, near.near_dedup(rows, percent=NEAR_PERCENT, key_col=ROW_KEY).where("keeps_row"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens; a null or empty text is one piece, its end token."""
    find_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language id", language_id), ("exact dedup", exact_duplicates), ("minhash near-dedup", near_duplicates), ("packing", packed)]
#: Neither the languages nor the ids of tokens can be had from SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
