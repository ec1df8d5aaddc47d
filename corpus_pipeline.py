"""From raw documents to token files: language, near-duplicates, contamination, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it again as the next one's docs. An empty table goes through all of them. No stage is expressed in SQL; tests hold
each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dictspark.llm import decontaminate, langid, minhash, mixing, tokenbin
from dictspark.llm.common import materialize, release_scratch, scratch_tables, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on: those with a letter, and a score of 0.5 or more. Null texts go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group goes on: five-word shingles, a similarity of 0.8 or more.

    Texts without words and rows with a null doc_id stay; rows that share a doc_id stay or go together.
    """
    return minhash.keep_one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark go on, null and empty texts among them; an empty benchmark stops nothing."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are read at tempered weights, none more than mixing.REPETITION times on average, within all their tokens.

    A null source is a source like any other; rows that share a doc_id are read together; texts without words go with
    their block.
    """
    return mixing.resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; what is read back from them for each document, repeated ones included.

    Null texts have the end id alone; rows with a null doc_id come first.
    """
    return tokenbin.token_output(docs, tokenbin.vocabulary(), end_id=2)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("token-ID output", tokens),
]

#: SQL has no tokenizer, and rounds of graph search over all pairs would be too slow in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for documents; what stages wrote on the way is deleted as soon as their result is stored."""
    docs = table(spark, sf_dir, "documents")
    since = scratch_tables(spark)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release_scratch(spark, since, keep=docs)
    return docs
