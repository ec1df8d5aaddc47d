"""Questions about the entries of a dictionary table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def lower_keys(words: DataFrame, *more: str) -> DataFrame:
    """(key, line_no, more...): entries by lower-cased stem; those in lower case by each of their letters, as Lexicon.by_lower."""
    letters = F.array_distinct(F.filter(F.split("stem", ""), lambda c: c != ""))
    lowered = F.array(F.replace(F.lower("stem"), F.lit("i̇"), F.lit("i")))
    return words.select(F.explode(F.when(F.col("captype") == "NO", letters).otherwise(lowered)).alias("key"), "line_no", *more)


def homonyms(df: DataFrame, words: DataFrame, column: str = "word", ignore_case: bool = False) -> DataFrame:
    """df joined with all entries whose stem is the word; ignore_case: by lower_keys()."""
    if ignore_case:
        words = lower_keys(words, *(c for c in words.columns if c != "line_no")).withColumnRenamed("key", "__key")
    else:
        words = words.withColumn("__key", F.col("stem"))
    return df.join(words, F.col(column) == F.col("__key")).drop("__key")


def has_flag(df: DataFrame, words: DataFrame, flag: str, for_all: bool = False, column: str = "word") -> DataFrame:
    """df with has_flag: whether any (for_all: every) entry with that stem has the flag; false if there is none."""
    one = F.array_contains("flags", flag)
    by_stem = words.groupBy(F.col("stem").alias(column)).agg((F.bool_and(one) if for_all else F.bool_or(one)).alias("has_flag"))
    return df.join(by_stem, column, "left").withColumn("has_flag", F.coalesce("has_flag", F.lit(False)))
