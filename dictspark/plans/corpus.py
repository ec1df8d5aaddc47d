"""Corpus reports: tokens are counted before anything else, so that each distinct word is looked at once.

Counts are used twice, to check the words and to sum up. Both sides ask for the count, so that they have one exchange
and texts are read once; nothing is cached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictspark.functions.text import tokens
from dictspark.kernel.rules import Rules
from dictspark.operators.lookup import checked


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt out anew where a plain scan has fewer tasks than there are cores: what explodes texts would leave cores idle."""
    plan = docs._jdf.queryExecution()
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan":  # holds a shuffle, and would run here
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(2 * cores) if plan.toRdd().getNumPartitions() < cores else docs


def table_tokens(docs: DataFrame, *by: str, text: str = "text", lower: bool = True) -> DataFrame:
    """(by..., word): a row for each token of docs.

    By explode_outer(): for explode() Spark adds a filter that finds all tokens a second time. Words are said not to be null
    here, so that what joins and callers say of it later changes no plan below the exchange of counts.
    """
    found = tokens(F.lower(F.col(text)) if lower else F.col(text))
    return docs.select(*by, F.explode_outer(found).alias("word")).where("word is not null")


def token_counts(docs: DataFrame, *by: str, text: str = "text", lower: bool = True) -> DataFrame:
    """(by..., word, count): tokens of docs, summed up on the map side before the one shuffle."""
    return table_tokens(docs, *by, text=text, lower=lower).groupBy(*by, "word").count()


def error_rates(docs: DataFrame, words: DataFrame, affixes: DataFrame, rules: Rules, *by: str, text: str = "text") -> DataFrame:
    """(by..., tokens, good): tokens and right tokens of docs."""
    return rates(token_counts(spread(docs), *by, text=text).where("count > 0"), words, affixes, rules, *by)


def rates(counts: DataFrame, words: DataFrame, affixes: DataFrame, rules: Rules, *by: str) -> DataFrame:
    """error_rates() of tokens that have been counted: counts has (by..., word, count)."""
    joined = counts.join(checked(counts, words, affixes, rules), "word")
    return joined.groupBy(*by).agg(F.sum("count").alias("tokens"), F.sum(F.when(F.col("correct"), F.col("count")).otherwise(0)).alias("good"))


def top_misspellings(docs: DataFrame, words: DataFrame, affixes: DataFrame, rules: Rules, k: int = 100, text: str = "text") -> DataFrame:
    """(word, count): the k most frequent wrong words, ties by word."""
    return most_frequent_wrong(token_counts(spread(docs), text=text).where("count > 0"), words, affixes, rules, k)


def most_frequent_wrong(counts: DataFrame, words: DataFrame, affixes: DataFrame, rules: Rules, k: int = 100) -> DataFrame:
    """top_misspellings() of tokens that have been counted: counts has (word, count)."""
    wrong = checked(counts, words, affixes, rules).where("not correct").select("word")
    return counts.join(wrong, "word").orderBy(F.desc("count"), "word").limit(k)
