"""Corrections of words: all suggestions in order by the kernel, or slips alone by joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dictspark.functions import edits
from dictspark.kernel.rules import Rules
from dictspark.operators.common import by_word
from dictspark.operators.lookup import readings
from dictspark.sources.dictionary import Dictionary


def suggestions(df: DataFrame, dictionary: Dictionary, column: str = "word") -> DataFrame:
    """df with a row for each suggestion: ordinal, kind and suggestion. Words without any have no row.

    Whether a word is right isn't asked; filter by spelled() first. Give distinct words: each costs milliseconds.
    """

    def several(d: Dictionary, w: str) -> list[tuple]:
        return [(k, kind, text) for k, (kind, text) in enumerate(d.corrector.suggestions(w))]

    return by_word(df, column, dictionary, [("ordinal", "int", pa.int32()), ("kind", "string", pa.string()), ("suggestion", "string", pa.string())], several, several=True, costly=True)


def slips(df: DataFrame, words: DataFrame, affixes: DataFrame, rules: Rules, most: int = 15, word: str = "word") -> DataFrame:
    """(word, ordinal, kind, text): for each distinct word of df the first most + 1 right candidates, each text once.

    By joins alone: one capitalisation, no compounds, no stop at a split. rules.rep must hold literal patterns. For
    the whole order of suggestions see suggestions().
    """
    asked = df.select(F.col(word).alias("word")).where("word is not null").distinct()
    rep = [(p.pattern, new) for p, new in rules.rep]
    array = edits.candidates(F.col("word"), rules["TRY"], rules["KEY"], rep, rules.map, split=False)
    tried = asked.select("word", F.inline(array)).groupBy("word", "text").agg(F.min(F.struct("rank", "place", "kind")).alias("c"))
    good = readings(tried, words, affixes, rules, "text", recase=False, nosuggest=False).select(F.col("word").alias("text")).distinct()
    order = Window.partitionBy("word").orderBy("c.rank", "c.place")
    found = tried.join(good, "text").withColumn("ordinal", F.row_number().over(order) - 1).where(F.col("ordinal") <= most)
    return found.select("word", "ordinal", F.col("c.kind").alias("kind"), "text")
