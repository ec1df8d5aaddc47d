"""Dictionaries on streams: stateless, so that any source, trigger and sink of Structured Streaming will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictspark.functions.text import tokens
from dictspark.operators.lookup import spelled
from dictspark.sources.dictionary import Dictionary


def misspellings(stream: DataFrame, dictionary: Dictionary, text: str = "text") -> DataFrame:
    """The tokens of a stream of texts that are wrong, with the other columns of their rows.

    A batch DataFrame will do too. Nothing is kept between micro-batches; null texts have no tokens.
    """
    others = [F.col(c) for c in stream.columns if c != text]
    words = stream.select(*others, F.explode(tokens(F.col(text))).alias("word"))
    return spelled(words, dictionary).where("not correct").drop("correct")
