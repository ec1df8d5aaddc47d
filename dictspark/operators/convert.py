"""Conversions, breaks and phonetic codes of columns of words by the kernel."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from dictspark.operators.common import by_word
from dictspark.sources.dictionary import Dictionary


def converted(df: DataFrame, dictionary: Dictionary, column: str = "word", table: str = "iconv", into: str = "converted") -> DataFrame:
    """df with words as the input ("iconv") or output ("oconv") table of the dictionary writes them."""

    def answer(d: Dictionary, w: str) -> tuple:
        conversion = getattr(d.rules, table)
        return (conversion(w) if conversion else w,)

    return by_word(df, column, dictionary, [(into, "string", pa.string())], answer)


def phonetic_codes(df: DataFrame, dictionary: Dictionary, column: str = "word", into: str = "code") -> DataFrame:
    """df with the phonetic code of words; empty if the dictionary has no such rules."""
    return by_word(df, column, dictionary, [(into, "string", pa.string())], lambda d, w: (d.rules.phone(w) if d.rules.phone else "",))


def breakings(df: DataFrame, dictionary: Dictionary, column: str = "word") -> DataFrame:
    """df with a row for each way to break a word: breaking (from 0) and parts; the whole word comes first."""

    def several(d: Dictionary, w: str) -> list[tuple]:
        return list(enumerate(d.speller.breakings(w)))

    return by_word(df, column, dictionary, [("breaking", "int", pa.int32()), ("parts", "array<string>", pa.list_(pa.string()))], several, several=True)
