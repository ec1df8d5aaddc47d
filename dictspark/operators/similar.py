"""Dictionary words most like each of many words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from dictspark.operators.common import by_word
from dictspark.sources.dictionary import Dictionary


def nearest_roots(df: DataFrame, dictionary: Dictionary, k: int = 100, column: str = "word") -> DataFrame:
    """df with a row for each of the k entries of highest root score: stem, score, rank (from 1); ties by stem, falling.

    Entries no suggestion may use are left out, as are those more than four letters longer or shorter. All entries are
    scored at once from an index of letter groups; comparing pair by pair with functions.metrics takes a hundred times
    as long.
    """

    def several(d: Dictionary, w: str) -> list[tuple]:
        return [(stem, score, rank) for rank, (score, stem) in enumerate(d.corrector.similar.roots(w.lower(), k), 1)]

    return by_word(df, column, dictionary, [("stem", "string", pa.string()), ("score", "bigint", pa.int64()), ("rank", "bigint", pa.int64())], several, several=True, costly=True)


def alike(df: DataFrame, dictionary: Dictionary, sounds: bool = False, column: str = "word") -> DataFrame:
    """df with a row for each form of an entry that looks like the word, or each stem that sounds like it: ordinal, suggestion.

    The best come first, doubtful ones only where there is nothing better. Nothing is left out because of slips, capitals or
    a limit on suggestions; for that see suggestions(). Sounds need PHONE rules; without them there are no rows.
    """

    def several(d: Dictionary, w: str) -> list[tuple]:
        similar = d.corrector.similar
        return list(enumerate(similar.by_sound(w) if sounds else similar.by_letters(w, set())))

    return by_word(df, column, dictionary, [("ordinal", "bigint", pa.int64()), ("suggestion", "string", pa.string())], several, several=True, costly=True)
