"""Tokens, numbers, ignored letters and break points of columns of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of letters; empty for null. An addition of ours: dictionaries themselves know single words only."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1), F.array().cast("array<string>"))


def is_number(w: Column) -> Column:
    return w.rlike(r"^\p{Nd}+(\.\p{Nd}+)?$")


def without(w: Column, letters: str) -> Column:
    return F.translate(w, letters, "")


def broken(w: Column, mark: str = "-") -> Column:
    """The parts of a word at every mark, none empty: the finest of the ways in which the kernel breaks it."""
    return F.filter(F.split(w, rf"\Q{mark}\E", -1), lambda x: x != "")
