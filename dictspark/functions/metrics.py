"""Likeness of two columns of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(w: Column) -> Column:
    return F.filter(F.split(w, ""), lambda c: c != "")


def same_places(a: Column, b: Column) -> Column:
    """Places at which both words have the same letter."""
    return F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda hit: hit))


def prefix_length(a: Column, b: Column) -> Column:
    most = F.least(F.char_length(a), F.char_length(b))
    return F.array_max(F.filter(F.sequence(F.lit(0), most), lambda i: F.left(a, i) == F.left(b, i)))


def _spans(a: Column, n: int | Column) -> Column:
    """Every stretch of n letters of a, in order."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.char_length(a) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(a, i + 1, n))).otherwise(F.array().cast("array<string>"))


def shared_grams(most: int | Column, a: Column, b: Column, weighted: bool = False, mismatch: bool = False, longer: bool = False) -> Column:
    """Stretches of a of 1 to most letters that b has, less a penalty for lengths; see kernel.similar.shared_grams."""
    sizes = F.sequence(F.lit(1), F.greatest(F.lit(most) if isinstance(most, int) else most, F.lit(1)))

    def hits(n: Column) -> Column:
        found = _spans(a, n)
        if not weighted:
            return F.size(F.filter(found, lambda x: F.contains(b, x)))
        cost = lambda x, i: F.when(F.contains(b, x), 1).when((i == 0) | (i + n == F.char_length(a)), -2).otherwise(-1)
        return F.aggregate(F.transform(found, cost), F.lit(0), lambda s, x: s + x)

    def step(acc: Column, n: Column) -> Column:
        ns = hits(n)
        return F.when(acc["go"], F.struct((acc["t"] + ns).alias("t"), (F.lit(True) if weighted else ns >= 2).alias("go"))).otherwise(acc)

    total = F.aggregate(sizes, F.struct(F.lit(0).alias("t"), F.lit(True).alias("go")), step, lambda acc: acc["t"])
    gap = F.char_length(b) - F.char_length(a)
    excess = gap - 2 if longer else F.abs(gap) - 2 if mismatch else F.lit(0)
    return F.when(F.char_length(b) == 0, 0).otherwise(total - F.greatest(excess, F.lit(0)))


def subsequence_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table for each letter of a."""
    rows = F.aggregate(
        letters(a),
        F.array_repeat(F.lit(0), F.char_length(b) + 1),
        lambda above, x: F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.char_length(b), F.lit(1))),
            F.array(F.lit(0)),
            lambda row, j: F.array_append(row, F.when(F.substring(b, j, F.lit(1)) == x, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.get(row, j - 1)))),
        ),
    )
    return F.when((F.char_length(a) == 0) | (F.char_length(b) == 0), 0).otherwise(F.element_at(rows, -1))


def root_score(word: Column, stem: Column) -> Column:
    low = F.lower(stem)
    return shared_grams(3, word, low, longer=True) + prefix_length(word, low)


def rough_score(word: Column, form: Column) -> Column:
    return shared_grams(F.char_length(word), word, form, mismatch=True) + prefix_length(word, form)


def threshold(word: Column) -> Column:
    """The score that a form must pass: see kernel.similar.threshold."""
    n = F.char_length(word)

    def blotted(start: int) -> Column:
        return F.array_join(F.transform(letters(word), lambda c, i: F.when((i >= start) & ((i - start) % 4 == 0), "*").otherwise(c)), "")

    total = sum((shared_grams(n, word, blotted(s), mismatch=True) for s in (2, 3)), shared_grams(n, word, blotted(1), mismatch=True))
    return F.floor(total / 3).cast("int") - 1


def precise_score(word: Column, form: Column, rough: Column, factor: float = 1.0, sound: bool = False) -> Column:
    common = subsequence_length(word, form)
    a, b = F.char_length(word), F.char_length(form)
    pairs = shared_grams(2, word, form, weighted=True, mismatch=True) + shared_grams(2, form, word, weighted=True, mismatch=True)
    score = 2 * common - F.abs(a - b) + prefix_length(word, form) + F.when(same_places(word, F.lower(form)) > 0, 1).otherwise(0)
    score = score + shared_grams(4, word, form, mismatch=True) + pairs
    doubtful = pairs < (b if sound else a + b) * F.lit(factor)
    return F.when((a == b) & (common == a), rough + 2000).otherwise(score - F.when(doubtful, 1000).otherwise(0))
