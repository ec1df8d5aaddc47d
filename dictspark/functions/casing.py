"""Capitalisation of a column of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER, _UPPER, _TITLE = r"\p{IsLowercase}", r"\p{IsUppercase}", r"\p{Lt}"


def kind(w: Column) -> Column:
    """NO, INIT, ALL, HUHINIT or HUH; null stays null."""
    rest = F.substring(w, 2, 1 << 30)
    low, up, title = w.rlike(_LOWER), w.rlike(_UPPER), w.rlike(_TITLE)
    initial = F.left(w, F.lit(1)).rlike(_UPPER)
    return (
        F.when(w.isNull(), None)
        .when(low & ~up & ~title, "NO")
        .when(up & ~low & ~title, "ALL")
        .when(initial & rest.rlike(_LOWER) & ~rest.rlike(_UPPER) & ~rest.rlike(_TITLE), "INIT")
        .when(initial, "HUHINIT")
        .otherwise("HUH")
    )


def kind_german(w: Column) -> Column:
    return F.when(F.contains(w, F.lit("ß")) & (kind(F.replace(w, F.lit("ß"), F.lit(""))) == "ALL"), "ALL").otherwise(kind(w))


def _none() -> Column:
    return F.array().cast("array<string>")


def _lowered(w: Column) -> Column:
    return F.replace(F.lower(w), F.lit("i̇"), F.lit("i"))


def lower(w: Column) -> Column:
    """Array of the lower-cased word; empty for empty words and a dotted capital I in front."""
    return F.when((w == "") | w.startswith("İ"), _none()).otherwise(F.array(_lowered(w)))


def upper(w: Column) -> Column:
    return F.upper(w)


#: Letters whose capital has several letters, and the single one that each has instead: its own, or the letter itself.
_LONG = [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1]
_SHORT = ["ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _LONG]


def upper_letter(c: Column) -> Column:
    """The capital of one letter as one letter: ẞ for ß, not SS."""
    return F.when(F.char_length(F.upper(c)) <= 1, F.upper(c)).otherwise(F.translate(c, "".join(_LONG), "".join(_SHORT)))


def capitalize(w: Column) -> Column:
    head, rest = F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30)
    return F.when(F.char_length(w) == 1, F.array(head)).otherwise(F.transform(lower(rest), lambda x: F.concat(head, x)))


def lower_first(w: Column) -> Column:
    return F.transform(lower(F.left(w, F.lit(1))), lambda x: F.concat(x, F.substring(w, 2, 1 << 30)))


def variants(w: Column) -> Column:
    """The ways in which a dictionary may hold the word, in order."""
    own, k = F.array(w), kind(w)
    return F.when(k == "INIT", F.concat(own, lower(w))).when(k == "HUHINIT", F.concat(own, lower_first(w))).when(k == "ALL", F.concat(own, lower(w), capitalize(w))).otherwise(own)


def corrections(w: Column) -> Column:
    own, k = F.array(w), kind(w)
    return (
        F.when(k.isin("INIT", "HUH"), F.concat(own, lower(w)))
        .when(k == "HUHINIT", F.concat(own, lower_first(w), lower(w), capitalize(w)))
        .when(k == "ALL", F.concat(own, lower(w), capitalize(w)))
        .otherwise(own)
    )


def coerce(w: Column, k: Column) -> Column:
    return F.when(k.isin("INIT", "HUHINIT"), F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))).when(k == "ALL", F.upper(w)).otherwise(w)


def turkic_lower(w: Column) -> Column:
    return lower(F.translate(w, "İI", "iı"))


def turkic_upper(w: Column) -> Column:
    return F.upper(F.translate(w, "iı", "İI"))


def german_lower(w: Column) -> Column:
    """The lower-cased word with every choice of its ss as sharp s, if the word has SS; the plain form last."""
    pieces = F.split(_lowered(w), "ss", -1)
    start = F.struct(_none().alias("changed"), F.element_at(pieces, -1).alias("plain"))

    def step(acc: Column, piece: Column) -> Column:
        sharp = F.transform(F.concat(F.array(acc["plain"]), acc["changed"]), lambda x: F.concat(piece, F.lit("ß"), x))
        plain = F.transform(acc["changed"], lambda x: F.concat(piece, F.lit("ss"), x))
        return F.struct(F.concat(sharp, plain).alias("changed"), F.concat(piece, F.lit("ss"), acc["plain"]).alias("plain"))

    earlier = F.reverse(F.slice(pieces, 1, F.size(pieces) - 1))
    every = F.aggregate(earlier, start, step, lambda acc: F.concat(acc["changed"], F.array(acc["plain"])))
    return F.when(F.contains(w, F.lit("SS")) & ~w.startswith("İ"), every).otherwise(lower(w))
