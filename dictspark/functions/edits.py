"""Candidates for a column of misspelt words: each function gives an array of strings, in order.

The order and number of candidates are those of kernel.candidates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = "str | Column"


def _none() -> Column:
    return F.array().cast("array<string>")


def _range(start: int | Column, stop: Column) -> Column:
    """start, start + 1 ... below stop; empty if there are none."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>"))


def _part(w: Column, begin: Column | int, end: Column | int) -> Column:
    """Letters begin to end, from 0."""
    begin = F.lit(begin) if isinstance(begin, int) else begin
    return F.substring(w, begin + 1, end - begin)


def _tail(w: Column, begin: Column) -> Column:
    return F.substring(w, begin + 1, F.char_length(w))


def _at(w: Column, i: Column | int) -> Column:
    return F.substring(w, (F.lit(i) if isinstance(i, int) else i) + 1, F.lit(1))


def swap_neighbours(w: Column) -> Column:
    n = F.char_length(w)
    one = F.transform(_range(0, n - 1), lambda i: F.concat(F.left(w, i), _at(w, i + 1), _at(w, i), _tail(w, i + 2)))
    both = F.concat(_at(w, 1), _at(w, 0), F.when(n == 5, _at(w, 2)).otherwise(""), _at(w, n - 1), _at(w, n - 2))
    other = F.concat(_at(w, 0), _at(w, 2), _at(w, 1), _at(w, 4), _at(w, 3))
    return F.when(n == 4, F.concat(one, F.array(both))).when(n == 5, F.concat(one, F.array(both, other))).otherwise(one)


def swap_distant(w: Column) -> Column:
    n = F.char_length(w)

    def with_second(i: Column) -> Column:
        second = F.filter(F.array(i + 2, i + 3), lambda j: j < n)
        return F.transform(second, lambda j: F.concat(F.left(w, i), _at(w, j), _part(w, i + 1, j), _at(w, i), _tail(w, j + 1)))

    return F.flatten(F.transform(_range(0, n - 2), with_second))


def neighbour_keys(w: Column, rows: str) -> Column:
    near: dict[str, list[str]] = {}
    for k, key in enumerate(rows):
        if key != "|":
            near.setdefault(key, []).extend(x for x in (rows[k - 1 : k] if k else "", rows[k + 1 : k + 2]) if x not in ("", "|"))
    table = F.create_map(*(x for key, others in near.items() for x in (F.lit(key), F.array(*map(F.lit, others)).cast("array<string>")))) if near else None

    def at(i: Column) -> Column:
        c = _at(w, i)
        capital = F.when(F.upper(c) != c, F.array(F.upper(c))).otherwise(_none())
        keys = F.concat(capital, F.coalesce(table[c], _none())) if near else capital
        return F.transform(keys, lambda x: F.concat(F.left(w, i), x, _tail(w, i + 1)))

    return F.flatten(F.transform(_range(0, F.char_length(w)), at))


def dropped(w: Column) -> Column:
    n = F.char_length(w)
    return F.when(n > 1, F.transform(_range(0, n), lambda i: F.concat(F.left(w, i), _tail(w, i + 1)))).otherwise(_none())


def _each(letters: str, function) -> Column:
    return F.flatten(F.transform(F.array(*map(F.lit, letters)), function)) if letters else _none()


def inserted(w: Column, letters: str) -> Column:
    return _each(letters, lambda c: F.transform(_range(0, F.char_length(w) + 1), lambda i: F.concat(F.left(w, i), c, _tail(w, i))))


def exchanged(w: Column, letters: str) -> Column:
    if not letters:
        return _none()
    cut = F.transform(F.reverse(_range(0, F.char_length(w))), lambda i: F.struct(F.left(w, i).alias("head"), _at(w, i).alias("own"), _tail(w, i + 1).alias("rest")))

    def by(places: Column, c: Column) -> Column:
        return F.transform(F.filter(places, lambda x: x["own"] != c), lambda x: F.concat(x["head"], c, x["rest"]))

    # The word is cut once for all letters: a list of one list of places, as a lambda's variable.
    every = F.transform(F.array(cut), lambda places: F.flatten(F.transform(F.array(*map(F.lit, letters)), lambda c: by(places, c))))
    return F.element_at(every, 1)


def moved(w: Column) -> Column:
    n = F.char_length(w)
    on = lambda i: F.transform(F.filter(F.array(i + 3, i + 4), lambda to: to < n), lambda to: F.concat(F.left(w, i), _part(w, i + 1, to), _at(w, i), _tail(w, to)))
    back = lambda i: F.transform(F.filter(F.array(i - 2, i - 3), lambda to: to >= 0), lambda to: F.concat(F.left(w, to), _at(w, i), _part(w, to, i), _tail(w, i + 1)))
    return F.concat(F.flatten(F.transform(_range(0, n), on)), F.flatten(F.transform(F.reverse(_range(0, n)), back)))


def undoubled(w: Column) -> Column:
    n = F.char_length(w)
    third = lambda i: F.when(i == 2, _at(w, n - 1)).otherwise(_at(w, i - 3))
    places = F.filter(_range(2, n), lambda i: (_at(w, i - 2) == _at(w, i)) & (third(i) == _at(w, i - 1)))
    return F.when(n >= 5, F.transform(places, lambda i: F.concat(F.left(w, i - 1), _tail(w, i + 1)))).otherwise(_none())


def splits(w: Column, between: str = " ") -> Column:
    """Every split in two, joined by between."""
    return F.transform(_range(1, F.char_length(w)), lambda i: F.concat(F.left(w, i), F.lit(between), _tail(w, i)))


def replaced(w: Column, pairs: list[tuple[str, str]]) -> Column:
    """One match of one literal pattern replaced; an underscore in a replacement is a space."""

    def by(old: str, new: str) -> Column:
        size = len(old)
        # Matches don't overlap: an occurrence counts unless one that counts covers its beginning.
        found = F.filter(_range(0, F.char_length(w) - size + 1), lambda i: F.substring(w, i + 1, F.lit(size)) == old)
        apart = F.aggregate(found, F.array().cast("array<int>"), lambda acc, i: F.when((F.size(acc) == 0) | (i >= F.element_at(acc, -1) + size), F.array_append(acc, i)).otherwise(acc)) if size > 1 else found
        return F.transform(apart, lambda i: F.concat(F.left(w, i), F.lit(new.replace("_", " ")), _tail(w, i + size)))

    every = F.concat(*(by(old, new) for old, new in pairs)) if pairs else _none()
    return F.when(F.char_length(w) > 1, every).otherwise(_none())


def mapped(w: Column, table: list[list[str]], changes: int = 1) -> Column:
    """Spellings of one set in place of each other, with up to so many changes, without regard to order.

    The kernel goes on without a bound; each further change here is one more level of expressions.
    """

    def once(x: Column) -> Column:
        parts = [
            F.when(F.instr(x, one) > 0, F.array(*(F.concat(F.left(x, F.instr(x, one) - 1), F.lit(other), F.substring(x, F.instr(x, one) + len(one), F.char_length(x))) for other in options if other != one))).otherwise(_none())
            for options in table
            for one in options
        ]
        return F.concat(*parts)

    if not table:
        return _none()
    found = once(w)
    level = found
    for _ in range(changes - 1):
        level = F.flatten(F.transform(level, once))
        found = F.concat(found, level)
    return F.when(F.char_length(w) > 1, F.array_distinct(found)).otherwise(_none())


def candidates(w: Column, letters: str, keys: str, rep: list[tuple[str, str]] = (), table: list[list[str]] = (), split: bool = True) -> Column:
    """Array of (rank, place, kind, text): every candidate of one word, in order of emission.

    Splits into two words that are each checked have rank 12.
    """
    dash = "-" in letters or "a" in letters
    kinds = {
        "uppercase": F.array(F.upper(w)),
        "replchars": replaced(w, list(rep)),
        "spaceword": F.flatten(F.transform(splits(w), lambda x: F.array(x, F.replace(x, F.lit(" "), F.lit("-"))))) if dash else splits(w),
        "mapchars": mapped(w, list(table)),
        "swapchar": swap_neighbours(w),
        "longswapchar": swap_distant(w),
        "badcharkey": neighbour_keys(w, keys),
        "extrachar": dropped(w),
        "forgotchar": inserted(w, letters),
        "movechar": moved(w),
        "badchar": exchanged(w, letters),
        "doubletwochars": undoubled(w),
    } | ({"twowords": splits(w)} if split else {})
    # A typed function for each kind, as a lambda would see the loop's last value.
    rows = [F.transform(array, _row(rank, kind)) for rank, (kind, array) in enumerate(kinds.items())]
    return F.concat(*rows)


def _row(rank: int, kind: str):
    return lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("place"), F.lit(kind).alias("kind"), x.alias("text"))
