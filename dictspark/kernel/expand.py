"""Every form that the affixes of an entry make of its stem."""

from __future__ import annotations

from collections.abc import Iterator

from dictspark.kernel.rules import Affix, Entry, Rules


def forms(entry: Entry, rules: Rules) -> Iterator[str]:
    """The stem with no, one or two suffixes, and the same behind each prefix that goes with suffixes.

    Forbidden entries have no forms; a stem or affix that needs another isn't given by itself. Compounds and
    circumfixes aren't looked at, so some forms may be no words.
    """
    need, stem = rules["NEEDAFFIX"], entry.stem
    if rules["FORBIDDENWORD"] in entry.flags:
        return

    def fitting(kind: str, flags: frozenset[str], base: str) -> list[Affix]:
        return [x for f in sorted(flags) for x in rules.affixes[kind].get(f, ()) if x.fits(base)]

    def suffixed(base: str, own: list[Affix], crossed: bool) -> Iterator[str]:
        for outer in own:
            once = outer.apply(base)
            if crossed or need not in outer.flags:
                yield once
            for more in fitting("SFX", outer.flags, once):
                if more.cross or not crossed:
                    yield more.apply(once)

    if need not in entry.flags:
        yield stem
    suffixes = fitting("SFX", entry.flags, stem)
    yield from suffixed(stem, suffixes, False)
    for prefix in fitting("PFX", entry.flags, stem):
        base = prefix.apply(stem)
        if need not in prefix.flags:
            yield base
        if prefix.cross:
            more = [x for x in fitting("SFX", prefix.flags, base) if x.cross and x not in suffixes]
            yield from suffixed(base, suffixes + more, True)
