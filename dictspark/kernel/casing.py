"""How words are written: kinds of capitalisation, and other capitalisations worth a try."""

from __future__ import annotations

NO, INIT, ALL, HUHINIT, HUH = "NO", "INIT", "ALL", "HUHINIT", "HUH"


class Casing:
    def kind(self, word: str) -> str:
        """NO lower, INIT one capital first, ALL capitals, HUHINIT mixed with a capital first, HUH anything else."""
        if word.islower():
            return NO
        if word.isupper():
            return ALL
        if word[:1].isupper():
            return INIT if word[1:].islower() else HUHINIT
        return HUH

    def upper(self, word: str) -> str:
        return word.upper()

    def lower(self, word: str) -> list[str]:
        """No form at all for an empty word or one with a dotted capital I in front: that is no capitalisation."""
        return [] if not word or word[0] == "İ" else [word.lower().replace("i̇", "i")]

    def capitalize(self, word: str) -> list[str]:
        head = self.upper(word[:1])
        return [head] if len(word) == 1 else [head + rest for rest in self.lower(word[1:])]

    def lower_first(self, word: str) -> list[str]:
        return [head + word[1:] for head in self.lower(word[:1])]

    def variants(self, word: str) -> tuple[str, list[str]]:
        """The kind of word, and what the dictionary may hold for it, most literal first."""
        kind = self.kind(word)
        more = {INIT: [self.lower], HUHINIT: [self.lower_first], ALL: [self.lower, self.capitalize]}.get(kind, [])
        return kind, [word, *(x for f in more for x in f(word))]

    def corrections(self, word: str) -> tuple[str, list[str]]:
        """As variants(), for words that may also be capitalised wrongly."""
        kind = self.kind(word)
        more = {INIT: [self.lower], HUHINIT: [self.lower_first, self.lower, self.capitalize], HUH: [self.lower], ALL: [self.lower, self.capitalize]}.get(kind, [])
        return kind, [word, *(x for f in more for x in f(word))]

    def coerce(self, word: str, kind: str) -> str:
        if kind in (INIT, HUHINIT):
            return self.upper(word[:1]) + word[1:]
        return self.upper(word) if kind == ALL else word


class TurkicCasing(Casing):
    """Dotted and dotless i are two letters, each with its own capital."""

    _DOWN, _UP = str.maketrans("İI", "iı"), str.maketrans("iı", "İI")

    def lower(self, word: str) -> list[str]:
        return super().lower(word.translate(self._DOWN))

    def upper(self, word: str) -> str:
        return super().upper(word.translate(self._UP))


class GermanCasing(Casing):
    """SS may stand for a sharp s, and a sharp s may stand among capitals."""

    def kind(self, word: str) -> str:
        found = super().kind(word)
        return ALL if "ß" in word and super().kind(word.replace("ß", "")) == ALL else found

    def lower(self, word: str) -> list[str]:
        plain = super().lower(word)
        return [form for x in plain for form in sharpened(x)] if "SS" in word else plain


def sharpened(word: str) -> list[str]:
    """word with every choice of its ss as sharp s, those with the earliest sharp s first, word itself last."""
    *pieces, plain = word.split("ss")
    changed: list[str] = []
    for piece in reversed(pieces):
        changed = [f"{piece}ß{rest}" for rest in (plain, *changed)] + [f"{piece}ss{rest}" for rest in changed]
        plain = f"{piece}ss{plain}"
    return [*changed, plain]


def casing_for(lang: str | None, sharps: bool) -> Casing:
    if sharps:
        return GermanCasing()
    return TurkicCasing() if lang in ("tr", "tr_TR", "az", "crh") else Casing()
