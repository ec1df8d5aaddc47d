"""Readings of a word: entries and affixes, or several of them joined, that make up a form; and whether a word is right."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from dictspark.kernel.casing import ALL, INIT, NO
from dictspark.kernel.rules import Affix, Entry, Rules

#: Places in a compound; None for a word by itself.
BEGIN, MIDDLE, END = "COMPOUNDBEGIN", "COMPOUNDMIDDLE", "COMPOUNDEND"
_NUMBER = re.compile(r"\d+(\.\d+)?")
_NONE: frozenset[str] = frozenset()
#: Answers kept by each cache before it is emptied.
REMEMBERED = 200_000


class Reading:
    """text as entry with affixes: prefixes and suffixes hold rules from the stem outwards."""

    __slots__ = ("entry", "prefixes", "stem", "suffixes", "text")

    def __init__(self, text: str, stem: str, prefixes: tuple[Affix, ...] = (), suffixes: tuple[Affix, ...] = (), entry: Entry | None = None) -> None:
        self.text, self.stem, self.prefixes, self.suffixes, self.entry = text, stem, prefixes, suffixes, entry

    @property
    def affixed(self) -> bool:
        return bool(self.prefixes or self.suffixes)

    @property
    def flags(self) -> frozenset[str]:
        """Of the entry and the affixes next to the stem; outer ones don't count."""
        own = self.entry.flags if self.entry else _NONE
        return own.union(*(x[0].flags for x in (self.prefixes, self.suffixes) if x))


class Lexicon:
    """Rules and entries with the tables by which they are found."""

    def __init__(self, rules: Rules, entries: list[Entry]) -> None:
        self.rules, self.entries = rules, entries
        self.ends = {"SFX": self._by_add("SFX"), "PFX": self._by_add("PFX")}
        self.longest = {kind: max(map(len, rows), default=-1) for kind, rows in self.ends.items()}

    @functools.cached_property
    def by_stem(self) -> dict[str, Entry | list[Entry]]:
        """Entries by stem; a list only where there are several."""
        out: dict[str, Entry | list[Entry]] = {}
        for e in self.entries:
            found = out.setdefault(e.stem, e)
            if isinstance(found, list):
                found.append(e)
            elif found is not e:
                out[e.stem] = [found, e]
        return out

    @functools.cached_property
    def by_lower(self) -> dict[str, list[Entry]]:
        """Entries by lower-cased stem. Those written in lower case are filed under each of their letters, which is
        what the words written in capitals of existing dictionaries have been tested against."""
        out: dict[str, list[Entry]] = {}
        for e in self.entries:
            for key in e.stem if e.kind == NO else self.rules.casing.lower(e.stem):
                out.setdefault(key, []).append(e)
        return out

    def _by_add(self, kind: str) -> dict[str, list[Affix]]:
        out: dict[str, list[Affix]] = {}
        for x in self.rules.all_affixes(kind):
            out.setdefault(x.add, []).append(x)
        return out

    def named(self, stem: str) -> list[Entry]:
        found = self.by_stem.get(stem)
        return found if isinstance(found, list) else [] if found is None else [found]

    def any_has(self, stem: str, flag: str | None) -> bool:
        return flag is not None and any(flag in e.flags for e in self.named(stem))

    def all_have(self, stem: str, flag: str | None) -> bool:
        found = self.named(stem)
        return bool(found) and all(flag in e.flags for e in found)

    def stripped(self, kind: str, word: str, needed: frozenset[str], barred: frozenset[str], cross: bool = False) -> Iterator[tuple[str, Affix]]:
        """(stem, rule) of every affix that word may have, shortest first."""
        table = self.ends[kind]
        for n in range(min(self.longest[kind], len(word)) + 1):
            for rule in table.get(word[len(word) - n :] if kind == "SFX" else word[:n], ()):
                if needed <= rule.flags and not barred & rule.flags and (rule.cross or not cross):
                    stem = rule.undo(word)
                    if stem is not None:
                        yield stem, rule

    def layers(self, kind: str, word: str, needed: frozenset[str], barred: frozenset[str], cross: bool = False, twice: bool = True) -> Iterator[tuple[str, tuple[Affix, ...]]]:
        """(stem, rules from the stem outwards) of one affix or two; the inner of two must allow the outer one."""
        for stem, outer in self.stripped(kind, word, needed, barred, cross):
            yield stem, (outer,)
            if twice:
                for core, inner in self.stripped(kind, stem, needed | {outer.flag}, barred, cross):
                    yield core, (inner, outer)


class Speller:
    """Answers for one word at a time, and remembers some."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.rules = lexicon, lexicon.rules
        r = self.rules
        self.permit = frozenset([r["COMPOUNDPERMITFLAG"]] if r["COMPOUNDPERMITFLAG"] else [])
        self.forbid = frozenset([r["COMPOUNDFORBIDFLAG"]] if r["COMPOUNDFORBIDFLAG"] else [])
        self.ignored = {ord(c): None for c in r["IGNORE"]}
        self.compounds = bool(r["COMPOUNDBEGIN"] or r["COMPOUNDFLAG"])
        self.checked: dict[str, bool] = {}
        self.known: dict[tuple, bool] = {}
        self.ruled: dict[str, _Ruled] = {}

    def __reduce__(self):
        return _speller, (self.rules, self.lexicon.entries)

    # One word, no compound

    def hypotheses(self, word: str, place: str | None = None, pre: frozenset[str] = _NONE, suf: frozenset[str] = _NONE, barred: frozenset[str] = _NONE) -> Iterator[Reading]:
        """Every way to take affixes off word, whether the dictionary has the stem or not, in order of precedence."""
        yield Reading(word, word)
        ends = place in (None, END) or bool(suf)
        if ends:
            for stem, rules in self.lexicon.layers("SFX", word, suf, barred):
                yield Reading(word, stem, (), rules)
        if place in (None, BEGIN) or pre:
            for stem, rules in self.lexicon.layers("PFX", word, pre, barred, twice=self.rules["COMPLEXPREFIXES"]):
                yield Reading(word, stem, rules)
                if ends and rules[0].cross:
                    for core, inner in self.lexicon.layers("SFX", stem, suf, barred, cross=True):
                        yield Reading(word, core, rules[:1], inner)

    def readings(self, word: str, kind: str, place: str | None = None, pre: frozenset[str] = _NONE, suf: frozenset[str] = _NONE, barred: frozenset[str] = _NONE, nosuggest: bool = True, forbidden: bool = False) -> Iterator[Reading]:
        """Readings of word that the dictionary has. kind is that of the word as it was asked for.

        A forbidden stem under an affix or in a compound ends the search: what comes later is not looked at.
        """
        lexicon, rules = self.lexicon, self.rules
        banned = None if forbidden else rules["FORBIDDENWORD"]
        initial = place == BEGIN and rules["FORCEUCASE"] and kind == INIT
        capitals = place is None and kind == ALL and rules.casing.kind(word) == NO
        for h in self.hypotheses(word, place, pre, suf, barred):
            if banned and (place or h.affixed) and lexicon.any_has(h.stem, banned):
                return
            entries = lexicon.named(h.stem)
            if initial:
                entries = entries + lexicon.named(h.stem.lower())
            good = [x for x in map(h_with(h), entries) if self.allowed(x, kind, place, nosuggest)]
            if not good and capitals:
                good = [x for x in map(h_with(h), lexicon.by_lower.get(h.stem, ())) if self.allowed(x, kind, place, nosuggest)]
            yield from good

    def allowed(self, x: Reading, kind: str, place: str | None, nosuggest: bool) -> bool:
        rules, own = self.rules, x.entry.flags
        if not nosuggest and rules["NOSUGGEST"] in own:
            return False
        if rules["KEEPCASE"] in own and kind != x.entry.kind and not (rules["CHECKSHARPS"] and "ß" in x.entry.stem):
            return False
        need = rules["NEEDAFFIX"]
        if need is not None and (all(need in a.flags for a in (*x.prefixes, *x.suffixes)) if x.affixed else need in own):
            return False
        flags = x.flags
        inner = [side[0] for side in (x.prefixes, x.suffixes) if side]
        if any(a.flag not in flags for a in inner):
            return False
        circumfix = rules["CIRCUMFIX"]
        if circumfix is not None and len({bool(side) and circumfix in side[0].flags for side in (x.prefixes, x.suffixes)}) == 2:
            return False
        if place is None:
            return rules["ONLYINCOMPOUND"] not in flags
        return rules["COMPOUNDFLAG"] in flags or rules[place] in flags

    # Compounds

    def compound_readings(self, word: str, kind: str, nosuggest: bool = True, brief: bool = False) -> Iterator[list[Reading]]:
        """Readings of word as a compound; brief: for compounds by rules an empty list, if there are any."""
        banned = self.rules["FORBIDDENWORD"]
        if banned and any(banned in x.flags for x in self.readings(word, kind, forbidden=True)):
            return
        if self.compounds:
            parts = _Parts(self, word, kind, nosuggest)
            yield from parts.follow([], 0)
        if self.rules.compound_rules and brief:
            if kind not in self.ruled:
                self.ruled[kind] = _Ruled(self, kind)
            yield from [[]] if self.ruled[kind].fits(word) else []
        elif self.rules.compound_rules:
            yield from self._ruled(word, kind, [], 0, [(rule, rule.start) for rule in self.rules.compound_rules])

    def _ruled(self, word: str, kind: str, done: list[Reading], at: int, alive: list[tuple]) -> Iterator[list[Reading]]:
        """Compounds of bare stems by rules; alive: rules that the stems so far follow, and where they stand."""
        least, most = self.rules["COMPOUNDMIN"], self.rules["COMPOUNDWORDMAX"]
        rest = word[at:]
        if done:
            last = Reading(rest, rest)
            for entry in self.lexicon.named(rest):
                if any(rule.done(rule.step(places, entry.flags)) for rule, places in alive) and self.may_meet(done[-1], last, kind, True) and self.may_end(last, kind):
                    yield [*done, last]
        if len(rest) < 2 * least or most and len(done) >= most:
            return
        for cut in range(least, len(rest) - least + 1):
            part = Reading(rest[:cut], rest[:cut])
            entries = self.lexicon.named(part.text)
            if not entries or done and not self.may_meet(done[-1], part, kind, False):
                continue
            for entry in entries:
                stepped = [(rule, to) for rule, places in alive if (to := rule.step(places, entry.flags))]
                if stepped:
                    yield from self._ruled(word, kind, [*done, part], at + cut, stepped)

    def may_end(self, last: Reading, kind: str) -> bool:
        forced = self.rules["FORCEUCASE"]
        return not (forced and kind not in (ALL, INIT) and self.lexicon.any_has(last.text, forced))

    def may_meet(self, left: Reading, right: Reading, kind: str, final: bool) -> bool:
        """Whether two words may be neighbours in a compound; final: right is its last one."""
        rules, a, b = self.rules, left.text, right.text
        if self.lexicon.any_has(a, rules["COMPOUNDFORBIDFLAG"]) or self.single(f"{a} {b}", kind):
            return False
        if rules["CHECKCOMPOUNDREP"] and any(self.single(x, kind) for x in replaced(a + b, rules.rep)):
            return False
        if rules["CHECKCOMPOUNDTRIPLE"] and (len({*a[-2:], *b[:1]}) == 1 or len({*a[-1:], *b[:2]}) == 1):
            return False
        if rules["CHECKCOMPOUNDCASE"] and "-" not in (a[-1], b[0]) and (b[0] == b[0].upper() or a[-1] == a[-1].upper()):
            return False
        if any(p.matches(left, right) for p in rules.compound_patterns):
            return False
        return not (rules["CHECKCOMPOUNDDUP"] and final and a == b)

    def single(self, word: str, kind: str) -> bool:
        return next(self.readings(word, kind), None) is not None

    # Whole words

    def good(self, word: str, recase: bool = True, nosuggest: bool = True, single: bool = True, compound: bool = True) -> bool:
        """Whether word has any reading; recase: also in other capitalisations."""
        key = word, recase, nosuggest, single, compound
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[key] = next(self.all_readings(*key, brief=True), None) is not None
        return found

    def all_readings(self, word: str, recase: bool = True, nosuggest: bool = True, single: bool = True, compound: bool = True, brief: bool = False) -> Iterator[list[Reading]]:
        """Every reading of word as a list of parts, one part for a word that is no compound; brief: see compound_readings()."""
        casing, keep = self.rules.casing, self.rules["KEEPCASE"]
        kind, forms = casing.variants(word) if recase else (casing.kind(word), [word])
        sharp = self.rules["CHECKSHARPS"] and keep is not None and kind == ALL and "ß" in word
        for form in forms:
            if single:
                for x in self.readings(form, kind, nosuggest=nosuggest):
                    if not (sharp and "ß" in x.entry.stem and keep in x.flags):
                        yield [x]
            if compound and (self.compounds or self.rules.compound_rules):
                yield from self.compound_readings(form, kind, nosuggest, brief)

    def breakings(self, word: str, depth: int = 0) -> Iterator[list[str]]:
        """Parts of word at its break points, the whole word first; what is left of a break isn't broken again."""
        if depth > 10:
            return
        yield [word]
        for pattern in self.rules.breaks:
            for m in pattern.finditer(word):
                for rest in self.breakings(word[m.end(1) :], depth + 1):
                    yield [word[: m.start(1)], *rest]

    def check(self, word: str) -> bool:
        """Whether word is spelt right."""
        found = self.checked.get(word)
        if found is None:
            if len(self.checked) >= REMEMBERED:
                self.checked.clear()
            found = self.checked[word] = self._check(word)
        return found

    def _check(self, word: str) -> bool:
        rules = self.rules
        if rules["FORBIDDENWORD"] and self.lexicon.all_have(word, rules["FORBIDDENWORD"]):
            return False
        if rules.iconv:
            word = rules.iconv(word)
        if self.ignored:
            word = word.translate(self.ignored)
        return bool(_NUMBER.fullmatch(word)) or any(all(self.good(part) for part in parts if part) for parts in self.breakings(word))


def h_with(h: Reading):
    return lambda entry: Reading(h.text, h.stem, h.prefixes, h.suffixes, entry)


def _speller(rules: Rules, entries: list[Entry]) -> Speller:
    return Speller(Lexicon(rules, entries))


class _Parts:
    """Compounds of one word by the flags of their parts: which stretches can be parts is found once for each place."""

    def __init__(self, speller: Speller, word: str, kind: str, nosuggest: bool) -> None:
        self.speller, self.word, self.kind, self.nosuggest = speller, word, kind, nosuggest
        self.least, self.most = speller.rules["COMPOUNDMIN"], speller.rules["COMPOUNDWORDMAX"]
        self.found: dict[tuple[str, str], list[Reading]] = {}
        self.hopeless: set[tuple[int, int]] = set()

    def part(self, text: str, place: str) -> list[Reading]:
        if (text, place) not in self.found:
            s = self.speller
            pre = _NONE if place == BEGIN else s.permit
            suf = _NONE if place == END else s.permit
            self.found[text, place] = list(s.readings(text, self.kind, place, pre, suf, s.forbid, self.nosuggest))
        return self.found[text, place]

    def first_parts(self, at: int, place: str) -> Iterator[tuple[int, Reading]]:
        """(end, reading) of the parts that begin at a place and leave room for more."""
        word = self.word
        for end in range(at + self.least, len(word) - self.least + 1):
            text = word[at:end]
            for x in self.part(text, place):
                yield end, x
            if self.speller.rules["SIMPLIFIEDTRIPLE"] and text[-1] == word[end]:
                for x in self.part(text + text[-1], place):
                    yield end, Reading(text, x.stem, x.prefixes, x.suffixes, x.entry)

    def finishes(self, at: int, depth: int) -> bool:
        """Whether any parts at all make up the rest, neighbours aside."""
        state = at, depth if self.most else min(depth, 1)
        if state in self.hopeless:
            return False
        if depth and self.part(self.word[at:], END):
            return True
        if len(self.word) - at >= 2 * self.least and not (self.most and depth >= self.most):
            if any(self.finishes(end, depth + 1) for end, _ in self.first_parts(at, MIDDLE if depth else BEGIN)):
                return True
        self.hopeless.add(state)
        return False

    def follow(self, done: list[Reading], at: int) -> Iterator[list[Reading]]:
        meet, depth = self.speller.may_meet, len(done)
        if not self.finishes(at, depth):
            return
        if done:
            for x in self.part(self.word[at:], END):
                if meet(done[-1], x, self.kind, True) and self.speller.may_end(x, self.kind):
                    yield [*done, x]
        if len(self.word) - at < 2 * self.least or self.most and depth >= self.most:
            return
        for end, x in self.first_parts(at, MIDDLE if done else BEGIN):
            if not done or meet(done[-1], x, self.kind, False):
                yield from self.follow([*done, x], end)


class _Ruled:
    """Whether words are compounds by rules, letter by letter: an automaton whose states are made as words ask for them.

    A state is a set of (last part, where rules stand, letters since then, number of parts): every way to cut what has
    been read. It answers as Speller._ruled() does, which makes the parts too.
    """

    def __init__(self, speller: Speller, kind: str) -> None:
        self.speller, self.kind, rules = speller, kind, speller.rules
        self.rules, self.least, self.most = rules.compound_rules, max(1, rules["COMPOUNDMIN"]), rules["COMPOUNDWORDMAX"]
        used = {flag for rule in self.rules for flag, _ in rule.steps}
        self.stems: dict[str, list[frozenset[str]]] = {}
        for e in speller.lexicon.entries:
            if used & e.flags:
                self.stems.setdefault(e.stem, []).append(e.flags)
        self.begun = {stem[:n] for stem in self.stems for n in range(1, len(stem) + 1)}
        self.clear()

    def clear(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.final: list[bool | None] = []
        self.first = self._numbered(frozenset([(None, tuple(enumerate(rule.start for rule in self.rules)), "", 0)]))

    def _numbered(self, state: frozenset) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
            self.final.append(None)
        return self.number[state]

    def fits(self, word: str) -> bool:
        if len(self.states) >= REMEMBERED // 10:
            self.clear()
        at = self.first
        for c in word:
            to = self.next[at].get(c)
            if to is None:
                to = self.next[at][c] = self._numbered(self._after(self.states[at], c))
            at = to
        if self.final[at] is None:
            self.final[at] = any(self._ends(*x) for x in self.states[at])
        return self.final[at]

    def _meet(self, last: str, text: str, final: bool) -> bool:
        return self.speller.may_meet(Reading(last, last), Reading(text, text), self.kind, final)

    def _after(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for last, alive, begun, parts in state:
            text = begun + c
            if text not in self.begun:
                continue
            out.add((last, alive, text, parts))
            if len(text) >= self.least and not (self.most and parts >= self.most):
                for flags in self.stems.get(text, ()):
                    stepped = tuple((k, to) for k, places in alive if (to := self.rules[k].step(places, flags)))
                    if stepped and (last is None or self._meet(last, text, False)):
                        out.add((text, stepped, "", parts + 1 if self.most else 1))
        return frozenset(out)

    def _ends(self, last: str | None, alive: tuple, text: str, parts: int) -> bool:
        if last is None or len(text) < self.least:
            return False
        done = any(self.rules[k].done(self.rules[k].step(places, flags)) for flags in self.stems.get(text, ()) for k, places in alive)
        return done and self._meet(last, text, True) and self.speller.may_end(Reading(text, text), self.kind)


def replaced(word: str, table: list[tuple[re.Pattern, str]]) -> Iterator[str]:
    """word with one match of one pattern replaced; an underscore in a replacement is a space."""
    if len(word) > 1:
        for pattern, new in table:
            for m in pattern.finditer(word):
                yield word[: m.start()] + new.replace("_", " ") + word[m.end() :]
