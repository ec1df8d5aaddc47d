"""The parts of a dictionary: affix rules, entries, and the tables and settings that steer checking and correcting."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from dictspark.kernel.casing import Casing

# The names of the settings of .aff files, and what they are where a dictionary is silent.
TEXTS = {"SET": "Windows-1252", "FLAG": "short", "LANG": None, "WORDCHARS": None, "KEY": "qwertyuiop|asdfghjkl|zxcvbnm", "TRY": "", "IGNORE": ""}
NUMBERS = {"MAXDIFF": -1, "MAXNGRAMSUGS": 4, "MAXCPDSUGS": 3, "COMPOUNDMIN": 3, "COMPOUNDWORDMAX": None}
FLAGS = ("NOSUGGEST KEEPCASE CIRCUMFIX NEEDAFFIX FORBIDDENWORD WARN COMPOUNDFLAG COMPOUNDBEGIN COMPOUNDMIDDLE COMPOUNDEND ONLYINCOMPOUND "
         "COMPOUNDPERMITFLAG COMPOUNDFORBIDFLAG FORCEUCASE SUBSTANDARD SYLLABLENUM COMPOUNDROOT").split()  # fmt: skip
SWITCHES = ("COMPLEXPREFIXES FULLSTRIP NOSPLITSUGS CHECKSHARPS CHECKCOMPOUNDCASE CHECKCOMPOUNDDUP CHECKCOMPOUNDREP CHECKCOMPOUNDTRIPLE "
            "SIMPLIFIEDTRIPLE ONLYMAXDIFF COMPOUNDMORESUFFIXES FORBIDWARN").split()  # fmt: skip
# Names of old for settings of today.
RENAMED = {"PSEUDOROOT": "NEEDAFFIX", "COMPOUNDLAST": "COMPOUNDEND"}


@dataclass(eq=False)
class Affix:
    """One rule: a stem that meets the condition loses strip and gains add, at its end (SFX) or its beginning (PFX)."""

    kind: str
    flag: str
    cross: bool
    strip: str
    add: str
    condition: str
    flags: frozenset[str]
    order: int = 0

    def __post_init__(self) -> None:
        escaped = self.condition.replace("-", "\\-")
        self.fits = re.compile(f"(?:{escaped})$").search if self.kind == "SFX" else re.compile(f"(?:{escaped})").match

    def __reduce__(self):
        return Affix, (self.kind, self.flag, self.cross, self.strip, self.add, self.condition, self.flags, self.order)

    def undo(self, word: str) -> str | None:
        """The stem of which this rule makes word, or None. word has the affix."""
        if self.kind == "SFX":
            stem = word[: len(word) - len(self.add)] + self.strip
        else:
            stem = self.strip + word[len(self.add) :]
        return stem if self.fits(stem) else None

    def apply(self, stem: str) -> str:
        """stem with the affix; the condition isn't looked at."""
        if self.kind == "SFX":
            return stem[: len(stem) - len(self.strip)] + self.add
        return self.add + stem[len(self.strip) :]


@dataclass(eq=False, slots=True)
class Entry:
    """One line of the word list. Each process that checks words holds all entries: equal flags and empty tags are shared."""

    line: int
    stem: str
    flags: frozenset[str]
    data: dict[str, list[str]] = field(default_factory=dict)
    spellings: Sequence[str] = ()
    kind: str = "NO"

    def __reduce__(self):
        return Entry, (self.line, self.stem, self.flags, self.data, self.spellings, self.kind)


class Conversion:
    """Replaces, from left to right, the longest pattern that begins at each place; nothing is replaced twice.

    An underscore at an end of a pattern binds it to that end of the word; in replacements it is a space.
    """

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.pairs = pairs
        rows = sorted(((p.replace("_", ""), p, r.replace("_", " ")) for p, r in pairs), key=lambda x: x[0])
        if any(not clean for clean, _, _ in rows):
            raise ValueError("a conversion pattern is empty")
        #: Longest first; equal lengths as sorted.
        self.rows = [(clean, re.compile("^" * p.startswith("_") + clean + "$" * p.endswith("_")), r) for clean, p, r in sorted(rows, key=lambda x: -len(x[0]))]

    def __reduce__(self):
        return Conversion, (self.pairs,)

    def __call__(self, word: str) -> str:
        out, at = [], 0
        while at < len(word):
            size, new = next(((len(clean), r) for clean, pattern, r in self.rows if pattern.match(word, at)), (1, word[at]))
            out.append(new)
            at += size
        return "".join(out)


class CompoundRule:
    """A sequence of flags, each with * or ? or alone, that the words of a compound must follow; run as an automaton."""

    def __init__(self, text: str) -> None:
        self.text = text
        found = re.findall(r"\(([^)]+)\)([*?]?)", text) if "(" in text else re.findall(r"([^*?])([*?]?)", text)
        self.steps = found
        #: Places are numbers of steps done; those that can be left out at once are skipped over.
        self.start = self._skip({0})

    def _skip(self, places: set[int]) -> frozenset[int]:
        out = set(places)
        for k, (_, mark) in enumerate(self.steps):
            if k in out and mark:
                out.add(k + 1)
        return frozenset(out)

    def step(self, places: frozenset[int], flags: frozenset[str]) -> frozenset[int]:
        """Where one may stand after one more word with these flags; nowhere: the rule is broken."""
        here = {k for k in places if k < len(self.steps) and self.steps[k][0] in flags}
        return self._skip({k if self.steps[k][1] == "*" else k + 1 for k in here} | {k + 1 for k in here if self.steps[k][1] == "*"})

    def done(self, places: frozenset[int]) -> bool:
        return len(self.steps) in places


@dataclass
class CompoundPattern:
    """Two neighbours that must not meet: how the left one ends and the right one begins, and flags of both."""

    left: str
    right: str
    replacement: str | None = None

    def __post_init__(self) -> None:
        self.sides = [(("" if stem == "0" else stem), stem == "0", flag) for stem, _, flag in (self.left.partition("/"), self.right.partition("/"))]

    def matches(self, left, right) -> bool:
        """left and right: Reading. A 0 asks for a word with affixes."""
        (ending, left_affixed, left_flag), (beginning, right_affixed, right_flag) = self.sides
        return (
            left.stem.endswith(ending)
            and right.stem.startswith(beginning)
            and (not left_affixed or left.affixed)
            and (not right_affixed or right.affixed)
            and (not left_flag or left_flag in left.flags)
            and (not right_flag or right_flag in right.flags)
        )


class Phonetics:
    """Rules from spelling to sound; the first of a letter's rules that fits at a place is used, else the letter is dropped."""

    _RULE = re.compile(r"(\w+)(?:\((\w+)\))?(-*)([\^$<]*)(\d?)")

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.pairs = pairs
        self.rules: dict[str, list[tuple]] = {}
        for search, sound in pairs:
            m = self._RULE.fullmatch(search)
            if not m:
                raise ValueError(f"not a phonetic rule: {search!r}")
            units = [*m[1], *([f"[{m[2]}]"] if m[2] else [])]
            seen = len(units) - len(m[3])
            pattern = "".join(units[:seen]) + (f"(?={''.join(units[seen:])})" if m[3] else "")
            self.rules.setdefault(search[0], []).append((re.compile(pattern), sound, "^" in m[4], "$" in m[4]))

    def __reduce__(self):
        return Phonetics, (self.pairs,)

    def __call__(self, word: str) -> str:
        word, out, at = word.upper(), [], 0
        while at < len(word):
            for pattern, sound, first, last in self.rules.get(word[at], ()):
                m = None if first and at else pattern.fullmatch(word, at) if last else pattern.match(word, at)
                if m:
                    out.append(sound)
                    at = m.end()
                    break
            else:
                at += 1
        return "".join(out)


def break_pattern(text: str) -> re.Pattern:
    """Only ^ and $ are special; without them a break has a character on both sides."""
    pattern = re.escape(text).replace("\\^", "^").replace("\\$", "$")
    return re.compile(f"({pattern})" if pattern[:1] == "^" or pattern[-1:] == "$" else f".({pattern}).")


class Rules:
    """All that an .aff file says. Settings are read as rules["KEEPCASE"]."""

    def __init__(self) -> None:
        self.settings: dict[str, object] = {**TEXTS, **NUMBERS, **dict.fromkeys(FLAGS), **dict.fromkeys(SWITCHES, False)}
        self.affixes: dict[str, dict[str, list[Affix]]] = {"PFX": {}, "SFX": {}}
        self.rep: list[tuple[re.Pattern, str]] = []
        self.map: list[list[str]] = []
        #: Changes by MAP in one word; None: any number.
        self.map_changes: int | None = None
        self.breaks: list[re.Pattern] = [break_pattern(x) for x in ("-", "^-", "-$")]
        self.iconv: Conversion | None = None
        self.oconv: Conversion | None = None
        self.compound_rules: list[CompoundRule] = []
        self.compound_patterns: list[CompoundPattern] = []
        self.phone: Phonetics | None = None
        self.flag_aliases: dict[str, frozenset[str]] = {}
        self.tag_aliases: dict[str, list[str]] = {}
        self.casing = Casing()

    def __getitem__(self, name: str):
        return self.settings[name]

    def all_affixes(self, kind: str) -> list[Affix]:
        return [x for rows in self.affixes[kind].values() for x in rows]
