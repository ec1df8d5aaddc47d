"""Readers of .aff (rules) and .dic (words) files. Both are small texts and are parsed where the plan is made."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

from dictspark.kernel import casing
from dictspark.kernel.rules import FLAGS, NUMBERS, RENAMED, SWITCHES, TEXTS, Affix, CompoundPattern, CompoundRule, Conversion, Entry, Phonetics, Rules, break_pattern

_SET = re.compile(rb"^\s*(?:SET\s+(\S+)|FLAG\s+(UTF-8)\b)", re.M)


def decoded(raw: bytes, encoding: str | None = None) -> tuple[str, str]:
    """(text, encoding) of a file: as asked for, else as its SET line says, else Windows-1252.

    UTF-8 flags mean UTF-8 text. A byte order mark goes. Bytes that the encoding doesn't know become lone surrogates.
    """
    if encoding is None:
        found = [(m[1] or m[2]).decode("ascii", "replace") for m in _SET.finditer(raw)]
        encoding = found[-1] if found else TEXTS["SET"]
    if raw.startswith(codecs.BOM_UTF8):
        raw = raw[len(codecs.BOM_UTF8) :]
    name = re.sub(r"(?i)^microsoft-", "", encoding)
    return raw.decode(name, "surrogateescape"), encoding


def numbered_lines(text: str) -> Iterator[tuple[int, str]]:
    """(number from 1, line without white space around it) of lines that have something else."""
    for number, line in enumerate(re.split(r"\r\n|\n|\r", text), 1):
        if line := line.strip():
            yield number, line


def split_flags(text: str | None, style: str, aliases: dict[str, frozenset[str]]) -> list[str]:
    if not text:
        return []
    if aliases and text.isdigit():
        return sorted(aliases[text])
    if style in ("short", "UTF-8"):
        return list(text)
    if style == "long":
        return re.findall("..", text)
    if style == "num":
        return re.findall(r"\d+(?=,|$)", text)
    raise ValueError(f"unknown kind of flags: {style}")


def _map_options(text: str) -> list[str]:
    return [x.strip("()") for x in re.findall(r"\([^()]+\)|[^()]", text)]


class _Reader:
    def __init__(self, raw: bytes) -> None:
        text, encoding = decoded(raw)
        self.rows = [line.split() for _, line in numbered_lines(text)]
        self.at = 0
        self.rules = Rules()
        self.rules.settings["SET"] = encoding

    def flags(self, text: str | None) -> list[str]:
        return split_flags(text, self.rules["FLAG"], self.rules.flag_aliases)

    def table(self, count: str) -> list[list[str]]:
        """What the next count lines say after their name."""
        n = int(count)
        found = [row[1:] for row in self.rows[self.at : self.at + n]]
        self.at += n
        return found

    def affix(self, kind: str, flag: str, cross: str, row: list[str], order: int) -> Affix:
        strip, add = row[1], row[2]
        add, _, flags = add.partition("/")
        add = self.without_ignored(add)
        return Affix(kind, flag, cross == "Y", "" if strip == "0" else strip, "" if add == "0" else add, row[3] if len(row) > 3 else "", frozenset(self.flags(flags)), order)

    def without_ignored(self, text: str) -> str:
        gone = self.rules["IGNORE"]
        return text.translate({ord(c): None for c in gone}) if gone else text

    def read(self) -> Rules:
        rules = self.rules
        while self.at < len(self.rows):
            name, *values = self.rows[self.at]
            self.at += 1
            name, first = RENAMED.get(name, name), values[0] if values else None
            if name in SWITCHES:
                rules.settings[name] = True
            elif first is None:
                continue
            elif name in TEXTS:
                rules.settings[name] = first
            elif name in NUMBERS:
                rules.settings[name] = int(first)
            elif name in FLAGS:
                rules.settings[name] = self.flags(first)[0]
            elif name in ("PFX", "SFX"):
                before = sum(map(len, rules.affixes[name].values()))
                rules.affixes[name][first] = [self.affix(name, first, values[1], row, before + k) for k, row in enumerate(self.table(values[2]))]
            elif name == "AF":
                rules.flag_aliases = {str(k): frozenset(split_flags(row[0], rules["FLAG"], {})) for k, row in enumerate(self.table(first), 1)}
            elif name == "AM":
                rules.tag_aliases = {str(k): row for k, row in enumerate(self.table(first), 1)}
            elif name == "REP":
                rules.rep = [(re.compile(row[0]), row[1]) for row in self.table(first)]
            elif name == "MAP":
                rules.map = [_map_options(row[0]) for row in self.table(first)]
            elif name == "BREAK":
                rules.breaks = [break_pattern(row[0]) for row in self.table(first)]
            elif name == "COMPOUNDRULE":
                rules.compound_rules = [CompoundRule(row[0]) for row in self.table(first)]
            elif name == "CHECKCOMPOUNDPATTERN":
                rules.compound_patterns = [CompoundPattern(row[0], row[1], row[2] if len(row) > 2 else None) for row in self.table(first)]
            elif name in ("ICONV", "OCONV"):
                setattr(rules, name.lower(), Conversion([(row[0], row[1]) for row in self.table(first)]))
            elif name == "PHONE":
                rules.phone = Phonetics([(row[0], "" if row[1] == "_" else row[1]) for row in self.table(first)])
        if rules["FLAG"] == "UTF-8":
            rules.settings["SET"] = "UTF-8"
        rules.casing = casing.casing_for(rules["LANG"], rules["CHECKSHARPS"])
        return rules


def parse_rules(raw: bytes) -> Rules:
    """The rules of an .aff file. Lines that are no known setting are passed over; an empty file is valid."""
    return _Reader(raw).read()


_TAG = re.compile(r"[ \t]\w\w:")
_COUNT = re.compile(r"\d+(\s|$)")
_SLASH = re.compile(r"(?<!\\)/")


def parse_tags(text: str, aliases: dict[str, list[str]]) -> dict[str, list[str]]:
    """xy:value tags as lists of values; numbers are aliases for several tags; anything else is dropped."""
    found: dict[str, list[str]] = {}
    rest = text.split()
    while rest:
        tag, colon, value = rest.pop(0).partition(":")
        if colon:
            if value:
                found.setdefault(tag, []).append(value)
        elif tag.isdigit() and aliases:
            rest += aliases[tag]
    return found


def parse_line(number: int, line: str, reader_rules: Rules, shared: dict | None = None) -> Entry:
    """One line of a .dic file: stem, flags after a slash (\\/ is part of the stem), tags after a tab or ` xy:`.

    shared: sets of flags of other lines, and no tags, of which one object each is enough.
    """
    shared = {} if shared is None else shared
    cuts = [m.start() for m in (_TAG.search(line), re.search("\t", line)) if m and m.start()]
    cut = min(cuts, default=len(line))
    stem, tags = line[:cut], parse_tags(line[cut:], reader_rules.tag_aliases)
    parts = [] if stem.startswith("/") else _SLASH.split(stem, maxsplit=2)
    stem, flags = parts if len(parts) == 2 else (stem, "")
    stem = stem.replace("\\/", "/")
    if reader_rules["IGNORE"]:
        stem = stem.translate({ord(c): None for c in reader_rules["IGNORE"]})
    own = frozenset(split_flags(flags, reader_rules["FLAG"], reader_rules.flag_aliases))
    return Entry(number, stem, shared.setdefault(own, own), tags or shared.setdefault("", tags), (), reader_rules.casing.kind(stem))


def parse_words(raw: bytes, rules: Rules) -> list[Entry]:
    """The entries of a .dic file. A count in the first line is passed over.

    ph: tags name misspellings: `x*` and `a->b` become replacements, others a replacement of the whole and another
    spelling of the stem; all are added to rules.rep.
    """
    text, _ = decoded(raw, rules["SET"])
    out, shared = [], {}
    for number, line in numbered_lines(text):
        if number == 1 and _COUNT.match(line):
            continue
        entry = parse_line(number, line, rules, shared)
        for wrong in entry.data.get("ph", ()):
            if wrong.endswith("*"):
                pair = wrong[:-2], entry.stem[:-1]
            elif "->" in wrong:
                pair = tuple(wrong.split("->", 1))
            else:
                pair = wrong, entry.stem
                entry.spellings = [*entry.spellings, wrong]
            rules.rep.append((re.compile(pair[0]), pair[1]))
        out.append(entry)
    return out
