"""A dictionary: rules and entries, as Python objects for the kernel and as tables for joins."""

from __future__ import annotations

import functools
import glob
import io
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dictspark.kernel.correct import Corrector
from dictspark.kernel.readings import Lexicon, Speller
from dictspark.kernel.rules import Affix, Entry, Rules
from dictspark.sources.affdic import parse_rules, parse_words

# Folders in which systems keep dictionaries.
SYSTEM_FOLDERS = [
    "/usr/share/hunspell", "/usr/share/myspell", "/usr/share/myspell/dicts", "/Library/Spelling",
    "/opt/openoffice.org/basis3.0/share/dict/ooo", "/usr/lib/openoffice.org/basis3.0/share/dict/ooo",
    "/opt/openoffice.org2.4/share/dict/ooo", "/usr/lib/openoffice.org2.4/share/dict/ooo",
    "/opt/openoffice.org2.3/share/dict/ooo", "/usr/lib/openoffice.org2.3/share/dict/ooo",
    "/opt/openoffice.org2.2/share/dict/ooo", "/usr/lib/openoffice.org2.2/share/dict/ooo",
    "/opt/openoffice.org2.1/share/dict/ooo", "/usr/lib/openoffice.org2.1/share/dict/ooo",
    "/opt/openoffice.org2.0/share/dict/ooo", "/usr/lib/openoffice.org2.0/share/dict/ooo",
]

_TEXTS = pa.list_(pa.string())
WORDS = pa.schema([("line_no", pa.int64()), ("stem", pa.string()), ("flags", _TEXTS), ("data", pa.map_(pa.string(), _TEXTS)), ("alt_spellings", _TEXTS), ("captype", pa.string())])
AFFIXES = pa.schema([("kind", pa.string()), ("ord", pa.int32()), ("flag", pa.string()), ("crossproduct", pa.bool_()), ("strip", pa.string()), ("add", pa.string()), ("condition", pa.string()), ("flags", _TEXTS)])
REP = pa.schema([("ord", pa.int32()), ("pattern", pa.string()), ("replacement", pa.string())])


def _read(path: str, spark: SparkSession | None) -> bytes:
    """A whole file; by Spark's reader where there is a session, so that any store will do."""
    if spark is None:
        with open(path, "rb") as f:
            return f.read()
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if not rows:
        raise FileNotFoundError(path)
    return bytes(rows[0]["content"])


class Dictionary:
    """`lookup` and `suggest` answer for one word here; the operators in dictspark.operators for columns of words."""

    def __init__(self, rules: Rules, entries: list[Entry]) -> None:
        self.rules, self.entries = rules, entries

    @classmethod
    def from_bytes(cls, aff: bytes, dic: bytes) -> Dictionary:
        rules = parse_rules(aff)
        return cls(rules, parse_words(dic, rules))

    @classmethod
    def from_files(cls, path: str, spark: SparkSession | None = None) -> Dictionary:
        """path.aff and path.dic."""
        return cls.from_bytes(_read(f"{path}.aff", spark), _read(f"{path}.dic", spark))

    @classmethod
    def from_zip(cls, path: str, spark: SparkSession | None = None) -> Dictionary:
        """The first .aff and the first .dic in a zip file (.xpi and .odt files are that too)."""
        with zipfile.ZipFile(io.BytesIO(_read(path, spark))) as z:
            names = [next((n for n in z.namelist() if n.endswith(end)), None) for end in (".aff", ".dic")]
            if None in names:
                raise LookupError(f"no dictionary in {path}")
            return cls.from_bytes(*(z.read(n) for n in names))

    @classmethod
    def from_system(cls, name: str, folders: list[str] | None = None) -> Dictionary:
        """The first dictionary of that name in the folders of the system; LookupError if there is none."""
        for folder in SYSTEM_FOLDERS if folders is None else folders:
            for found in sorted(glob.glob(os.path.join(folder, f"{glob.escape(name)}.aff"))):
                if os.path.exists(found[:-4] + ".dic"):
                    return cls.from_files(found[:-4])
        raise LookupError(f"{name} not found (looked in {', '.join(SYSTEM_FOLDERS if folders is None else folders)})")

    def __reduce__(self):
        return Dictionary, (self.rules, self.entries)

    @functools.cached_property
    def lexicon(self) -> Lexicon:
        return Lexicon(self.rules, self.entries)

    @functools.cached_property
    def speller(self) -> Speller:
        return Speller(self.lexicon)

    @functools.cached_property
    def corrector(self) -> Corrector:
        return Corrector(self.speller)

    def lookup(self, word: str) -> bool:
        return self.speller.check(word)

    def suggest(self, word: str) -> Iterator[str]:
        return (text for _, text in self.corrector.suggestions(word))

    # Tables, as local relations: Spark knows their size

    def words(self, spark: SparkSession) -> DataFrame:
        rows = [(e.line, clean(e.stem), sorted(map(clean, e.flags)), [(clean(k), [clean(x) for x in v]) for k, v in e.data.items()], [clean(x) for x in e.spellings], e.kind) for e in self.entries]
        return spark.createDataFrame(_arrow(rows, WORDS))

    def affixes(self, spark: SparkSession) -> DataFrame:
        rules: list[Affix] = [x for kind in ("PFX", "SFX") for x in self.rules.all_affixes(kind)]
        return spark.createDataFrame(_arrow([(x.kind, x.order, clean(x.flag), x.cross, clean(x.strip), clean(x.add), clean(x.condition), sorted(map(clean, x.flags))) for x in rules], AFFIXES))

    def rep(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(_arrow([(k, clean(p.pattern), clean(r)) for k, (p, r) in enumerate(self.rules.rep)], REP))

    def settings(self, spark: SparkSession) -> DataFrame:
        """One row: every scalar setting as text, null where unset."""
        row = {k: None if v is None else str(v).lower() if isinstance(v, bool) else clean(str(v)) for k, v in self.rules.settings.items()}
        return spark.createDataFrame(_arrow([tuple(row.values())], pa.schema([(k, pa.string()) for k in row])))


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(schema)], schema=schema)


def clean(text: str) -> str:
    """text without lone surrogates, which no table can hold."""
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
