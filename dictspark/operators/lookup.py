"""Whether words are right: hypotheses joined with entries, or the kernel for dictionaries that need all it knows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dictspark.functions import casing
from dictspark.functions.text import is_number
from dictspark.kernel.rules import Rules
from dictspark.operators.affix import hypotheses
from dictspark.operators.common import by_word
from dictspark.operators.probe import lower_keys
from dictspark.sources.dictionary import Dictionary


def _has(flags: Column, flag: str | None) -> Column:
    return F.lit(False) if flag is None else F.coalesce(F.array_contains(flags, flag), F.lit(False))


def allowed(rules: Rules, nosuggest: bool = True) -> Column:
    """The conditions on a reading, as one expression over prefix, suffix, outer, captype, flags, entry_kind and kind."""
    own = F.col("flags")
    nothing = F.array().cast("array<string>")
    every = F.array_union(own, F.array_union(F.coalesce("prefix.flags", nothing), F.coalesce("suffix.flags", nothing)))
    ok = F.lit(True)
    if not nosuggest:
        ok &= ~_has(own, rules["NOSUGGEST"])
    if rules["KEEPCASE"] is not None:
        sharp = F.contains("stem", F.lit("ß")) if rules["CHECKSHARPS"] else F.lit(False)
        ok &= ~_has(own, rules["KEEPCASE"]) | (F.col("kind") == F.col("captype")) | sharp
    need = rules["NEEDAFFIX"]
    if need is not None:
        inner = F.array(F.col("prefix.flags"), F.col("suffix.flags"))
        affixes = F.concat(F.filter(inner, lambda x: x.isNotNull()), "outer")
        ok &= F.when(F.size(affixes) == 0, ~_has(own, need)).otherwise(F.exists(affixes, lambda x: ~F.array_contains(x, need)))
    for side in ("prefix", "suffix"):
        ok &= F.col(side).isNull() | F.array_contains(every, F.col(f"{side}.flag"))
    if rules["CIRCUMFIX"] is not None:
        ok &= _has(F.col("prefix.flags"), rules["CIRCUMFIX"]) == _has(F.col("suffix.flags"), rules["CIRCUMFIX"])
    return ok & ~_has(every, rules["ONLYINCOMPOUND"])


def _tried(distinct: DataFrame, words: DataFrame, affixes: DataFrame, rules: Rules, recase: bool, nosuggest: bool) -> DataFrame:
    """Every hypothesis about distinct(word), those without an entry too, and whether it is a reading: ok."""
    w = F.col("word")
    forms = distinct.withColumns({"kind": casing.kind(w), "__forms": casing.variants(w) if recase else F.array(w)})
    forms = forms.select("word", "kind", F.posexplode_outer("__forms").alias("variant", "form"))
    found = hypotheses(forms, affixes, "form", rules["COMPLEXPREFIXES"])
    entries = words.select("stem", "flags", "captype", "line_no", F.lit(False).alias("folded"))
    if recase:
        # Words in capitals may also be entries written in mixed case: by lower-cased stem, one of each kind of entry.
        folded = lower_keys(words, "flags", "captype").groupBy(F.col("key").alias("stem"), "flags", "captype").agg(F.min("line_no").alias("line_no"))
        entries = entries.unionByName(folded.withColumn("folded", F.lit(True)))
    joined = found.join(entries, "stem", "left")
    capitals = (F.col("kind") == "ALL") & (casing.kind(F.col("form")) == "NO")
    ok = F.col("flags").isNotNull() & (~F.col("folded") | capitals) & allowed(rules, nosuggest)
    banned = rules["FORBIDDENWORD"]
    if banned is not None:
        stops = F.when(F.array_contains("flags", banned) & (F.size("ordinal") > 1) & ~F.col("folded"), F.col("ordinal"))
        joined = joined.withColumn("__cut", F.min(stops).over(Window.partitionBy("word", "variant")))
        ok &= F.col("__cut").isNull() | (F.col("ordinal") < F.col("__cut"))
    return joined.withColumn("ok", F.coalesce(ok, F.lit(False)))


def readings(df: DataFrame, words: DataFrame, affixes: DataFrame, rules: Rules, word: str = "word", recase: bool = True, nosuggest: bool = True) -> DataFrame:
    """(word, variant, ordinal, stem, prefix, suffix, line_no): readings of the distinct words of df that are no compounds.

    Joins with the tables of a dictionary, of any size. A forbidden stem under an affix hides all later readings
    of the same capitalisation. Null words have none.
    """
    distinct = df.select(F.col(word).alias("word")).where("word is not null").distinct()
    return _tried(distinct, words, affixes, rules, recase, nosuggest).where("ok").select("word", "variant", "form", "ordinal", "stem", "prefix", "suffix", "line_no")


def checked(df: DataFrame, words: DataFrame, affixes: DataFrame, rules: Rules, word: str = "word", recase: bool = True, nosuggest: bool = True) -> DataFrame:
    """(word, correct) for the distinct words of df: numbers and words with a reading, unless all their entries are forbidden.

    One shuffle makes the words distinct; all that follows keeps to its partitions where the dictionary's tables are
    broadcast. No compounds, breaks or conversions; see spelled() for those.
    """
    distinct = df.select(F.col(word).alias("word")).where("word is not null").distinct()
    tried = _tried(distinct, words, affixes, rules, recase, nosuggest)
    good = F.bool_or("ok")
    banned = rules["FORBIDDENWORD"]
    out = good | is_number(F.col("word"))
    if banned is not None:
        # The entries of the word itself are those of its first hypothesis.
        itself = (F.col("form") == F.col("word")) & (F.size("ordinal") == 1) & F.col("flags").isNotNull() & ~F.col("folded")
        out &= ~F.coalesce(F.bool_and(F.when(itself, F.array_contains("flags", banned))), F.lit(False))
    return tried.groupBy("word").agg(out.alias("correct"))


def spelled(df: DataFrame, dictionary: Dictionary, column: str = "word", into: str = "correct", costly: bool = False) -> DataFrame:
    """df with a boolean column: whether a word is right, by everything that the dictionary says.

    No shuffle: the dictionary, whose size is checked, goes to the executors, and each task remembers words. costly: for
    distinct words, or rules that take long, which are dealt out evenly first.
    """
    return by_word(df, column, dictionary, [(into, "boolean", pa.bool_())], lambda d, w: (d.lookup(w),), costly=costly)


def analysed(df: DataFrame, dictionary: Dictionary, column: str = "word") -> DataFrame:
    """df with a row for each reading of a word: reading (from 0), parts, stems and affixes (+ for suffixes, behind prefixes)."""

    def several(d: Dictionary, w: str) -> list[tuple]:
        out = []
        for k, parts in enumerate(d.speller.all_readings(w)):
            affixes = [f"{a.add}+" for x in parts for a in reversed(x.prefixes)] + [f"+{a.add}" for x in parts for a in x.suffixes]
            out.append((k, [x.text for x in parts], [x.stem for x in parts], affixes))
        return out

    texts = pa.list_(pa.string())
    added = [("reading", "int", pa.int32()), ("parts", "array<string>", texts), ("stems", "array<string>", texts), ("affixes", "array<string>", texts)]
    return by_word(df, column, dictionary, added, several, several=True, costly=True)
