"""Every form of every entry: entries joined with the rules of their flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictspark.kernel.rules import Rules
from dictspark.operators.affix import _fits
from dictspark.operators.lookup import _has


def expanded(words: DataFrame, affixes: DataFrame, rules: Rules) -> DataFrame:
    """(line_no, form), each once: what kernel.expand.forms() gives for each entry."""
    need = rules["NEEDAFFIX"]
    entries = words.where(~_has(F.col("flags"), rules["FORBIDDENWORD"])).select("line_no", "stem", "flags")
    table = {kind: affixes.where(F.col("kind") == kind).select(F.col("flag").alias("__flag"), F.col("strip").alias("__strip"), F.col("add").alias("__add"), F.col("condition").alias("__condition"), F.col("crossproduct").alias("__cross"), F.col("flags").alias("__flags"), F.col("ord").alias("__ord")) for kind in ("PFX", "SFX")}

    def with_affix(rows: DataFrame, kind: str, base: str, flags: str, held_to: str | None = None) -> DataFrame:
        """rows with the rules of their flags that fit base (or another column), as __form and the rule's columns."""
        found = rows.withColumn("__flag", F.explode(flags)).join(table[kind], "__flag").where(_fits(kind, F.col("__condition"), F.col(held_to or base)))
        return found.withColumn("__form", _applied(kind, F.col(base)))

    def onwards(rows: DataFrame, crossed: bool) -> DataFrame:
        """Second suffixes of (line_no, once, sflags)."""
        found = with_affix(rows, "SFX", "once", "sflags")
        return (found.where("__cross") if crossed else found).select("line_no", F.col("__form").alias("form"))

    bare = entries.where(~_has(F.col("flags"), need)).select("line_no", F.col("stem").alias("form"))
    suffixed = with_affix(entries, "SFX", "stem", "flags").select("line_no", "stem", F.col("__form").alias("once"), F.col("__flags").alias("sflags"), F.col("__ord").alias("sord"))
    prefixed = with_affix(entries, "PFX", "stem", "flags").select("line_no", "stem", "flags", F.col("__form").alias("base"), F.col("__flags").alias("pflags"), F.col("__cross").alias("cross"))
    crossing = prefixed.where("cross")
    by_stem = with_affix(crossing, "SFX", "base", "flags", "stem").select("line_no", F.col("__form").alias("once"), F.col("__flags").alias("sflags"))
    # Suffixes of the prefix's own flags are held to the prefixed form; those that the stem has too are in by_stem.
    by_prefix = with_affix(crossing, "SFX", "base", "pflags").where("__cross").select("line_no", F.col("__form").alias("once"), F.col("__flags").alias("sflags"))
    behind = by_stem.unionByName(by_prefix)
    out = (
        bare.unionByName(suffixed.where(~_has(F.col("sflags"), need)).select("line_no", F.col("once").alias("form")))
        .unionByName(onwards(suffixed.select("line_no", "once", "sflags"), False))
        .unionByName(prefixed.where(~_has(F.col("pflags"), need)).select("line_no", F.col("base").alias("form")))
        .unionByName(behind.select("line_no", F.col("once").alias("form")))
        .unionByName(onwards(behind, True))
    )
    return out.distinct()


def _applied(kind: str, base: Column) -> Column:
    if kind == "SFX":
        left = F.char_length(base) - F.char_length("__strip")
        return F.concat(F.when(left > 0, F.left(base, left)).otherwise(""), "__add")
    return F.concat("__add", F.substring(base, F.char_length("__strip") + 1, F.char_length(base)))
