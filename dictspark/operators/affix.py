"""Taking affixes off words: equi-joins of the ends of words with a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


RULE = "struct<flag:string,crossproduct:boolean,flags:array<string>>"


def _fits(kind: str, condition: Column, stem: Column) -> Column:
    """Whether stem meets a rule's condition; the commonest conditions need no regular expression."""
    escaped = F.replace(condition, F.lit("-"), F.lit("\\-"))
    pattern = F.concat(F.lit("(?:"), escaped, F.lit(")$")) if kind == "SFX" else F.concat(F.lit("^(?:"), escaped, F.lit(")"))
    return (condition == "") | ((condition == ".") & (stem != "")) | F.regexp_like(stem, pattern)


def _table(affixes: DataFrame, kind: str) -> DataFrame:
    rule = F.struct("flag", "crossproduct", "flags")
    return affixes.where(F.col("kind") == kind).select(F.col("add").alias("__end"), F.col("strip").alias("__strip"), F.col("condition").alias("__condition"), F.array(F.length("add"), F.col("ord").cast("int")).alias("__step"), rule.cast(RULE).alias("__rule"))


def _none_too(table: DataFrame) -> DataFrame:
    """table with a rule that leaves words as they are."""
    return table.unionByName(table.sparkSession.range(1).select(F.lit("").alias("__end"), F.lit("").alias("__strip"), F.lit("").alias("__condition"), F.array().cast("array<int>").alias("__step"), F.lit(None).cast(RULE).alias("__rule")))


def _layer(df: DataFrame, table: DataFrame, kind: str, base: str, longest: int) -> DataFrame:
    """df with __stem, __rule and __step, one row for each rule of the table that may have made base."""
    w = F.col(base)
    ends = F.sequence(F.lit(0), F.least(F.char_length(w), F.lit(longest))) if longest >= 0 else F.array().cast("array<int>")
    rows = df.withColumn("__n", F.explode_outer(ends))  # explode() would add a filter, computed again wherever it is pushed to
    own = F.right(w, F.col("__n")) if kind == "SFX" else F.left(w, F.col("__n"))
    left = F.char_length(w) - F.col("__n")
    rest = F.when(left == 0, "").otherwise(F.left(w, left) if kind == "SFX" else F.right(w, left))
    rows = rows.withColumns({"__end": F.when(F.col("__n") == 0, "").otherwise(own), "__rest": rest})
    stem = F.concat("__rest", "__strip") if kind == "SFX" else F.concat("__strip", "__rest")
    found = rows.join(table, "__end").withColumn("__stem", stem).where(_fits(kind, F.col("__condition"), F.col("__stem")))
    return found.select(*df.columns, "__stem", "__rule", "__step")


def longest_affixes(affixes: DataFrame) -> dict[str, int]:
    """Letters of the longest prefix and suffix, by a job over the rules."""
    return {r["kind"]: r["n"] for r in affixes.groupBy("kind").agg(F.max(F.length("add")).alias("n")).collect()}


def stripped(df: DataFrame, affixes: DataFrame, kind: str, word: str = "word") -> DataFrame:
    """df with stem, rule and step, one row for each rule of a kind that may have made the word.

    Every end of a word up to the longest affix is looked up; rules are then held against the restored stem. step is
    [length of the affix, place of the rule] and orders the rules of a word. Null words give no rows.
    """
    found = _layer(df.where(F.col(word).isNotNull()), _table(affixes, kind), kind, word, longest_affixes(affixes).get(kind, -1))
    return found.withColumnsRenamed({"__stem": "stem", "__rule": "rule", "__step": "step"})


def hypotheses(df: DataFrame, affixes: DataFrame, word: str = "word", complex_prefixes: bool = False) -> DataFrame:
    """df with every way to take affixes off a word: stem, prefix, suffix, outer, ordinal.

    prefix and suffix are the rules next to the stem, outer an array of the flags of those further out. ordinal orders
    the hypotheses of a word: the bare word, suffixes, prefixes, each followed by what it leads to.

    One chain of joins: a prefix or none, a suffix or none, an inner suffix or none. Rows aren't shuffled where the rules
    are broadcast, and the words are read once. Null words give no rows.
    """
    longest = longest_affixes(affixes)
    table = {kind: _none_too(_table(affixes, kind)) for kind in ("PFX", "SFX")}
    rule, before = F.col("__rule"), lambda slot: F.array_contains(F.col("__rule.flags"), F.col(f"{slot}.flag"))

    def layer(rows: DataFrame, kind: str) -> DataFrame:
        return _layer(rows, table[kind], kind, "stem", max(0, longest.get(kind, 0)))

    def taken(rows: DataFrame, **columns: Column) -> DataFrame:
        return rows.withColumns(columns).drop("stem", "__rule", "__step").withColumnRenamed("__stem", "stem")

    none = F.array().cast("array<array<string>>")
    rows = df.where(F.col(word).isNotNull()).withColumn("stem", F.col(word))
    rows = taken(layer(rows, "PFX"), prefix=rule, __p=F.col("__step"), __po=none)
    if complex_prefixes:
        # Two prefixes come after all that one prefix leads to.
        inner = layer(rows, "PFX").where(rule.isNull() | F.col("prefix").isNotNull() & before("prefix"))
        later = F.transform("__step", lambda x, i: F.when(i == 0, x + (1 << 20)).otherwise(x))
        outer = F.when(rule.isNotNull(), F.array(F.col("prefix.flags"))).otherwise(none)
        rows = taken(inner, __po=outer, __p=F.concat("__p", later), prefix=F.coalesce(rule, "prefix"))
    crossed = F.col("prefix").isNull() | F.col("__rule.crossproduct")
    first = layer(rows, "SFX").where(rule.isNull() | crossed & (F.col("prefix").isNull() | F.col("prefix.crossproduct")))
    rows = taken(first, suffix=rule, __s=F.col("__step"))
    second = layer(rows, "SFX").where(rule.isNull() | F.col("suffix").isNotNull() & before("suffix") & crossed)
    outer = F.when(rule.isNotNull(), F.array(F.col("suffix.flags"))).when(F.col("suffix").isNull(), F.col("__po")).otherwise(none)
    rows = taken(second, outer=outer, __s=F.concat("__s", "__step"), suffix=F.coalesce(rule, "suffix"))
    place = F.when(F.col("prefix").isNotNull(), 2).when(F.col("suffix").isNotNull(), 1).otherwise(0)
    kept = [c for c in df.columns if c != "stem"]
    return rows.select(*kept, "stem", "prefix", "suffix", "outer", F.concat(F.array(place), "__p", "__s").alias("ordinal"))
