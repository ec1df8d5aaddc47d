"""Word lists as tables, read by all executors: for .dic files too large for one process."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.functions import casing
from dictspark.kernel.rules import Rules
from dictspark.sources.affdic import decoded
from dictspark.sources.dictionary import clean

#: White space as it is stripped from lines.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_WORDS = "array<string>"


def _none() -> Column:
    return F.array().cast(_WORDS)


def _lookup(aliases: dict[str, list[str]], name: Column) -> Column:
    known = F.create_map(*(x for key, values in aliases.items() for x in (F.lit(clean(key)), F.array(*(F.lit(clean(v)) for v in values)).cast(_WORDS))))
    return F.element_at(known, name)


def _flags(text: Column, rules: Rules) -> Column:
    style = rules["FLAG"]
    pattern = {"short": r"(?s)(.)", "UTF-8": r"(?s)(.)", "long": r"(?s)(..)", "num": r"(\d+)(?=,|$)"}.get(style)
    if pattern is None:
        raise ValueError(f"unknown kind of flags: {style}")
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    if rules.flag_aliases:
        named = _lookup({k: sorted(v) for k, v in rules.flag_aliases.items()}, text)
        unknown = F.raise_error(F.concat(F.lit("no such alias of flags: "), text))
        found = F.when(text.rlike(r"^\d+$"), F.coalesce(named, unknown.cast(_WORDS))).otherwise(found)
    return F.array_sort(F.array_distinct(found))


def _tags(text: Column, rules: Rules) -> Column:
    """xy:value tags as a map of lists. Aliases stand for tags, not for other aliases."""
    tokens = F.filter(F.split(text, _SPACE + "+"), lambda x: x != "")
    if rules.tag_aliases:
        meant = F.transform(F.filter(tokens, lambda x: x.rlike(r"^\d+$")), lambda x: F.coalesce(_lookup(rules.tag_aliases, x), F.raise_error(F.concat(F.lit("no such alias of tags: "), x)).cast(_WORDS)))
        tokens = F.concat(tokens, F.flatten(meant))
    pairs = F.transform(F.filter(tokens, lambda x: x.rlike("(?s)^[^:]*:.")), lambda x: F.struct(F.substring_index(x, ":", 1).alias("tag"), F.regexp_replace(x, "(?s)^[^:]*:", "").alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["tag"]))
    return F.map_from_entries(F.transform(names, lambda tag: F.struct(tag, F.transform(F.filter(pairs, lambda p: p["tag"] == tag), lambda p: p["value"]))))


def parsed_lines(df: DataFrame, rules: Rules, line: str = "value", number: str = "line_no") -> DataFrame:
    """The table of words (as of Dictionary.words()) that lines of a .dic file, in a column of df, make.

    Built-in expressions in one projection: no shuffle, nothing at the driver. Null and blank lines have no row; equal
    lines have one each. Only number and line are taken from df; no count line is looked for.
    """
    stripped = df.select(F.col(number).cast("bigint").alias("line_no"), F.regexp_replace(F.col(line), rf"^{_SPACE}+|{_SPACE}+$", "").alias("line")).where("line <> ''")
    head = F.regexp_extract("line", r"(?sU)^(.+?)(?=[ \t]\w\w:|\t|\z)", 1)
    tail = F.substring(F.col("line"), F.char_length("head") + 1, F.char_length("line"))
    parts = F.split("head", r"(?<!\\)/", -1)
    cut = stripped.withColumn("head", head).select("line_no", "head", tail.alias("tail"), F.when(~F.startswith("head", F.lit("/")) & (F.size(parts) == 2), parts).otherwise(F.array("head", F.lit(""))).alias("parts"))
    stem = F.replace(F.col("parts")[0], F.lit("\\/"), F.lit("/"))
    if rules["IGNORE"]:
        stem = F.translate(stem, rules["IGNORE"], "")
    found = cut.select("line_no", stem.alias("stem"), _flags(F.col("parts")[1], rules).alias("flags"), _tags(F.col("tail"), rules).alias("data"))
    wrong = F.coalesce(F.col("data")["ph"], _none())
    kind = casing.kind_german if rules["CHECKSHARPS"] else casing.kind
    whole = F.filter(wrong, lambda x: ~F.endswith(x, F.lit("*")) & ~F.contains(x, F.lit("->")))
    return found.select("*", whole.alias("alt_spellings"), kind(F.col("stem")).alias("captype"))


def misspellings_of(words: DataFrame) -> DataFrame:
    """(line_no, pattern, replacement): what the ph: tags of a table of words add to the replacements, in the order of lines and tags."""
    tagged = words.select("line_no", "stem", F.posexplode(F.col("data")["ph"]).alias("place", "wrong"))
    wrong, stem = F.col("wrong"), F.col("stem")
    begins = F.endswith(wrong, F.lit("*"))
    shorter = lambda x, n: F.left(x, F.greatest(F.char_length(x) - n, F.lit(0)))
    arrow = F.contains(wrong, F.lit("->"))
    pattern = F.when(begins, shorter(wrong, 2)).when(arrow, F.substring_index(wrong, "->", 1)).otherwise(wrong)
    new = F.when(begins, shorter(stem, 1)).when(arrow, F.regexp_replace(wrong, "(?s)^.*?->", "")).otherwise(stem)
    return tagged.select("line_no", "place", pattern.alias("pattern"), new.alias("replacement"))


def read_words(spark: SparkSession, path: str, rules: Rules) -> DataFrame:
    """The table of words of one .dic file in any store, split among tasks; a count in its first line is passed over.

    line_no grows with the lines of a task and is unique, but is no running number, which would need one task for all.
    Texts that aren't UTF-8 are decoded in Python, a batch at a time. misspellings_of() gives what ph: tags add.
    """
    encoding = rules["SET"]
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")
    if encoding.upper() not in ("UTF-8", "UTF8"):

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers, raw = batch.columns
                found = [clean(decoded(x, encoding)[0]) for x in raw.to_pylist()]
                yield pa.RecordBatch.from_arrays([numbers, pa.array(found, pa.string())], names=["line_no", "value"])

        lines = lines.select("line_no", F.col("value").cast("binary")).mapInArrow(texts, "line_no bigint, value string")
    first = F.col("line_no") == 0  # a file's first split is among its largest, and those are dealt out in order
    lines = lines.withColumn("value", F.when(first, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
    return parsed_lines(lines.where(~(first & F.col("value").rlike(rf"^{_SPACE}*\d+({_SPACE}|$)"))), rules)
