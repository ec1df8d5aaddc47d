"""Line deduplication by winnowing: runs of lines that occur earlier in the corpus are deleted.

Blank lines don't count. Every window of two lines elects the one of least hash, so that two equal runs of two lines or
more elect the same fingerprints at the same places; a line of LONE_WORDS words or more is a window of its own.
Fingerprints that occur once are dropped. The positions of the others are joined: each is extended to the line before or
behind it, wherever such a window elected it, and matched with the first place at which the lines so joined stand. All
windows that overlap in a longer run are matched so, and what they cover is the run.

Lines are compared by digests of 128 bits. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.llm.common import discard, materialize, table

#: Words from which a single line is a run.
LONE_WORDS = 10
_FIRST = -(1 << 63)


def clean(line: Column) -> Column:
    """A line as it is compared: without white space at its ends."""
    return F.trim(F.translate(line, "\t\r", "  "))


def solid_lines(text: Column) -> Column:
    """Array of (at, a, b, lone) of the lines that aren't blank: number, two halves of a digest, whether it is long."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("at"), clean(x).alias("x")))
    long = lambda x: F.char_length(x) - F.char_length(F.translate(x, " ", "")) >= LONE_WORDS - 1
    return F.transform(F.filter(lines, lambda s: s["x"] != ""), lambda s: F.struct(s["at"].alias("at"), F.xxhash64(s["x"]).alias("a"), F.xxhash64(F.lit(7), s["x"]).alias("b"), long(s["x"]).alias("lone")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(print, doc_id, version, spans) for each elected line of docs(doc_id, version, lines).

    spans are the windows that elected it: first and last, the numbers of their lines, and g and h, a digest of both.
    """

    def span(first: Column, last: Column) -> Column:
        values = [first["a"], first["b"], last["a"], last["b"]]
        return F.struct(first["at"].alias("first"), last["at"].alias("last"), F.xxhash64(*values).alias("g"), F.xxhash64(F.lit(7), *values).alias("h"))

    def at(x: Column, i: Column) -> Column:
        before, after = F.get("lines", i - 1), F.get("lines", i + 1)
        # A line alone and two equal lines have digests of their own, as the former has no second half.
        alone = F.struct(x["at"].alias("first"), x["at"].alias("last"), x["a"].alias("g"), x["b"].alias("h"))
        spans = F.array(F.when(x["a"] < before["a"], span(before, x)), F.when(x["a"] <= after["a"], span(x, after)), F.when(x["lone"], alone))
        return F.struct(x["a"].alias("print"), F.filter(spans, lambda s: s.isNotNull()).alias("spans"))

    elected = F.filter(F.transform("lines", at), lambda s: F.size(s["spans"]) > 0)
    return docs.select("doc_id", "version", F.explode(elected).alias("e")).select("e.print", "doc_id", "version", "e.spans")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, lines): the numbers of the lines to delete, of documents that have such lines.

    version tells apart rows with the same doc_id; order is that of doc_id, version and line.
    """
    hashed = docs.select("doc_id", "version", solid_lines(F.col("text")).alias("lines"))
    prints = materialize(fingerprints(hashed), "prints")
    # Both tables that positions are joined with are stored, so that each join has nothing else in its stage and the rows of
    # a hot fingerprint or window can be split over tasks.
    often = materialize(prints.select("print", F.struct("doc_id", "version", F.element_at("spans", 1)["first"].alias("at")).alias("w")).groupBy("print").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).where("lo < hi").select("print"), "often")
    some = prints.join(often, "print").select("doc_id", "version", F.inline("spans"))
    where = F.struct("doc_id", "version", "first")
    begun = materialize(some.groupBy("g", "h").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).where("lo < hi").select("g", "h", "lo"), "first")
    later = some.join(begun, ["g", "h"]).where(where > F.col("lo"))
    covered = F.flatten(F.collect_set(F.array("first", "last")))
    gone = materialize(later.groupBy("doc_id", "version").agg(F.array_sort(F.array_distinct(covered)).alias("lines")), "gone")
    discard(prints, often, begun)
    return gone


def deduplicated(docs: DataFrame, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs, all columns, with text without repeated runs; counts: names of columns to add, its lines and those deleted.

    A run of two lines or more, or a line of LONE_WORDS words, is deleted where it stands earlier too, in a smaller doc_id
    or higher up in the same text; blank lines between its lines stay and don't count. Lines compare without white space
    at their ends. Null texts have one empty line and stay null. Rows with a null doc_id come before all others. Equal
    rows, same doc_id and text, count as one row and are treated alike. An empty table gives no rows. No column of docs is
    touched but text; a name of counts that it has already is refused.
    """
    if counts and {c.lower() for c in counts} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {counts[0]} or {counts[1]} already")
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST))
    keyed = docs.select(number.alias("id"), version.alias("version"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    gone = repeated_lines(keyed.select(F.col("id").alias("doc_id"), "version", F.col("row.text").alias("text")))
    gone = gone.select(F.col("doc_id").alias("id"), "version", F.col("lines").alias("gone"))
    joined = keyed.join(gone.hint("shuffle_hash"), ["id", "version"], "left")
    lines = F.split("row.text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    added = [F.coalesce(F.size(lines), F.lit(1)).alias(counts[0]), F.coalesce(F.size("gone"), F.lit(0)).alias(counts[1])] if counts else []
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns), *added)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted and the MD5 of what is left of every text of documents (null: empty).

    Blank texts have nothing to delete; a repeated row is treated like the first of its kind; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = deduplicated(docs, ("n_lines", "n_deleted"))
    return out.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_deleted").cast("bigint").alias("n_deleted"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), solid AS (
  SELECT doc_id, pos, trim(translate(line, chr(9) || chr(13), '  '), ' ') AS x FROM lines
), pairs AS (
  SELECT doc_id, pos, md5(x) AS one, length(x) - length(replace(x, ' ', '')) >= {LONE_WORDS - 1} AS lone, lead(md5(x)) OVER w AS two, lead(pos) OVER w AS next
  FROM solid WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos, next FROM (SELECT doc_id, pos, next, row_number() OVER (PARTITION BY one, two ORDER BY doc_id, pos) AS n FROM pairs WHERE two IS NOT NULL) WHERE n > 1
), again AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY one ORDER BY doc_id, pos) AS n FROM pairs WHERE lone) WHERE n > 1
), gone AS (
  SELECT doc_id, pos FROM later UNION SELECT doc_id, next FROM later UNION SELECT doc_id, pos FROM again
)
SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_deleted, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone.pos IS NULL), '')) AS text_md5
FROM lines LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
"""
