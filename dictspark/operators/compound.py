"""Compounds of stems by flags: a frontier of places in words that grows by one part a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def compounds(df: DataFrame, words: DataFrame, flag: str | None = None, begin: str | None = None, middle: str | None = None, end: str | None = None, least: int = 3, most: int = 4, word: str = "word", double: bool = True, triple: bool = True) -> DataFrame:
    """(word, parts) for every way to put a word together of bare stems of at least least letters each, 2 to most of them.

    A part must have flag, or the flag of its place. double=False: the last two parts must differ; triple=False:
    no letter three times at a joint. Each round joins the prefixes of what is left of words with stems, so no more
    than the longest stem bounds the splits that are tried; states without a stem end at once.
    """
    marks = {place: [x for x in (flag, own) if x is not None] for place, own in (("begin", begin), ("middle", middle), ("end", end))}
    tables = {place: words.where(F.arrays_overlap("flags", F.array(*map(F.lit, own)))).select(F.col("stem").alias("part")).where(F.length("part") >= least).distinct() if own else None for place, own in marks.items()}
    state = df.select(F.col(word).alias("word")).where("word is not null").distinct().select("word", F.col("word").alias("rest"), F.array().cast("array<string>").alias("parts"))
    longest = words.agg(F.max(F.length("stem"))).first()[0] or 0
    found = None
    apart = F.lit(True)
    last, nxt = F.element_at("parts", -1), F.col("part")
    if not triple:
        letters = lambda x: F.size(F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))) == 1
        apart = ~(letters(F.concat(F.right(last, F.lit(2)), F.left(nxt, F.lit(1)))) | letters(F.concat(F.right(last, F.lit(1)), F.left(nxt, F.lit(2)))))
    for depth in range(most):
        if depth and tables["end"] is not None:
            ended = state.withColumn("part", F.col("rest")).join(tables["end"], "part").where(apart)
            if not double:
                ended = ended.where(last != nxt)
            ended = ended.select("word", F.array_append("parts", F.col("part")).alias("parts"))
            found = ended if found is None else found.unionByName(ended)
        table = tables["middle" if depth else "begin"]
        if depth == most - 1 or table is None:
            break
        sizes = F.expr(f"if(length(rest) >= {2 * least}, sequence({least}, least(length(rest) - {least}, {longest})), array())")
        cut = state.withColumn("__n", F.explode_outer(F.filter(sizes, lambda n: n >= least))).withColumn("part", F.left("rest", F.col("__n")))
        grown = cut.join(table, "part")
        grown = grown.where(apart) if depth else grown
        state = grown.select("word", F.expr("substring(rest, __n + 1)").alias("rest"), F.array_append("parts", F.col("part")).alias("parts"))
    empty = df.sparkSession.createDataFrame([], "word string, parts array<string>")
    return empty if found is None else found
