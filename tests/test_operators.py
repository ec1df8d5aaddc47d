"""Spark operators against the kernel; registered queries against DuckDB."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from dictspark import queries
from dictspark.functions import casing, edits, metrics
from dictspark.kernel import candidates, similar
from dictspark.kernel.casing import Casing, GermanCasing, TurkicCasing
from dictspark.kernel.expand import forms
from dictspark.operators import compound, convert, correct, expand, lookup, probe
from dictspark.operators.similar import alike, nearest_roots
from dictspark.sources.dictionary import Dictionary
from dictspark.streaming import misspellings

SF = "/root/testdata/sf0.001"
WORDS = ["a", "ab", "abc", "Oslo", "OSLO", "oSlo", "OsLo", "abab", "ababa", "banana", "straße", "STRASSE", "ǅ", "12", "A1", "", "Élan", "bookkeeper", "MESSSINGSS", "foo-bar", "Missisippi"]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "w string")


def test_casing_like_kernel(words):
    w, k, g, t = F.col("w"), Casing(), GermanCasing(), TurkicCasing()
    rows = words.select("w", casing.kind(w), casing.variants(w), casing.corrections(w), casing.kind_german(w), casing.german_lower(w), casing.turkic_lower(w), casing.turkic_upper(w), casing.coerce(w, F.lit("INIT"))).collect()
    for r in rows:
        x = r["w"]
        assert tuple(r)[1:] == (k.kind(x), k.variants(x)[1], k.corrections(x)[1], g.kind(x), g.lower(x), t.lower(x), t.upper(x), k.coerce(x, "INIT")), x


def test_edits_like_kernel(words):
    w, letters, keys = F.col("w"), "esa", "qwertyuiop|asdfghjkl|zxcvbnm"
    both = {
        "swap": (edits.swap_neighbours(w), candidates.swap_neighbours), "far": (edits.swap_distant(w), candidates.swap_distant), "keys": (edits.neighbour_keys(w, keys), lambda x: candidates.neighbour_keys(x, keys)),
        "drop": (edits.dropped(w), candidates.dropped), "insert": (edits.inserted(w, letters), lambda x: candidates.inserted(x, letters)), "move": (edits.moved(w), candidates.moved),
        "exchange": (edits.exchanged(w, letters), lambda x: candidates.exchanged(x, letters)), "double": (edits.undoubled(w), candidates.undoubled),
    }
    for r in words.select("w", *(c.alias(n) for n, (c, _) in both.items())).collect():
        for n, (_, f) in both.items():
            assert r[n] == list(f(r["w"])), (n, r["w"])


def test_words_are_cut_once_for_all_letters(words):
    """exchanged() cuts a word before it goes through the letters, not for each of them."""
    plan = words.select(edits.exchanged(F.col("w"), "esa"))._jdf.queryExecution().analyzed().toString()
    assert plan.index("reverse(") < plan.index("array(e, s, a)")


def test_metrics_like_kernel(words):
    a, b = F.col("a"), F.col("b")
    pairs = words.select(F.col("w").alias("a")).crossJoin(words.select(F.col("w").alias("b")))  # 21 words
    for r in pairs.select("a", "b", metrics.same_places(a, b), metrics.prefix_length(a, b), metrics.subsequence_length(a, b), metrics.root_score(a, b), metrics.rough_score(a, b), metrics.threshold(a), metrics.precise_score(a, b, F.lit(5))).collect():
        x, y = r[0], r[1]
        assert tuple(r)[2:] == (similar.same_places(x, y), similar.prefix_length(x, y), similar.subsequence_length(x, y), similar.root_score(x, y), similar.rough_score(x, y), similar.threshold(x), similar.precise_score(x, y, 1.0, 5, False)), (x, y)


AFF = queries.AFF + "COMPLEXPREFIXES\n" + "".join(f"{role} {flag}\n" for role, flag in queries.ROLES.items())
DIC = ["tidy/SUR", "hope/LSD", "plan/SGR", "sag/PT", "kg/K", "Oslo/S", "OpenWay/S", "bad/XS", "plans/X", "rude/QY", "run/NS", "low/O", "rest/YL"]


@pytest.fixture(scope="module")
def own():
    return Dictionary.from_bytes(("SET UTF-8\n" + AFF).encode(), "\n".join(DIC).encode())


@pytest.fixture(scope="module")
def asked(spark, own):
    found = {x for e in own.entries for x in forms(e, own.rules)} | {"hopelessly", "besagen", "besag", "kg", "run", "runs", "low", "7", "1.5", "", "bads", "plans"}
    found |= {x.upper() for x in found} | {x.capitalize() for x in found} | {x + "x" for x in found} | {"un" + x for x in found}
    return spark.createDataFrame([(x,) for x in sorted(found)] + [(None,), ("plan",)], "word string")


def test_checked_like_kernel(spark, own, asked):
    got = {r["word"]: r["correct"] for r in lookup.checked(asked, own.words(spark), own.affixes(spark), own.rules).collect()}
    assert None not in got and len(got) == asked.where("word is not null").distinct().count()
    assert {w for w, ok in got.items() if w and ok != own.lookup(w)} == set()


def test_spelled_keeps_rows(spark, own, asked):
    rows = lookup.spelled(asked, own).collect()
    assert len(rows) == asked.count() and {r["correct"] for r in rows if r["word"] is None} == {None}
    assert all(r["correct"] == own.lookup(r["word"]) for r in rows if r["word"] is not None)
    assert lookup.spelled(asked.limit(0), own).count() == 0


def test_analysed_and_suggestions(spark, own):
    df = spark.createDataFrame([("retidies", 1), ("tidyy", 2), (None, 3)], "word string, n int")
    assert [(r["n"], r["stems"], r["affixes"]) for r in lookup.analysed(df, own).collect()] == [(1, ["tidy"], ["re+", "+ies"])]
    got = [r["suggestion"] for r in correct.suggestions(df.where("n = 2"), own).orderBy("ordinal").collect()]
    assert got == list(own.suggest("tidyy"))


def test_slips_are_the_kernels(spark, own):
    asked = ["tdiy", "plna", "hoped", "hoppe", "rudely"]
    got = {}
    for r in correct.slips(spark.createDataFrame([(x,) for x in asked], "word string"), own.words(spark), own.affixes(spark), own.rules).orderBy("word", "ordinal").collect():
        got.setdefault(r["word"], []).append(r["text"])
    for w in asked:
        right = [x for kind, x in candidates.candidates(w, own.rules) if isinstance(x, str) and kind != "twowords" and own.speller.good(x, recase=False, nosuggest=False, compound=False)]
        assert got.get(w, []) == list(dict.fromkeys(right))[:16], w


def test_expanded_like_kernel(spark, own):
    got = {tuple(r) for r in expand.expanded(own.words(spark), own.affixes(spark), own.rules).collect()}
    assert got == {(e.line, x) for e in own.entries for x in forms(e, own.rules)}


def test_nearest_roots(spark, own):
    got = nearest_roots(spark.createDataFrame([("hopes",)], "word string"), own, k=3).orderBy("rank").collect()
    want = sorted(((similar.root_score("hopes", e.stem), e.stem) for e in own.corrector.words if abs(len(e.stem) - 5) <= 4), reverse=True)[:3]
    assert [(r["score"], r["stem"]) for r in got] == want


def test_alike(spark, own):
    df = spark.createDataFrame([("tidyy",), (None,), ("",), ("plam",)], "word string")
    rows = alike(df, own).orderBy("word", "ordinal").collect()
    assert {w: [r["suggestion"] for r in rows if r["word"] == w] for w in ("tidyy", "", "plam", None)} == {w: list(own.corrector.similar.by_letters(w, set())) for w in ("tidyy", "", "plam")} | {None: []}
    assert rows and alike(df, own, sounds=True).count() == alike(df.limit(0), own).count() == 0


def test_probes_compounds_conversions(spark, own):
    df = spark.createDataFrame([("plans",), ("nobody",), ("oslo",)], "word string")
    assert {r["word"]: r["has_flag"] for r in probe.has_flag(df, own.words(spark), "X").collect()} == {"plans": True, "nobody": False, "oslo": False}
    assert [r["stem"] for r in probe.homonyms(df, own.words(spark), ignore_case=True).collect()] == ["Oslo"]
    c = Dictionary.from_bytes(b"COMPOUNDFLAG C\n", b"foo/C\nbar/C\nfoobar/C\nno\n")
    df = spark.createDataFrame([("foobarfoo",), ("nofoo",), ("foo",), (None,)], "word string")
    got = sorted(tuple(r["parts"]) for r in compound.compounds(df, c.words(spark), flag="C").collect())
    assert got == [("foo", "bar", "foo"), ("foobar", "foo")]
    assert sorted(r["correct"] for r in lookup.spelled(df.where("word is not null"), c).collect()) == [False, True, True]
    rows = convert.breakings(spark.createDataFrame([("a-b-c",)], "word string"), c).orderBy("breaking").collect()
    assert [r["parts"] for r in rows] == list(c.speller.breakings("a-b-c"))


def test_stream(spark, own, tmp_path):
    spark.createDataFrame([(1, "plan plnas Oslo"), (2, None)], "id int, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, text string").parquet(f"{tmp_path}/in")
    done = misspellings(stream, own).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    done.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, "plnas")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents benchmark labels orders part pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _same_as_sql(spark, folder, name, texts, items=()):
    """Rows of a query over documents in English with these texts, held against its SQL."""
    spark.createDataFrame([(k, x, "en") for k, x in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, x) for k, x in enumerate(items)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(folder)).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    a, b = (sorted(map(tuple, x[cols].astype(str).values.tolist())) for x in (got, want))
    assert a == b
    return a


def test_initial_letters_without_a_short_capital(spark, tmp_path):
    """The capital of an initial is one letter: that of a sharp s is no SS."""
    assert ("1", "ẞ") in _same_as_sql(spark, tmp_path, "homonyms_ignorecase", ["maß ß ŉa ǰ ᾳ ﬁn " * 5])


def test_slips_map_letters_with_accents(spark, tmp_path):
    """The rules of slips() are read in the encoding in which they are written."""
    got = _same_as_sql(spark, tmp_path, "suggest_edits_firstwins", ["queque rerere queéque " * 5], ["queêque rereré"])
    assert ("mapchars", "0", "queéque", "queêque") in got and ("mapchars", "0", "rerere", "rereré") in got


def test_ordered_suggestions_change_one_letter_by_map(spark, tmp_path):
    """As its SQL has it; without a bound, both accents of a word may change."""
    got = _same_as_sql(spark, tmp_path, "suggest_ordered", ["reèré réére reèrè " * 5], ["réère"])
    assert ("mapchars", "0", "réére", "réère") in got and not any(x[0] == "mapchars" and x[2] in ("reèré", "reèrè") for x in got)
    assert set(candidates.mapped("éé", [["e", "é"]])) == {"eé", "ee"} > set(candidates.mapped("éé", [["e", "é"]], 1)) == {"eé"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    spark.catalog.clearCache()
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name]).df()
        cols = sorted(got.columns)
        assert sorted(want.columns) == cols
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
        assert a.equals(b)
    else:
        assert len(got)


def test_queries_without_sql(spark):
    """What SQL is too slow or unable to say, by the kernel alone."""
    d = queries.dictionary(spark, SF, *queries.ROLES)
    got = queries.QUERIES["suggest_full"](spark, SF).toPandas()
    for w in sorted(set(got["word"]))[:40]:
        rows = got[got["word"] == w].sort_values("ordinal")
        assert list(zip(rows["kind"], rows["suggestion"])) == list(d.corrector.suggestions(w))
    precise = queries.QUERIES["ngram_precise"](spark, SF).toPandas()
    assert all(r.score == similar.precise_score(r.word, r.stem, 1.0, r.rough, False) for r in precise.itertuples())
    limits = queries.QUERIES["ngram_threshold"](spark, SF).toPandas()
    assert all(r.threshold == similar.threshold(r.word) for r in limits.itertuples())
    full = queries.QUERIES["lookup_full"](spark, SF).toPandas()
    assert all(r.correct == d.lookup(r.word) for r in full.itertuples())


def test_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_costly_words_are_dealt_out(spark, own):
    """A few words in one partition reach many tasks, and null words have no row of suggestions."""
    df = spark.createDataFrame([(f"plan{k}",) for k in range(200)] + [(None,)], "word string").coalesce(1)
    made = correct.suggestions(df, own).withColumn("task", F.spark_partition_id())
    assert made.select("task").distinct().count() > 4 and made.where("word is null").count() == 0


def test_tokens_are_read_once(spark):
    """Words and dictionary of a query come from one exchange."""
    for name in ("lookup_base", "lookup_affix"):
        df = queries.QUERIES[name](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("ReusedExchange") or plan.count("Generate") == 1, plan


def test_texts_are_read_once(spark):
    """What is asked of words or stems stays above the one exchange of counts; nothing is worked out for each token."""
    for name in ("lookup_affix", "lookup_forbidden", "error_rate_by_lang", "top_misspelled", "compound_flags", "has_flag_any"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        found = [re.sub(r"#\d+L?", "", plan[k - 1].strip(" :+-")) for k, line in enumerate(plan) if "regexp_extract_all" in line]
        assert len(found) > 1 and set(found) == {"Filter isnotnull(word)"}, (name, set(found))
        assert not any("regexp_extract_all" in line for line in plan if "Filter" in line), name


def test_mapped_goes_on_behind_each_change():
    def by_definition(w, start=0):
        """Each change of a first spelling, then what changes further on make of it."""
        for options in sets if len(w) > 1 else ():
            for one, other in ((x, y) for x in options for y in options if x != y):
                at = w.find(one, start)
                if at >= 0:
                    text = w[:at] + other + w[at + len(one) :]
                    yield text
                    yield from by_definition(text, at + 1)

    for sets in ([["a", "à"], ["b", "ß"]], [["a", "ä", "â"]], [["ab", "x"], ["b", "c"]], []):
        for w in ("abab", "a", "", "xbab", "baab", "äâa"):
            assert list(candidates.mapped(w, sets)) == list(by_definition(w)), (w, sets)
