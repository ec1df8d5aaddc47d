"""Operators against brute force, exact round trips or held-out accuracy; nulls, empty and odd rows for each."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dictspark.llm import chat, common, components, decontaminate, jpeg, langid, licenses, linededup, minhash, mixing, quality, queries, tokenbin
from dictspark.llm.common import discard, fold, free_names, materialize, pieces, release_scratch, scratch_tables, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word after word of one long text. " * 4000


def docs_of(spark, *texts, **more):
    return spark.createDataFrame([(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a very long one, repeated rows, null ids, a null source, columns with clashing names."""
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "  \n\t ", "en", None, 5), (4, LONG, "en", "a", 1), (5, "same text here", "en", "b", 1), (5, "same text here", "en", "b", 1), (None, "no id at all", "fr", "b", 1), (7, "1234 !!", "xx", "b", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("id", "comp", "n", "key", "block", "tokens", "weight", "rank", "score", "leader", "shard", "__x"):
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# Helpers


def test_scratch_tables(spark):
    since = scratch_tables(spark)
    a, b = materialize(spark.range(3), "a"), materialize(spark.range(4), "b")
    discard(a)
    assert scratch_tables(spark) == since + 1 and b.count() == 4
    c = materialize(spark.range(5), "c")
    assert release_scratch(spark, since, keep=c) == 1 and c.count() == 5
    with pytest.raises(Exception):
        b.count()
    discard(c)
    assert free_names(["a", "B"], "a", "b", "c", "C") == ["a_", "b_", "c", "C_"]


def test_pieces():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "", "c"]), pa.array(range(5))], names=["t", "k"])
    assert [x.column(1).to_pylist() for x in pieces([batch, batch.slice(5)], 0, 20)] == [[0, 1], [2], [3, 4]]


def test_memory_is_given_back(monkeypatch):
    """Once for each task, after its last piece."""
    said, batch = [], pa.record_batch([pa.array(["a" * 10, "b" * 10])], names=["t"])
    monkeypatch.setattr(common, "give_back", lambda: said.append(1))
    found = pieces([batch, batch], 0, 10)
    assert [len(said) for _ in found] == [0] * 4 and said == [1]


# 1: token files


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 10_001, dtype=np.uint64).astype(np.uint32)
    assert (tokenbin.unpack(tokenbin.pack(ids, width), len(ids), width) == ids).all()
    file = tokenbin.TokenFile(tokenbin.build_file([7, 8, 9], [ids[:4000], ids[:0], ids], width, 5))
    assert (file.document(0) == ids[:4000]).all() and len(file.document(1)) == 0 and (file.document(2) == ids).all()
    assert (file.read_ids(4090, 9000) == np.concatenate([ids[:4000], ids])[4090:9000]).all() and file.before == 5


def test_tokens_by_library(spark):
    from tokenizers import Tokenizer

    model, start = Tokenizer.from_file(tokenbin.vocabulary()), 0
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_token_id_output"](spark, SF).collect()}
    for r in table(spark, SF, "documents").orderBy("doc_id").collect():
        ids = [*model.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        x = got[r["doc_id"]]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_on_all_texts():
    from tokenizers import Tokenizer

    model, coder = Tokenizer.from_file(tokenbin.vocabulary()), tokenbin.encoder(tokenbin.vocabulary())
    assert coder.by_word
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    ids, bounds = coder.encode(texts)
    for k, text in enumerate(texts.to_pylist()):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == model.encode(text or "", add_special_tokens=False).ids, k


def test_encoder_on_random_texts():
    from tokenizers import Tokenizer

    model, coder, random = Tokenizer.from_file(tokenbin.vocabulary()), tokenbin.encoder(tokenbin.vocabulary()), np.random.default_rng(1)
    letters = list("ab*$_[@ .,'!?;:1é \t\nSsTdÉ-x")
    texts = ["".join(random.choice(letters, random.integers(0, 14))) for _ in range(4000)]
    ids, bounds = coder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_words_are_forgotten(monkeypatch):
    coder = tokenbin.Encoder(tokenbin.vocabulary())
    texts = pa.array([f"word{k} ab{k} same words" for k in range(400)])
    whole = coder.encode(texts)[0].tolist()
    monkeypatch.setattr(tokenbin, "_WORDS", 50)
    parts = [coder.encode(texts.slice(k, 10))[0].tolist() for k in range(0, 400, 10)]
    assert sum(parts, []) == whole and len(coder.words) <= 50


def test_tokens_of_odd_texts(spark, odd, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenbin.vocabulary())
    coder = tokenbin.encoder(tokenbin.vocabulary())
    for text in ("", "a", "İı ŉ ǅ", "naïve café.", "x́y", "<|x|> </s> [UNK]", "don't...!!", "日本語 mixed", "a\x00b", "   ", "ß ſ", "ABC,def;;g", "😀 ok"):
        assert coder.encode(pa.array([text]))[0].tolist() == model.encode(text, add_special_tokens=False).ids, text
    rows = tokenbin.token_output(odd, tokenbin.vocabulary()).collect()
    assert len(rows) == odd.count() and rows[0]["start"] >= 0 and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert tokenbin.token_output(none, tokenbin.vocabulary()).count() == 0


# 2: decontamination


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_passages_are_found(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    base = docs.where("lang = 'en' and n_chars > 500").orderBy("doc_id").limit(12).collect()
    planted = []
    for k, (r, (item, text)) in enumerate(zip(base, sorted(items.items()))):
        words = text.split()
        if k % 3 == 1:  # a paraphrase: every tenth word another
            words = [("zzqx" if i % 10 == 9 else w) for i, w in enumerate(words)]
        if k % 3 == 2:
            words = [w.upper() for w in words]
        planted.append((10_000 + k, r["text"][:700] + " " + " ".join(words) + " " + r["text"][700:], "en", "p", 0))
    extra = spark.createDataFrame(planted, DOCS)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs.select(*extra.columns).unionByName(extra), bench).collect()}
    assert {(10_000 + k, item) for k, item in zip(range(len(base)), sorted(items))} <= found


def _by_all_stretches(texts, items):
    """{(document, item): share} by plain Python over all stretches that begin with a word of the item."""
    found = {}
    for item, words in items.items():
        n, own, answer = len(words), set(words), words[-decontaminate.ANSWER_WORDS :]
        reach, sure, likely = decontaminate.REACH * n, math.ceil(decontaminate.SURE * n - 1e-9), math.ceil(decontaminate.LIKELY * n - 1e-9)
        for doc, text in texts.items():
            if n < decontaminate.LEAST_WORDS:
                found |= {(doc, item): 1.0} if n and text == words else {}
                continue
            hits = np.concatenate([[0], np.cumsum([w in own for w in text])])
            best = 0
            for s in np.flatnonzero(np.diff(hits)).tolist():
                if hits[min(len(text), s + reach)] - hits[s] < max(likely, best + 1):
                    continue
                length = _lcs(words, text[s : s + reach])
                if length >= sure or length >= likely and _lcs(answer, text[s : s + reach + len(answer)]) >= decontaminate.ANSWER * len(answer):
                    best = max(best, length)
            if best:
                found[doc, item] = best / n
    return found


def _split(text):
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", (text or "").lower()).split()


@pytest.fixture(scope="module")
def planted(spark):
    """(documents, benchmark of 200 items, planted pairs): copies, upper case, and every sixth word another."""
    bench = table(spark, "/root/testdata/sf0.1", "benchmark")
    docs = table(spark, SF, "documents").select(*[c.split()[0] for c in DOCS.split(", ")])
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    base = docs.where("n_chars > 500").orderBy("doc_id").limit(60).collect()
    rows = []
    for k, item in enumerate(sorted(items)):
        words = items[item].split()
        words = [w.upper() for w in words] if k % 3 == 1 else [f"zzqx{i}" if k % 3 == 2 and i % 6 == 5 else w for i, w in enumerate(words)]
        r = base[k % len(base)]
        rows.append((10_000 + k, r["text"][:350] + " " + " ".join(words) + " " + r["text"][350:], r["lang"], "p", 0))
    return docs.unionByName(spark.createDataFrame(rows, DOCS)), bench, {(10_000 + k, item) for k, item in enumerate(sorted(items))}


def test_no_passage_of_many_is_lost(planted):
    docs, bench, pairs = planted
    assert bench.count() >= 200
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in decontaminate.contaminated(docs, bench).collect()}
    texts = {r["doc_id"]: _split(r["text"]) for r in docs.select("doc_id", "text").collect()}
    want = _by_all_stretches(texts, {r["item_id"]: _split(r["text"]) for r in bench.collect()})
    assert pairs <= set(found) and set(found) == set(want) and all(found[k] == pytest.approx(want[k]) for k in want)
    clean = {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).select("doc_id").collect()}
    assert clean == set(texts) - {d for d, _ in found}


def test_spaces_follow_all_documents(spark, monkeypatch):
    """Singular vectors change with what half of 4,000 documents say, whichever half that is."""
    for name, value in (("RANK", 8), ("EXTRA", 4), ("ENERGY", 0.0)):
        monkeypatch.setattr(decontaminate, name, value)
    items = decontaminate.item_words([(k, " ".join(f"w{(20 * k + i) % 240}" for i in range(30)), None) for k in range(12)])
    idf = np.full(decontaminate.CELLS, 2.0, np.float32)
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000)) < 500_000).alias("half"))
    filler, other = F.concat_ws(" ", F.lit("filler"), "doc_id"), F.expr("concat_ws(' ', transform(sequence(0, 9), i -> concat('w', pmod(doc_id * 7 + 31 * i, 40))))")
    found = []
    for text in (filler, F.when(F.col("half"), other).otherwise(filler), F.when(F.col("half"), filler).otherwise(other)):
        _, (space,) = decontaminate.fit(ids.select("doc_id", text.alias("text")), items, idf)
        found.append(space.basis @ space.basis.T)
    assert all(np.abs(found[0] - x).max() > 0.01 for x in found[1:])


def test_clean_documents_by_all_documents(spark, monkeypatch):
    """The stage of the pipeline fits its spaces on every document that it is given."""
    seen, plain = [], decontaminate.corpus_products
    monkeypatch.setattr(decontaminate, "corpus_products", lambda docs, *more: seen.append(docs.count()) or plain(docs, *more))
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), "id").alias("text"))
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    assert decontaminate.keep_clean(docs, bench).count() == 5000 and seen == [5000]


@pytest.mark.parametrize("words", [0, 4608])
def test_products_of_all_passages(spark, planted, monkeypatch, words):
    """In both forms: the products of one pass over all documents are those of plain numbers."""
    monkeypatch.setattr(decontaminate, "PAIR_WORDS", words)
    monkeypatch.setattr(decontaminate, "PRODUCT_ROWS", 100)
    docs, bench, _ = planted
    (rows,) = decontaminate._blocks(bench)
    idf = decontaminate.inverse_frequencies(docs)
    items = decontaminate.Items(rows, idf)
    spaces = [decontaminate.Space(items, np.arange(at, at + 100), idf) for at in (0, 100)]
    right = [np.random.default_rng(3).standard_normal((len(s.vocabulary), 5)).astype(np.float32) for s in spaces]
    got, traces = decontaminate.corpus_products(docs, spaces, right, idf)
    texts = [_split(r["text"]) for r in docs.select("text").collect()]
    for k, space in enumerate(spaces):
        row = {int(h): j for j, h in enumerate(space.vocabulary.hashes.tolist())}
        want, trace = np.zeros(right[k].shape), 0.0
        for text in texts:
            hashes = decontaminate.tokens(pa.array([" ".join(text)]))[0]
            for at in range(0, len(hashes), decontaminate.PASSAGE):
                own = hashes[at : at + decontaminate.PASSAGE]
                a, weight = np.zeros(len(row)), idf[decontaminate.cell(own)]
                for h, w in zip(own.tolist(), weight.tolist()):
                    if h in row:
                        a[row[h]] += w
                a /= np.sqrt((weight.astype(float) ** 2).sum())
                some = np.flatnonzero(a)
                want[some] += np.outer(a[some], a[some] @ right[k][some])
                trace += a @ a
        assert np.allclose(got[k], want, rtol=1e-3, atol=1e-3 * np.abs(want).max()) and traces[k] == pytest.approx(trace, rel=1e-3)


def test_passages_of_a_larger_corpus(spark):
    """At sf0.1: every exact copy, copies of which a fifth of the words are others, and no share of energy below the limit."""
    sf, random = "/root/testdata/sf0.1", np.random.default_rng(4)
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    items = {r["item_id"]: _split(r["text"]) for r in bench.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows, fresh = [], itertools.count()
    for k, (item, words) in enumerate(sorted(items.items())):
        words = list(words)
        for i in random.choice(len(words), int(0.2 * len(words)), replace=False):
            words[i] = f"zq{next(fresh)}x"
        base = (texts[k % 9000] or "").split()
        rows.append((10**6 + k, " ".join([*base[:40], *words, *base[40:]])))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(both, bench).collect()}
    joined = {d: f" {' '.join(_split(t))} " for d, t in texts.items()}
    exact = {(d, k) for k, words in items.items() for d, t in joined.items() if f" {' '.join(words)} " in t}
    assert len(exact) > 200 and exact <= found
    planted = {(10**6 + k, item) for k, item in enumerate(sorted(items))}
    assert planted <= found
    idf = decontaminate.inverse_frequencies(docs)
    (own,) = decontaminate._blocks(bench)
    every, spaces = decontaminate.fit(docs, own, idf)
    assert min(s.energy.min() for s in spaces) >= decontaminate.ENERGY and sum(len(s.own) for s in spaces) == len(items)
    # The latent search alone, without the exact one.
    near = set()
    for doc, item in exact:
        column = pa.array([texts[doc]])
        near |= {(doc, every.rows[k][0]) for s in spaces for k in s.candidates(*decontaminate.tokens(column))[0].tolist()}
    assert len(exact & near) >= 0.99 * len(exact)


def test_long_and_short_items(spark):
    words = [f"w{k}" for k in range(300)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "two words"), (3, "one"), (4, "?!")], "item_id bigint, text string")
    changed = [f"x{k}" if k % 6 == 0 else w for k, w in enumerate(words)]
    texts = [" ".join(["a b c"] * 50 + changed), " ".join(words[:200]), "Two, words!", "here are two words", "one", "One one", " ".join(words[:180] + ["z"] * 200 + words[180:])]
    docs = docs_of(spark, *texts)
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in decontaminate.contaminated(docs, bench).collect()}
    want = _by_all_stretches({k: _split(t) for k, t in enumerate(texts)}, {r["item_id"]: _split(r["text"]) for r in bench.collect()})
    assert found == pytest.approx(want) and set(found) == {(0, 1), (2, 2), (4, 3), (6, 1)}


def test_answers_of_their_own(spark):
    passage = [f"p{k}" for k in range(20)]
    bench = spark.createDataFrame([(1, " ".join(passage), "right answer here")], "item_id bigint, text string, answer string")
    some = " ".join(f"y{k}" if k % 3 == 0 else w for k, w in enumerate(passage))  # 13 of 20
    docs = docs_of(spark, some, some + " Right answer, here!", "right answer here", " ".join(passage[4:]))
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()} == {1, 3}


def test_odd_benchmarks(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same text here"), (None, "same text here as well"), (4, "a b c d e f g h")], "item_id bigint, text string")
    assert sorted(r["item_id"] for r in decontaminate.contaminated(odd, bench).collect()) == [3, 3]
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    kept = decontaminate.keep_clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontaminate.keep_clean(odd, bench.limit(0)).count() == odd.count() and decontaminate.keep_clean(none, bench).count() == 0


def test_blocks_of_items(spark, planted, monkeypatch):
    docs, bench, pairs = planted
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 80)
    monkeypatch.setattr(decontaminate, "SPACE", 30)
    assert pairs <= {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}


def test_common_subsequences():
    random = np.random.default_rng(1)
    for _ in range(50):
        item, span = random.integers(0, 6, random.integers(1, 200)), random.integers(0, 6, 80)
        masks = [sum(1 << k for k, x in enumerate(item.tolist()) if x == y) for y in span.tolist()]
        bits = np.array([[[m >> (64 * w) & (2**64 - 1) for w in range(-(-len(item) // 64))] for m in masks]], np.uint64)
        assert decontaminate.common_subsequences(bits, np.array([len(item)]))[0] == _lcs(item.tolist(), span.tolist())


# 3: licences


def test_license_texts(spark):
    name, text = licenses.LICENSES[0]
    variants = ["Copyright (c) 2020 A. Person\n" + text, text.upper().replace(" ", "\n"), text.replace("License", "Licence"), "All rights reserved.\n" + text + "!!"]
    got = licenses.scan(docs_of(spark, *variants, text + " more", None, "", "!!!")).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == [name] * 4 + [None] * 4
    assert len({r["digest"] for r in got[5:]}) == 1


@pytest.mark.skipif(not os.path.isdir(licenses.PUBLISHED), reason="no licences on this system")
def test_published_licenses(spark):
    """Whole texts as systems publish them, reflowed, in capitals and with an owner's line; without the advice at the end."""
    want, texts = {}, []
    for name in ("Apache-2.0", "CC0-1.0", "GFDL-1.3", "GPL-1", "GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0"):
        with open(f"{licenses.PUBLISHED}/{name}", encoding="utf-8", errors="replace") as f:
            text = f.read()
        own = name if "-" in name and "." in name else f"{name}.0"
        for x in (text, text.upper(), "Copyright 2020 Some Person\n\n" + text, text.split(licenses.END_OF_TERMS)[0], text.replace("\n", "\r\n")):
            want[len(texts)] = own
            texts.append(x)
        want[len(texts)] = None
        texts.append(text + " and more")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs_of(spark, *texts)).collect()}
    assert got == want


def test_license_of_every_known_text(spark):
    owners = ["", "Copyright (c) 2020 A. Person\n\n", "(c) 1999 X Ltd.\n", "Copyright Jane Doe\n\n", "© 2001-2003 Y\nAll rights reserved.\n"]
    texts = [(name, owner + text) for name, text in licenses.LICENSES for owner in owners]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs_of(spark, *(t for _, t in texts))).collect()}
    assert got == {k: name for k, (name, _) in enumerate(texts)}


def test_licenses_of_no_rows(none):
    assert licenses.scan(none).count() == 0


def test_license_forms_agree(spark, odd):
    rows = odd.select("text", licenses.canonical_column(F.col("text")).alias("c")).collect()
    assert all(r["c"] == licenses.canonical(r["text"]) for r in rows) and licenses.scan(odd).count() == odd.count()


# 4: languages


def test_languages_held_out(spark):
    got = langid.identify(table(spark, "/root/testdata/sf0.01", "documents"))
    truth = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text")
    rows = got.join(truth, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def _scores_by_hand(examples, text, longest=langid.LONGEST):
    """{language: total} of a text by dictionaries: known words, else the longest n-grams of which any is known."""
    find = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    tables = {}
    for lang, t in examples:
        for w in find(t):
            tables.setdefault((0, w), {}).setdefault(lang, []).append(1)
    for (_, w), by in [x for x in tables.items() if x[0][0] == 0]:
        for n in range(1, longest + 1):
            marked = f"^{w}$"
            for i in range(len(marked) - n + 1):
                for lang, times in by.items():
                    tables.setdefault((n, marked[i : i + n]), {}).setdefault(lang, []).extend(times)
    langs = sorted({lang for lang, _ in examples})
    kinds = {n: sum(k[0] == n for k in tables) for n in range(longest + 1)}
    whole = {(n, lang): sum(len(v.get(lang, [])) for k, v in tables.items() if k[0] == n) for n in kinds for lang in langs}
    log = lambda key, lang: math.log((len(tables[key].get(lang, [])) + 0.5) / (whole[key[0], lang] + 0.5 * kinds[key[0]]))
    total = dict.fromkeys(langs, 0.0)
    for w in find(text):
        found = [(0, w)] if (0, w) in tables else []
        for n in range(longest, 0, -1):
            found = found or [(n, g) for i in range(len(w) + 3 - n) if (n, g := f"^{w}$"[i : i + n]) in tables]
        for lang in langs:
            total[lang] += sum(log(k, lang) for k in found) / len(found) if found else 0.0
    return {k: v / len(find(text)) for k, v in total.items()}


def test_languages_by_brute_force(spark):
    examples = [("en", "the cat and the dog"), ("en", "a dog ran"), ("fr", "le chat et le chien"), ("fr", "été à la mer"), ("de", "der Hund und die Katze")]
    model = langid.fit(spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(examples)], "doc_id bigint, text string, lang string"))
    texts = ["the dog", "la catedrale", "Hunde und Katzen", "dogged chienne", "xylo", "ÉTÉ mers", "z", "a" * 300, "the le der", "日本"]
    names, best = model.predict(pa.array(texts))
    for text, name, score in zip(texts, names, best.tolist()):
        want = _scores_by_hand(examples, text)
        n = min(20, len(re.findall(r"[^\W\d_]+", text)))
        likely = {k: math.exp(n * (v - max(want.values()))) for k, v in want.items()}
        assert score == pytest.approx(max(likely.values()) / sum(likely.values()), rel=1e-4), text
        assert likely[name] == pytest.approx(1.0, rel=1e-4)
    assert model.predict(pa.array(texts[::-1]))[0] == names[::-1]


def test_texts_without_letters(spark):
    model = langid.fit(table(spark, SF, "documents"))
    texts = ["½ " * n for n in (1, 49, 50, 5000)] + [None, "", "12 _ ²³ !!", "½ " * 5000 + "a"]
    assert [x == "und" for x in model.predict(pa.array(texts))[0]] == [True] * 7 + [False]


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "SMALL", 3)
    rows = [(k, f"word{chr(97 + k % 20)}{chr(97 + k % 20)} common", f"l{k % 20}") for k in range(200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.langs) == 20 and model.predict(pa.array(["wordcc"]))[0] == ["l2"]


def test_odd_languages(spark, odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got) and langid.identify(none).count() == 0
    nothing = langid.fit(none)
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 3)").count() == 0 and kept.where("doc_id = 5").count() == 2
    assert langid.keep_identified(none).count() == 0


# 5: mixing


def test_weights():
    shares = [0.7, 0.2, 0.1]
    alpha = mixing.bisect_alpha(shares, repetition=1.5)
    weights = mixing.temperature(shares, alpha)
    assert max(w / s for w, s in zip(weights, shares)) == pytest.approx(1.5, rel=1e-6)
    assert mixing.bisect_alpha(shares, repetition=10) == 0 and mixing.temperature(shares, 1) == pytest.approx(shares)
    cold = mixing.temperature(shares, mixing.bisect_alpha(shares, entropy=0.9))
    assert -sum(w * np.log(w) for w in cold) == pytest.approx(0.9, abs=1e-6)


def test_mixture_meets_quotas(spark):
    docs = table(spark, SF, "documents")
    sizes = {r[0]: (r[1], r[2]) for r in docs.select("doc_id", "source", mixing.token_count(F.col("text"))).collect()}
    got = mixing.mixed(docs, budget=1.3).collect()
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    whole = sum(n for _, n in sizes.values())
    for source in {s for s, _ in sizes.values()}:
        read = sum(sizes[r["doc_id"]][1] for r in got if r["source"] == source)
        weight = next(r["weight"] for r in got if r["source"] == source)
        assert abs(read - weight * 1.3 * whole) <= max(n for s, n in sizes.values() if s == source)


def _readings_by_hand(spark, rows, budget, repetition, seed=5, n_blocks=mixing.BLOCKS):
    """{(doc_id, source): times read} of rows (doc_id, source, tokens) by plain Python; hashes alone come from Spark."""
    df = spark.createDataFrame([(d, s or "", t) for d, s, t in rows], "doc_id bigint, source string, tokens bigint")
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_blocks))
    df = df.withColumn("block", block).withColumn("key", mixing._unit("block", "source", F.lit(seed))).withColumn("own", mixing._unit("doc_id", F.lit(seed + 1)))
    got, sources = df.collect(), {}
    for r in got:
        sources.setdefault(r["source"], []).append(r)
    size = {s: sum(r["tokens"] for r in own) for s, own in sources.items()}
    whole = sum(size.values())
    alpha = mixing.bisect_alpha([n / whole for n in size.values()], repetition)
    weight = dict(zip(size, mixing.temperature([n / whole for n in size.values()], alpha)))
    out = {}
    for s, own in sources.items():
        quota = weight[s] * budget * whole
        epochs = math.floor(quota / size[s] + 1e-9) if size[s] else 1
        rest, upto, last = max(0.0, quota - epochs * size[s]), 0, set()
        blocks = sorted({(r["key"], r["block"]) for r in own})
        for key, b in blocks:
            inside = sorted({(r["own"], r["doc_id"]) for r in own if r["block"] == b}, key=lambda x: (x[0], -1 if x[1] is None else x[1]))
            tokens = lambda d: sum(r["tokens"] for r in own if r["doc_id"] == d)
            if upto + sum(tokens(d) for _, d in inside) <= rest:
                last |= {d for _, d in inside}
                upto += sum(tokens(d) for _, d in inside)
                continue
            for _, d in inside if upto <= rest and size[s] else ():
                if upto + tokens(d) / 2 > rest:
                    break
                upto += tokens(d)
                last.add(d)
            break
        out |= {(r["doc_id"], s): epochs + (r["doc_id"] in last) for r in own}
    return out


@pytest.mark.parametrize("budget, repetition", [(1.0, 1.25), (1.3, 1.5), (0.4, 3.0)])
def test_readings_by_brute_force(spark, budget, repetition):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "source", mixing.token_count(F.col("text"))).collect()]
    want = _readings_by_hand(spark, rows, budget, repetition)
    got = {}
    for r in mixing.mixed(docs, budget, repetition).collect():
        got[r["doc_id"], r["source"] or ""] = got.get((r["doc_id"], r["source"] or ""), 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_many_sources(spark, monkeypatch):
    """The way for more sources than are collected gives the same readings."""
    docs = table(spark, SF, "documents").withColumn("source", F.concat("source", (F.col("doc_id") % 7).cast("string")))
    few = sorted((r["doc_id"], r["epoch"]) for r in mixing.mixed(docs).collect())
    monkeypatch.setattr(mixing, "SMALL", 5)
    assert sorted((r["doc_id"], r["epoch"]) for r in mixing.mixed(docs).collect()) == few
    cold = mixing.mixture(docs, repetition=None, entropy=1.5).first()["alpha"]
    monkeypatch.setattr(mixing, "SMALL", 10**6)
    assert cold == pytest.approx(mixing.mixture(docs, repetition=None, entropy=1.5).first()["alpha"], abs=1e-9)


def test_odd_mixtures(spark, odd, none):
    got = mixing.mixed(odd).collect()
    assert {r["source"] for r in got} == {"a", "b", None} and all(r["weight"] >= 0 for r in got)
    # Rows without tokens are read once in each epoch, those with the same id together.
    times = {k: sum(r["doc_id"] == k for r in got) for k in (1, 2, 3, 4, 5)}
    assert times[5] % 2 == 0 and times[3] == 1 and times[4] >= 1 and mixing.mixed(none).count() == 0
    names = ("__s", "__block", "__copies", "__key", "__epochs", "__of", "__epoch", "row", "copies", "key", "epochs", "of", "weight", "epoch", "blocks", "tokens", "quota", "alpha")
    wide = odd.select(*(c for c in odd.columns if c not in names), *(F.lit(k).alias(n) for k, n in enumerate(names)))
    read = mixing.resample(wide)
    assert read.columns == wide.columns and all(r[n] == k for r in read.collect() for k, n in enumerate(names))
    assert mixing.resample(none).count() == 0


# 6: quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    few = docs.join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id")
    got = quality.predict(few, quality.fit(few, labels.where(fold("doc_id") != 2))).where("held_out").join(few.select("doc_id", "y"), "doc_id").collect()
    score, y = np.array([r["score"] for r in got]), np.array([r["y"] for r in got])
    wins = (score[y == 1][:, None] > score[y == 0]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0]).mean()
    assert len(y) > 300 and wins > 0.8
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_trees_like_recursion():
    random = np.random.default_rng(3)
    x = random.normal(size=(500, 5))
    trees = quality.fit_trees(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=10)

    def walk(row, t, k=0):
        if k >= 2**trees.depth - 1:
            return trees.value[t, k - (2**trees.depth - 1)]
        return walk(row, t, 2 * k + 1 + (row[trees.feature[t, k]] > trees.cut[t, k]))

    assert np.allclose(trees.margin(x[:40]), [trees.base + sum(walk(r, t) for t in range(10)) for r in x[:40]])


def test_odd_qualities(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (7, None), (99, 1)], "doc_id bigint, quality int")
    got = quality.predict(odd, quality.fit(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.predict(odd, quality.fit(none, labels)).collect()} == {0.5}


# 7: chats


def test_paths_of_a_tree(spark):
    m = [("t", "r", None, "user", "Q", 0.0), ("t", "a", "r", "assistant", "A", 1.0), ("t", "b", "r", "assistant", "B", 3.0), ("t", "c", "b", "user", None, 0.0), ("t", "x", "y", "user", "loop", 0.0), ("t", "y", "x", "user", "loop", 0.0), ("u", "o", "gone", "user", "orphan", 0.0)]
    df = spark.createDataFrame(m, "tree string, id string, parent string, role string, text string, score double")
    got = {}
    for r in chat.paths(df).orderBy("path", "depth").collect():
        got.setdefault((r["tree"], r["path"], r["rank"]), []).append(r["text"])
    assert got == {("t", "c", 1): ["Q", "B", ""], ("t", "a", 2): ["Q", "A"], ("u", "o", 1): ["orphan"]}
    assert {r["path"] for r in chat.paths(df, branches=1).collect()} == {"c", "o"}


def test_odd_conversations(spark):
    texts = ["<|im_end|>\n<|im_start|>", "\\<|", "\\\\", None, "", "ünï 😀 \\|", "a\nb"]
    rows = [(9, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(8, 1, None, "x"), (8, 1, "assistant", "y"), (None, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("path", F.lit(1))
    got = {r["tree"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    said = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:7])
    loss = "".join(t or "" for _, _, r, t in rows[:7] if r == "assistant")
    assert got[9]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[9]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[9]["loss_chars"] == len(loss) and set(got) == {8, 9, None} and chat.format_conversations(df.limit(0)).count() == 0


# 8: images


def test_jpeg_round_trip(spark, odd, none, monkeypatch):
    random = np.random.default_rng(8)
    for n in (1, 3, 40):
        payload = random.integers(0, 256, 192 * n, dtype=np.uint8).tobytes()
        media = jpeg.store(payload)
        assert jpeg.load(media) == payload
        monkeypatch.setattr(jpeg, "ABREAST", 10**9 if jpeg.ABREAST < 10 else 1)
        assert jpeg.load(media) == payload  # symbol by symbol or in step, whichever it wasn't
    big = bytes(192 * (jpeg.IMAGE_ROWS + 2))
    assert len(jpeg.decode(jpeg.store(big))) == 2 and jpeg.load(jpeg.store(big)) == big
    with pytest.raises(jpeg.Damaged):
        jpeg.decode(media[:-40])
    got = jpeg.media_features(jpeg.media_column(odd)).collect()
    assert len(got) == odd.count() and jpeg.media_features(jpeg.media_column(none)).count() == 0
    for r in got:
        if r["doc_id"] in (1, 2):
            assert r["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest() and r["n_bytes"] == 0


def _written(random, width, height, parts, restart, huff_dc, huff_ac):
    """(JPEG, DC of luminance as units write it) with random coefficients, AC ones too; parts: (h, v) of each component."""
    most_h, most_v = max(h for h, _ in parts), max(v for _, v in parts)
    if len(parts) == 1:
        units = -(-width // 8) * -(-height // 8)
    else:
        units = -(-width // (8 * most_h)) * -(-height // (8 * most_v))

    def codes(lengths, symbols):
        out, code, k = {}, 0, 0
        for n in range(1, 17):
            for _ in range(lengths[n - 1]):
                out[symbols[k]] = format(code, f"0{n}b")
                code, k = code + 1, k + 1
            code <<= 1
        return out

    def value(v):
        n = abs(v).bit_length()
        return format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    dc, ac = codes(*huff_dc), codes(*huff_ac)
    out, luma, at = b"", [], 0
    every = restart or units
    for run, lo in enumerate(range(0, units, every)):
        bits, last = "", [0] * len(parts)
        for _ in range(lo, min(units, lo + every)):
            for k, (h, v) in enumerate(parts):
                for _ in range(1 if len(parts) == 1 else h * v):
                    level = int(random.integers(-200, 200))
                    diff, last[k] = level - last[k], level
                    bits += dc[abs(diff).bit_length()] + value(diff)
                    place = 1
                    while place < 64 and random.random() < 0.6:
                        skip, x = int(random.integers(0, min(3, 64 - place))), int(random.integers(1, 8)) * int(random.choice([-1, 1]))
                        bits += ac[skip << 4 | abs(x).bit_length()] + value(x)
                        place += skip + 1
                        if place < 40 and random.random() < 0.1:
                            bits += ac[0xF0]
                            place += 16
                    if place < 64:
                        bits += ac[0]
                    if k == 0:
                        luma.append(level)
        data = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\x00")
        out += (b"\xff" + bytes([0xD0 + (run - 1) % 8]) if run else b"") + data
    tables = jpeg._segment(0xDB, b"\x00" + b"\x08" * 64) + jpeg._segment(0xC4, b"\x00" + bytes(huff_dc[0]) + bytes(huff_dc[1])) + jpeg._segment(0xC4, b"\x10" + bytes(huff_ac[0]) + bytes(huff_ac[1]))
    frame = jpeg._segment(0xC0, bytes([8, height >> 8, height & 255, width >> 8, width & 255, len(parts)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(parts)))
    scan = jpeg._segment(0xDA, bytes([len(parts)]) + b"".join(bytes([k + 1, 0]) for k in range(len(parts))) + b"\x00\x3f\x00")
    return b"\xff\xd8" + tables + (jpeg._segment(0xDD, bytes([restart >> 8, restart & 255])) if restart else b"") + frame + scan + out + b"\xff\xd9", np.array(luma)


_HUFF_DC = ([0, 0, 0, 10, 0, 0] + [0] * 10, list(range(10)))
_HUFF_AC = ([0, 0, 1, 1, 0, 0, 12] + [0] * 9, [0, 0xF0, *(s << 4 | n for s in range(3) for n in range(1, 5))])


@pytest.mark.parametrize("parts, restart", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 1), ([(2, 1), (1, 1)], 0), ([(1, 2), (1, 1), (1, 2)], 2)])
def test_jpeg_of_another_writer(parts, restart, monkeypatch):
    """Components, subsampling, restart intervals and AC coefficients, written bit by bit."""
    random = np.random.default_rng(len(parts) * 10 + restart)
    for width, height in ((8, 8), (50, 37), (129, 66)):
        media, luma = _written(random, width, height, parts, restart, _HUFF_DC, _HUFF_AC)
        for abreast in (1, 10**9):
            monkeypatch.setattr(jpeg, "ABREAST", abreast)
            ((w, h, thumbnail),) = jpeg.decode(media)
            assert (w, h) == (width, height)
            ph, pv = parts[0] if len(parts) > 1 else (1, 1)
            most_h, most_v = max(x[0] for x in parts), max(x[1] for x in parts)
            across = -(-width // (8 * most_h)) if len(parts) > 1 else -(-width // 8)
            grid = np.zeros_like(thumbnail)
            for i, level in enumerate(luma.tolist()):
                unit, block = divmod(i, ph * pv)
                y, x = unit // across * pv + block // ph, unit % across * ph + block % ph
                if y < grid.shape[0] and x < grid.shape[1]:
                    grid[y, x] = np.clip(level + 128, 0, 255)
            assert (grid == thumbnail).all()
    with pytest.raises(jpeg.Damaged):
        jpeg.decode(media[: len(media) // 2] + b"\xff\xd9")


def test_long_scan_without_restarts():
    """Symbol by symbol, in time that grows with the scan: a megabyte of it in seconds."""
    random, took = np.random.default_rng(5), []
    for rows in (120, 1200):
        payload = random.integers(0, 256, 192 * rows, dtype=np.uint8)
        diff = np.diff(payload.astype(np.int64), prepend=128) + 255
        bits = "".join(format(int(c), "010b") for c in jpeg._codes()[diff])
        scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
        media = jpeg._image(scan, rows, 192).replace(jpeg._segment(0xDD, b"\x00\xc0"), b"")
        began = time.perf_counter()
        assert jpeg.load(media) == payload.tobytes()
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 1 and took[1] * 1_000_000 / len(scan) < 60


# 9: lines


def _lines_by_hand(texts):
    """What is left of texts (null: empty): runs of two solid lines, and long lines, go where they were seen before."""
    seen, out = set(), {}
    for k, t in enumerate(texts):
        lines, gone = (t or "").split("\n"), set()
        solid = [(p, c) for p, x in enumerate(lines) if (c := re.sub("[\t\r]", " ", x).strip(" "))]
        for i, (p, c) in enumerate(solid):
            for key, places in (((c, solid[i + 1][1]), (p, solid[i + 1][0])) if i + 1 < len(solid) else (None, ()), (c, (p,)) if c.count(" ") >= linededup.LONE_WORDS - 1 else (None, ())):
                if key is not None:
                    gone |= set(places) if key in seen else set()
                    seen.add(key)
        out[k] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_repeated_lines(spark):
    long = "one line of ten words or more that stands by itself"
    texts = ["a\nb\nc", "x\na\nb\ny", "b\nc\na\nb\nc", None, "", "c", "z\nz\nz\nz", long, "q\n" + long + " \nr", "a\n\n \nb", "\n\n", "\n\n"]
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in linededup.deduplicated(docs_of(spark, *texts), ("all", "gone")).collect()}
    assert got == {0: ("a\nb\nc", 0), 1: ("x\ny", 2), 2: ("", 5), 3: (None, 0), 4: ("", 0), 5: ("c", 0), 6: ("z", 3), 7: (long, 0), 8: ("q\nr", 1), 9: ("\n ", 2), 10: ("\n\n", 0), 11: ("\n\n", 0)}
    assert {k: t or "" for k, (t, _) in got.items()} == _lines_by_hand(texts)


def test_lines_by_brute_force(spark):
    random = np.random.default_rng(9)
    texts = ["\n".join(random.choice([*"abcdefgh", "", " ", "a line of words that is long enough to be a run alone"], random.integers(1, 12))) for _ in range(80)]
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicated(docs_of(spark, *texts)).collect()}
    assert got == _lines_by_hand(texts)


def test_odd_lines(odd, none):
    names = ("__id", "__version", "__gone", "__lines", "__deleted", "row", "lines", "print", "spans", "first", "gone", "version", "at", "e")
    wide = odd.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    got = linededup.deduplicated(wide)
    assert got.count() == odd.count() and got.columns == wide.columns and linededup.deduplicated(none).count() == 0
    assert all(r[n] == k for r in got.collect() for k, n in enumerate(names))
    with pytest.raises(ValueError):
        linededup.deduplicated(wide, ("Lines", "n"))


# 10: near duplicates


def _sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def _by_pairs(rows, width, percent):
    sets = {k: _sets(t, width) for k, t in rows.items()}
    comp = {k: k for k in sets}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in ids}


def test_near_duplicates_by_pairs(spark):
    rows = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op10_minhash_near_dedup"](spark, SF).collect()}
    assert got == _by_pairs(rows, 3, 85)


def test_near_duplicates_at_the_edge(spark):
    """Chains and families about the limit of similarity, short texts, ties."""
    random = np.random.default_rng(10)
    texts = ["", None, "one", "One", "one two", "two one"]
    for family in range(6):
        words = [f"w{family}x{k}" for k in range(60 + 20 * family)]
        for _ in range(12):
            words = list(words)
            for _ in range(random.integers(0, 3)):
                words[random.integers(0, len(words))] = f"n{random.integers(0, 10**6)}"
            texts.append(" ".join(words))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, *texts), 3, 85).collect()}
    assert got == _by_pairs(dict(enumerate(texts)), 3, 85)


@pytest.mark.parametrize("hot", [1, 64])
def test_shingles_of_many_sets(spark, monkeypatch, hot):
    """Sets that share a hot passage but are not alike, among copies that are: no pair is lost where two or three must be shared."""
    monkeypatch.setattr(minhash, "HOT", hot)
    random = np.random.default_rng(12)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for k in range(60):
        own = [f"o{k // 2}x{i}" for i in range(12)]
        if k % 2:
            own[int(random.integers(0, 12))] = f"n{k}"
        rows.append((k, " ".join(common + own)))
    docs = spark.createDataFrame([(k, k, t) for k, t in rows], "id bigint, comp bigint, text string")
    pairs = minhash.verified(docs.select(F.col("id").alias("doc_id"), "text"), minhash.prefix_pairs(docs, 3, 85), 3, 85)
    sets = {k: _sets(t, 3) for k, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert want and {(r["a"], r["b"]) for r in pairs.collect()} == want


def test_shingles_of_a_large_family(spark, monkeypatch):
    """A family in one component and a few sets outside that share much with it: pairs with these alone, from few rows."""
    random, rows, written = np.random.default_rng(15), [], []
    common = [f"c{k}" for k in range(80)]
    for k in range(150):
        own = list(common)
        own[int(random.integers(0, 80))] = f"n{k}"
        rows.append((k, 0, " ".join(own)))
    rows += [(200 + k, 200 + k, " ".join([*common[: 76 - 8 * k], *(f"o{k}x{i}" for i in range(4 + 8 * k))])) for k in range(4)]
    docs = spark.createDataFrame(rows, "id bigint, comp bigint, text string")
    plain = minhash.materialize

    def counted(df, label):
        out = plain(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    pairs = minhash.verified(docs.select(F.col("id").alias("doc_id"), "text"), minhash.prefix_pairs(docs, 3, 80), 3, 80)
    sets, comp = {k: _sets(t, 3) for k, _, t in rows}, {k: c for k, c, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want and {(r["a"], r["b"]) for r in pairs.collect()} == want
    assert sum(n for label, n in written if label == "prefixes") <= sum(-(-len(x) // 5) + minhash.LEVELS for x in sets.values())


def test_texts_of_some_ids(spark, monkeypatch):
    docs, ids = docs_of(spark, *(f"text {k}" for k in range(500))).select("doc_id", "text"), spark.range(3, 500, 9)
    for bits in (64, minhash.SIFT):
        monkeypatch.setattr(minhash, "SIFT", bits)
        assert sorted(map(tuple, minhash.texts_of(docs, ids).collect())) == [(k, f"text {k}") for k in range(3, 500, 9)]
    assert minhash.texts_of(docs, ids.limit(0)).count() == 0


def test_recall_of_bands():
    """Of pairs about the limit of 0.85, the share that has a band in common."""
    random, found, tried = np.random.default_rng(13), 0, 0
    for _ in range(3000):
        n = int(random.integers(30, 400))
        shared = random.integers(0, 2**63, n, dtype=np.uint64)
        extra = int(n * random.uniform(0.12, 0.17) / 2)
        a, b = (np.concatenate([shared, random.integers(0, 2**63, extra, dtype=np.uint64)]) for _ in range(2))
        if not 0.85 <= n / (n + 2 * extra) < 0.9:
            continue
        x, y = minhash.signature(a).reshape(minhash.ROWS, minhash.BANDS), minhash.signature(b).reshape(minhash.ROWS, minhash.BANDS)
        tried += 1
        found += bool((x == y).all(axis=0).any())
    assert tried > 1000 and found == tried


def test_odd_near_duplicates(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and all(r["kept"] for r in got) and {r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep_one_of_each(none).count() == 0
    kept = minhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 10] + [(5, 5), (None, 3), (1, 2)], "a bigint, b bigint")
    got = {r["id"]: r["comp"] for r in components.connected_components(edges).collect()}
    assert got == {k: (k - 1) // 10 * 10 + 1 for k in range(1, 41)}
    assert components.connected_components(edges.limit(0)).count() == 0


# Queries with SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_pipeline(spark):
    """Each stage against brute force on its own input; the benchmark has 200 items."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs, kept = table(spark, sf, "documents"), {}
    for name, stage in p.STAGES:
        before, docs = docs, p.materialize(stage(spark, docs, sf), "test")
        kept[name] = (before, docs)
        if stage is not p.tokens:
            assert docs.columns == before.columns
    before, after = kept["language ID"]
    with_letters = {r["doc_id"] for r in before.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert {r["doc_id"] for r in after.collect()} == with_letters - {r["doc_id"] for r in langid.identify(before).where("score < 0.5").collect()}
    before, after = kept["MinHash near-dedup"]
    comp = _by_pairs({r["doc_id"]: r["text"] for r in before.collect()}, 5, 80)
    assert {r["doc_id"] for r in after.collect()} == {k for k, (_, c) in comp.items() if k == c}
    before, after = kept["benchmark decontamination"]
    items = {r["item_id"]: _split(r["text"]) for r in table(spark, sf, "benchmark").collect()}
    bad = {d for d, _ in _by_all_stretches({r["doc_id"]: _split(r["text"]) for r in before.collect()}, items)}
    assert bad and {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad
    before, after = kept["mixing to target weights"]
    rows = [tuple(r) for r in before.select("doc_id", "source", mixing.token_count(F.col("text"))).collect()]
    times = _readings_by_hand(spark, rows, 1.0, mixing.REPETITION)
    got = {}
    for r in after.collect():
        got[r["doc_id"], r["source"] or ""] = got.get((r["doc_id"], r["source"] or ""), 0) + 1
    assert got == {k: n for k, n in times.items() if n}
    before, after = kept["token-ID output"]
    coder = tokenbin.encoder(tokenbin.vocabulary())
    ids, bounds = coder.encode(pa.array([r["text"] for r in before.orderBy("doc_id").collect()], pa.string()))
    rows = after.orderBy("start").collect()
    assert [r["n_tokens"] for r in rows] == (np.diff(bounds) + 1).tolist()
    assert rows[0]["ids_crc32"] == zlib.crc32(np.append(ids[: bounds[1]], 2).astype("<u4").tobytes())
    whole = sorted(map(tuple, p.run(spark, sf).collect()))
    assert whole == sorted(map(tuple, docs.collect()))


def test_stages_without_rows(spark, odd):
    import corpus_pipeline as p

    none = table(spark, SF, "documents").limit(0)
    for _, stage in p.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0
        stage(spark, odd, SF).count()
