"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams.

A word is a run of letters, in lower case. Frequencies of the words and n-grams of each language are tables sorted by
a 64-bit hash, so that all words of some documents are looked up at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.llm import wordhash
from dictspark.llm.common import fold, materialize, pieces, spread, table, text_bytes

#: About so many labelled documents of each language are learned from, chosen by a hash of the id.
FIT_DOCS = 2000
#: Letters of the longest n-grams, which hold a mark at each end of a word.
LONGEST = 5
#: Rows up to which the table of languages is broadcast; a larger one is joined without a hint.
SMALL = 10_000
REJECTED = "und"
_BEGIN, _END = 0x5E, 0x24
_FACTOR = np.uint64(0x9FB21C651E98DF25)


class Words:
    """The words of some texts: their hashes, the first word of each text, and code points for the n-grams of any of them."""

    def __init__(self, column: pa.Array) -> None:
        spaced = pc.replace_substring_regex(pc.utf8_lower(column.fill_null("")), r"[^\p{L}]+", " ")
        raw, bounds = text_bytes(pc.binary_join_element_wise(spaced, "", " "))
        self.hashes, self.first = wordhash.words(raw, bounds)
        self.points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        inside = np.concatenate([[False], self.points != 0x20, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = edges[::2], edges[1::2]

    def texts(self, which: np.ndarray) -> list[str]:
        raw = self.points.tobytes()
        return [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(self.begin[which].tolist(), self.end[which].tolist())]

    def padded(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code points of these words with a mark at both ends, where each begins, and the end)."""
        size = self.end[which] - self.begin[which] + 2
        bounds = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(bounds[-1]) + np.repeat(self.begin[which] - 1 - bounds[:-1], size)
        out = self.points[np.clip(place, 0, max(len(self.points) - 1, 0))].copy() if len(which) else np.zeros(0, np.uint32)
        out[bounds[:-1]], out[bounds[1:] - 1] = _BEGIN, _END
        return out, bounds


def grams(points: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n points that lies in one word, number of its word)."""
    total = np.zeros(max(0, len(points) - n + 1), np.uint64)
    for k in range(n):
        total = (total + points[k : k + len(total)].astype(np.uint64) + np.uint64(1)) * _FACTOR
        total ^= total >> np.uint64(29)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(total)]
    whole = np.arange(len(total)) + n <= bounds[owner + 1]
    return wordhash.mix(total[whole]), owner[whole]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of wanted are among the sorted keys, their rows)."""
    if not len(keys) or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    at = np.flatnonzero(keys[row] == wanted)
    return at, row[at]


class Model:
    """For words (n = 0) and n-grams: sorted hashes and a matrix of log frequencies by language."""

    def __init__(self, langs: list[str], words: list[str], lang: np.ndarray, counts: np.ndarray) -> None:
        """words[k] was seen counts[k] times in langs[lang[k]]."""
        self.langs = langs
        parts: list[list[tuple[np.ndarray, np.ndarray, int]]] = [[] for _ in range(LONGEST + 1)]
        for k in range(len(langs)):
            own = np.flatnonzero(lang == k)
            seen = Words(pa.array([words[i] for i in own.tolist()], pa.string()))
            parts[0].append((seen.hashes, counts[own], k))
            points, bounds = seen.padded(np.arange(len(own)))
            for n in range(1, LONGEST + 1):
                found, owner = grams(points, bounds, n)
                keys, place = np.unique(found, return_inverse=True)
                parts[n].append((keys, np.bincount(place, counts[own][owner], len(keys)), k))
        self.keys, self.logs = [], []
        for found in parts:
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in found)]))
            table = np.zeros((len(keys), max(1, len(langs))))
            for own, c, k in found:
                table[np.searchsorted(keys, own), k] = c
            self.keys.append(keys)
            self.logs.append(np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * max(1, len(keys)))).astype(np.float32))

    def score(self, words: Words, which: np.ndarray) -> np.ndarray:
        """Log frequencies by language of these words."""
        out = np.zeros((len(which), max(1, len(self.langs))), np.float32)
        at, row = _find(self.keys[0], words.hashes[which])
        out[at] = self.logs[0][row]
        left = np.setdiff1d(np.arange(len(which)), at, assume_unique=True)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            hashes, owner = grams(*words.padded(which[left]), n)
            at, row = _find(self.keys[n], hashes)
            hits = np.bincount(owner[at], minlength=len(left))
            some = np.flatnonzero(hits)
            for k in range(out.shape[1]):
                out[left[some], k] = np.bincount(owner[at], self.logs[n][row, k], len(left))[some] / hits[some]
            left = left[hits == 0]
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        words = Words(column)
        size = np.diff(words.first)
        names, best = np.full(len(column), REJECTED, object), np.zeros(len(column))
        if not self.langs or not len(words.hashes):
            return names.tolist(), best
        _, which, place = np.unique(words.hashes, return_index=True, return_inverse=True)
        scores, owner = self.score(words, which), np.repeat(np.arange(len(column)), size)
        total = np.stack([np.bincount(owner, scores[place, k], len(column)) for k in range(len(self.langs))], axis=1)
        scaled = total * (np.minimum(size, 20) / np.maximum(size, 1))[:, None]
        likely = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        some = size > 0
        names[some] = np.array(self.langs, object)[likely.argmax(axis=1)[some]]
        best[some] = (likely.max(axis=1) / likely.sum(axis=1))[some]
        return names.tolist(), best


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 0):
        coded = batch.column(1).dictionary_encode()
        words = Words(batch.column(0))
        owner = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(words.first))
        for k, lang in enumerate(coded.dictionary.to_pylist()):
            own = np.flatnonzero(owner == k)
            _, which, counts = np.unique(words.hashes[own], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(which)), pa.array(words.texts(own[which]), pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "c"])


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Learn from labelled(doc_id, text, lang), of which about fit_docs for each language are read, chosen by hash.

    Rows without text or lang are left out. All words of the chosen texts are kept; what reaches the driver grows with
    fit_docs and the number of languages, not with the corpus.
    """
    labelled = spread(labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang"))
    counts = materialize(labelled.groupBy("lang").count(), "languages")
    langs = sorted(r["lang"] for r in counts.select("lang").toLocalIterator())
    small = F.broadcast(counts) if len(langs) <= SMALL else counts
    unit = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) / 1_000_000
    chosen = labelled.join(small, "lang").where(unit < fit_docs / F.col("count"))
    summed = chosen.select("text", "lang").mapInArrow(_count, "lang string, word string, c bigint").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    rows = summed.orderBy("lang", "word").toArrow()
    number = {x: k for k, x in enumerate(langs)}
    lang = np.array([number[x] for x in rows.column("lang").to_pylist()], np.int64)
    return Model(langs, rows.column("word").to_pylist(), lang, rows.column("c").to_numpy().astype(np.float64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text); predictions see the text alone.

    Null texts and texts without a letter get `und` and score 0, as does every text if nothing was learned. Rows with
    a null doc_id are predicted like any other; equal texts get equal predictions; an empty table gives no rows; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            names, best = shared.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(best, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold("doc_id") == 2).alias("held_out"), "text")
    return spread(rows).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """predict() for docs(doc_id, text, lang), learned from its rows outside fold 2."""
    return predict(docs, fit(docs.where(fold("doc_id") != 2)))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, without those whose language can't be told: no letter, or a score below least.

    Rows with a null text go; repeated rows and null ids are judged like any others; an empty table, or one from which
    nothing can be learned, gives no rows.
    """
    model = fit(docs.where(fold("doc_id") != 2))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, place):
            names, best = shared.value.predict(batch.column(place))
            yield batch.filter(pa.array([lang != REJECTED and score >= least for lang, score in zip(names, best.tolist())], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0; a row without lang is no example but is predicted;
    an empty table gives no rows.
    """
    return identify(table(spark, sf_dir, "documents"))
