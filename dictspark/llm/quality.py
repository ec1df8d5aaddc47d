"""Document quality: histogram gradient-boosted trees over document statistics, flattened for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.llm import wordhash
from dictspark.llm.common import fold, pieces, spread, table, text_bytes

#: About so many labelled rows are learned from, chosen by a hash of the id.
FIT_ROWS = 20_000
BINS, DEPTH, TREES, RATE = 64, 4, 60, 0.2
CUT = 0.7
FEATURES = ("log_bytes log_words upper lower digit space newline mark stop comma bang pipe hash_like brace quote high control entropy "
            "word_len word_dev distinct repeat top pair_distinct line_words line_distinct ended marks_per_word").split()  # fmt: skip

_CLASS = np.zeros((13, 256), np.float64)
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9), (10, 13), b".;:?'-\"()", b".", b",", b"!", b"|", b"#$%&*@^~+=<>", b"{}[]\\/_", b"`'\"")):
    _CLASS[_k, list(_bytes)] = 1


def statistics(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document; all zero for one without bytes."""
    hashes, first = wordhash.words(raw, bounds)
    n = len(bounds) - 1
    out = np.zeros((n, len(FEATURES)))
    for i in range(n):
        own = raw[bounds[i] : bounds[i + 1]]
        if not len(own):
            continue
        size, count = len(own), np.bincount(own, minlength=256)
        share = _CLASS @ count / size
        high, control = count[128:].sum() / size, (count[:9].sum() + count[14:32].sum()) / size
        p = count[count > 0] / size
        w = hashes[first[i] : first[i + 1]]
        words = len(w)
        row = [np.log1p(size), np.log1p(words), *share, high, control, -(p * np.log(p)).sum()]
        if words:
            kinds, times = np.unique(w, return_counts=True)
            pairs = w[1:] * np.uint64(0x9FB21C651E98DF25) + w[:-1]
            lines = bytes(own).split(b"\n")
            row += [size / words, 0.0, len(kinds) / words, float((w[1:] == w[:-1]).mean()) if words > 1 else 0.0, times.max() / words,
                    len(np.unique(pairs)) / max(1, words - 1), words / len(lines), len(set(lines)) / len(lines), float(own[-1] in b".!?"), share[[5, 7, 8, 9, 10, 11]].sum() * size / words]
            gaps = np.flatnonzero((own == 32) | (own == 10))
            row[len(row) - 9] = float(np.diff(gaps).std()) if len(gaps) > 2 else 0.0
        else:
            row += [0.0] * 10
        out[i] = row
    return out


class Trees:
    """Full binary trees in level order: inner node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, edges: np.ndarray, base: float, depth: int) -> None:
        self.edges, self.base, self.depth = edges, base, depth
        self.feature = np.zeros((0, 2**depth - 1), np.int64)
        self.cut = np.zeros((0, 2**depth - 1))
        self.value = np.zeros((0, 2**depth))

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = 5.0) -> Trees:
    """Logistic loss; each level of a tree is split at the best edge of its histograms. Without rows: always 0.5."""
    if not len(y):
        return Trees(np.zeros((0, 0)), 0.0, depth)
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    binned = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, x.T)], axis=1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out, n, m = Trees(edges, float(np.log(prior / (1 - prior))), depth), *x.shape
    total = np.full(n, out.base)
    flat = binned + np.arange(m) * bins
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k, low = 2**level, 2**level - 1
            at = ((node - low)[:, None] * (m * bins) + flat).ravel()
            sums = [np.bincount(at, np.repeat(v, m), k * m * bins).reshape(k, m, bins) for v in (g, h)]
            left = [s.cumsum(axis=2)[:, :, :-1] for s in sums]
            whole = [s.sum(axis=2, keepdims=True) for s in sums]
            gain = left[0] ** 2 / (left[1] + ridge) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
            best = gain.reshape(k, -1).argmax(axis=1)
            ok = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
            f, b = np.divmod(best, bins - 1)
            feature[low : low + k] = f
            cut[low : low + k] = np.where(ok, edges[f, b], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        total += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    out.feature, out.cut, out.value = np.array(features), np.array(cuts), np.array(values)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        found = statistics(*text_bytes(batch.column(1)))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES)), pa.array(found.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Learn labels(doc_id, quality) of docs(doc_id, text); about fit_rows of them, chosen by hash, are read.

    Labels other than 0 and 1 and null ids are left out; a document with several labels counts with each; null texts count
    as empty; without labels the trees are empty.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("label"))
    share = min(1.0, fit_rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_measure, "label double, x array<double>").collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))
    return fit_trees(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows]))


def predict(docs: DataFrame, trees: Trees, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text); scores see the text alone.

    Null texts count as empty; empty texts are scored like any other. Rows with a null doc_id are scored too; equal
    texts get equal scores; other columns are not read. Without any label every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            score = shared.value.score(statistics(*text_bytes(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold("doc_id") == 2).alias("held_out"), "text")
    return spread(rows).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of documents, learned from labels outside fold 2; see predict().

    An empty table of documents gives no rows, one of labels a score of 0.5 for all.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return predict(docs, fit(docs, labels.where(fold("doc_id") != 2)))
