"""Benchmark decontamination: latent semantic retrieval of benchmark items, then longest common subsequences.

An item is found in a document if a stretch of REACH times the item's words has SURE of them in order, or LIKELY of them
and ANSWER of the answer's words. A stretch begins at any word of the document.

Candidates come from two searches, and each is checked word by word:

* TF-IDF vectors of passages are projected on the leading right singular vectors of a randomised SVD of benchmark and
  corpus, all documents of it; windows of documents are compared with items by their cosine in that space. It finds likenesses of words that
  stand together, but nothing bounds what it overlooks.
* So the rarest words of an item are looked up as well: a stretch that passes the check can miss only 1 - LIKELY of the
  item's places, so that of any places more than these it has some. This search overlooks nothing that the check accepts
  and alone decides recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.llm import wordhash
from dictspark.llm.common import map_batches, pieces, spread, table, text_bytes

#: Words of a passage whose frequencies count, and cells of the hashed table of frequencies.
PASSAGE, CELLS = 32, 1 << 16
#: Share of the trace that the benchmark has where singular vectors are fitted; all documents have the rest.
BENCHMARK_SHARE = 0.9
#: Words of all spaces up to which a task sums pairs of words in one table; passages at a time; rows of a product that travel together.
PAIR_WORDS, PAIR_PASSAGES, PRODUCT_ROWS = 4608, 512, 256
#: Items that share one space, its dimensions, those that are cut off again, and what each item keeps of its energy there.
SPACE, RANK, EXTRA, ENERGY = 160, 192, 16, 0.9
#: Items compared in one pass over the documents.
PASS_ITEMS = 4096
#: Least cosine in the space, and least share of a window's energy that lies on words of the items at all.
MIN_COSINE, MIN_SHARE = 0.5, 0.3
#: Words of the smallest windows, which are made of two blocks; larger ones double.
WINDOW = 16
#: Shares of an item's words, in order: certain; enough if the answer is there too; of the answer's own words.
SURE, LIKELY, ANSWER = 0.8, 0.6, 0.8
#: Words of a stretch for each of the item; words at the end of an item that stand for a missing answer.
REACH, ANSWER_WORDS = 2, 5
#: Items of fewer words occur by chance; they are found where they are all that a document says.
LEAST_WORDS = 4
#: Rare words that a candidate has at least.
HITS = 4
_STEP = WINDOW // 2


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in lower case, place of each text's first word); ASCII marks and white space part words."""
    return wordhash.words(*text_bytes(pc.utf8_lower(column)), gaps=wordhash.MARKS)


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def at_least(share: float, n: np.ndarray | int) -> np.ndarray:
    """The least whole number that is share of n."""
    return np.ceil(share * np.asarray(n) - 1e-9).astype(np.int64)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 ... of sizes[i] each, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def passages_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each passage of the documents hashes[first[i]:first[i + 1]] begins, its words)."""
    per_doc = -(-np.diff(first) // PASSAGE)
    starts = np.repeat(first[:-1], per_doc) + spans(np.zeros(len(per_doc), np.int64), per_doc) * PASSAGE
    return starts, np.minimum(starts + PASSAGE, np.repeat(first[1:], per_doc)) - starts


def passage_counts(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, int]:
    """(passages in which each cell occurs, passages) of a batch."""
    starts, sizes = passages_of(first)
    total = np.zeros(CELLS, np.int64)
    cells = np.append(cell(hashes), np.zeros(PASSAGE, np.int64)).astype(np.uint16)
    for at in range(0, len(starts), 1 << 14):
        places = starts[at : at + (1 << 14), None] + np.minimum(np.arange(PASSAGE), sizes[at : at + (1 << 14), None] - 1)  # places beyond the end repeat the last word
        block = cells[places]
        block.sort(axis=1)
        fresh = np.ones(block.shape, bool)
        np.not_equal(block[:, 1:], block[:, :-1], out=fresh[:, 1:])
        total += np.bincount(block[fresh], minlength=CELLS)
    return total, len(starts)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, passages = np.zeros(CELLS, np.int64), 0
    for batch in pieces(batches, 0):
        counts, n = passage_counts(*tokens(batch.column(0)))
        total, passages = total + counts, passages + n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, CELLS)), pa.array(np.append(total[used], passages))], names=["cell", "c"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + passages) / (1 + passages with the cell)) over all of docs; CELLS numbers, whatever their size."""
    total = np.zeros(CELLS + 1, np.int64)
    summed = spread(docs.select("text")).mapInArrow(_frequencies, "cell bigint, c bigint").groupBy("cell").agg(F.sum("c").alias("c"))
    for row in summed.toLocalIterator():
        total[row["cell"]] = row["c"]
    return np.log((1 + total[CELLS]) / (1 + total[:CELLS])).astype(np.float32) + 0.01


class Vocabulary:
    """Sorted hashes of words, with a table that sifts out most others."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.taken = np.zeros(1 << 20, bool)
        self.taken[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of hashes are known, their rows)."""
        at = np.flatnonzero(self.taken[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        good = self.hashes[row] == hashes[at]
        return at[good], row[good]


class Bits:
    """For texts of like length: the places at which each has each word, as bits of one or more 64-bit numbers."""

    def __init__(self, vocabulary: Vocabulary, texts: list[np.ndarray]) -> None:
        self.n = len(vocabulary)
        sizes = np.array([len(x) for x in texts], np.int64)
        width = -(-sizes // 64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(width[width > 0]).tolist():
            own = np.flatnonzero(width == w)
            row = np.searchsorted(vocabulary.hashes, np.concatenate([texts[k] for k in own.tolist()]))
            place = spans(np.zeros(len(own), np.int64), sizes[own])
            keys, at = np.unique(np.repeat(own, sizes[own]) * self.n + row, return_inverse=True)
            bits = np.zeros((len(keys), w), np.uint64)
            np.bitwise_or.at(bits, (at, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
            self.tables[w] = np.append(keys, -1)[np.argsort(np.append(keys, -1))], np.vstack([np.zeros((1, w), np.uint64), bits])
        self.sizes, self.width = sizes, width

    def holds(self, text: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether text[i] has the word row[i] (n: no word)."""
        out = np.zeros(len(text), bool)
        for w, (keys, _) in self.tables.items():
            own = np.flatnonzero((self.width[text] == w) & (row < self.n))
            key = text[own] * self.n + row[own]
            out[own] = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
        return out

    def common(self, rows: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each rows[start[i]:stop[i]] (rows of words; n: none) with text[i]."""
        out = np.zeros(len(text), np.int64)
        for w, (keys, bits) in self.tables.items():
            own = np.flatnonzero(self.width[text] == w)
            longest = int((stop[own] - start[own]).max(initial=0))
            step = max(1, (1 << 21) // max(1, longest * w))
            for lo in range(0, len(own), step):
                k = own[lo : lo + step]
                place = start[k, None] + np.arange(int((stop[k] - start[k]).max(initial=0)))
                word = np.where(place < stop[k, None], rows[np.minimum(place, len(rows) - 1)], self.n)
                key = np.where(word < self.n, text[k, None] * self.n + word, -1)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                out[k] = common_subsequences(bits[np.where(keys[at] == key, at, 0)], self.sizes[text[k]])
        return out


def common_subsequences(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each span with its text of sizes words.

    Bit k of the numbers places[i, t] says that word t of span i is word k of its text.
    """
    n, steps, width = places.shape
    state = np.full((width, n), ~np.uint64(0))
    for t in range(steps):
        carry = np.zeros(n, np.uint64)
        for w in range(width):
            both = state[w] & places[:, t, w]
            added = state[w] + both
            over = added < state[w]
            added += carry
            carry = (over | (added < carry)).astype(np.uint64)
            state[w] = added | (state[w] & ~both)
    left = np.clip(sizes[None, :] - 64 * np.arange(width)[:, None], 0, 64)
    mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left % 64).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & mask).sum(axis=0, dtype=np.int64)


class Items:
    """A block of benchmark items: (item, words, words of the answer) of each, and the words by which they are found."""

    def __init__(self, rows: list[tuple], idf: np.ndarray) -> None:
        self.rows = rows
        words, answers = [r[1] for r in rows], [r[2] for r in rows]
        self.vocabulary = Vocabulary(np.concatenate([np.zeros(0, np.uint64), *words, *answers]))
        self.words, self.answers = Bits(self.vocabulary, words), Bits(self.vocabulary, answers)
        self.size = self.words.sizes
        self.reach = REACH * self.size
        self.hits = np.minimum(HITS, at_least(LIKELY, self.size))
        #: Items that count as found only where they are a whole document.
        self.short = np.flatnonzero(self.size < LEAST_WORDS)
        rare: list[np.ndarray] = []
        for k, own in enumerate(words):
            most = int(self.size[k] - at_least(LIKELY, self.size[k]) + self.hits[k]) if self.size[k] >= LEAST_WORDS else 0
            rare.append(np.unique(own[np.argsort(-idf[cell(own)], kind="stable")[:most]]))
        item = np.repeat(np.arange(len(rows)), [len(x) for x in rare])
        row = np.searchsorted(self.vocabulary.hashes, np.concatenate([np.zeros(0, np.uint64), *rare]))
        self.items_of_row = item[np.argsort(row, kind="stable")]
        self.row_bounds = np.searchsorted(np.sort(row), np.arange(len(self.vocabulary) + 1))

    def by_rare_words(self, at: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, least start, last start) of the stretches that have enough of an item's rare words, each start once."""
        count = self.row_bounds[row + 1] - self.row_bounds[row]
        item = self.items_of_row[spans(self.row_bounds[row], count)]
        order = np.lexsort((place := np.repeat(at, count), item))
        item, place = item[order], place[order]
        doc = np.searchsorted(first, place, side="right") - 1
        last = np.arange(len(item)) + self.hits[item] - 1
        inside = np.minimum(last, len(item) - 1)
        near = np.flatnonzero((last < len(item)) & (item[inside] == item) & (doc[inside] == doc) & (place[inside] - place < self.reach[item])) if len(item) else np.zeros(0, np.int64)
        item, low, high = item[near], np.maximum(place[inside[near]] - self.reach[item[near]] + 1, first[doc[near]]), place[near]
        if len(item) > 1:  # both ends rise within a document, and documents follow each other
            low[1:] = np.where(item[1:] == item[:-1], np.maximum(low[1:], high[:-1] + 1), low[1:])
        return item, low, high

    def check(self, rows: np.ndarray, first: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, start, share) of the stretches from low[i] to high[i] in which the item is found."""
        some = high >= low
        item, start = np.repeat(item[some], (high - low + 1)[some]), spans(low[some], (high - low + 1)[some])
        own = np.flatnonzero(self.words.holds(item, rows[start]))  # an earlier start reaches no further than the first word that fits
        item, start = item[own], start[own]
        end = first[np.searchsorted(first, start, side="right")]
        length = self.words.common(rows, item, start, np.minimum(start + self.reach[item], end))
        good = length >= at_least(SURE, self.size[item])
        maybe = np.flatnonzero((length >= at_least(LIKELY, self.size[item])) & ~good)
        answer = self.answers.sizes[item[maybe]]
        stop = np.minimum(start[maybe] + self.reach[item[maybe]] + answer, end[maybe])
        good[maybe] = self.answers.common(rows, item[maybe], start[maybe], stop) >= at_least(ANSWER, answer)
        return item[good], start[good], length[good] / self.size[item[good]]

    def whole(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) where a short item is all that the document says."""
        size = np.diff(first)
        return [(int(d), k) for k in self.short.tolist() if self.size[k] for d in np.flatnonzero(size == self.size[k]).tolist() if (hashes[first[d] : first[d + 1]] == self.rows[k][1]).all()]


class Space:
    """A latent space for some of the items."""

    def __init__(self, items: Items, own: np.ndarray, idf: np.ndarray) -> None:
        self.own, self.idf = own, idf
        self.texts = [items.rows[k][1] for k in own.tolist()]
        self.vocabulary = Vocabulary(np.concatenate(self.texts))
        self.weights = idf[cell(self.vocabulary.hashes)]
        self.basis = np.zeros((len(self.vocabulary), 0), np.float32)

    def gram_times(self, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float]:
        """((A^T A) right, trace of A^T A) for the unit TF-IDF rows A of the passages hashes[starts[i]:starts[i] + sizes[i]]."""
        out, trace = np.zeros(right.shape, np.float32), 0.0
        if not len(starts):
            return out, trace
        at, row = self.vocabulary.places(hashes)
        owner = np.searchsorted(starts, at, side="right") - 1
        norm = np.sqrt(np.add.reduceat(self.idf[cell(hashes)] ** 2, starts))
        value = self.weights[row] / np.maximum(norm[owner], 1e-6)
        for lo in range(0, len(starts), 2048):
            k = slice(*np.searchsorted(owner, [lo, lo + 2048]))
            rows, inner = min(2048, len(starts) - lo), np.unique(row[k], return_inverse=True)
            dense = np.bincount((owner[k] - lo) * len(inner[0]) + inner[1], value[k], rows * len(inner[0])).reshape(rows, -1).astype(np.float32)
            out[inner[0]] += dense.T @ (dense @ right[inner[0]])
            trace += float((dense**2).sum())
        return out, trace

    def of_items(self, right: np.ndarray) -> tuple[np.ndarray, float]:
        sizes = np.array([len(x) for x in self.texts], np.int64)
        return self.gram_times(np.concatenate(self.texts), np.cumsum(sizes) - sizes, sizes, right)

    def item_vectors(self) -> np.ndarray:
        """Unit TF-IDF vectors of the items, items by words."""
        out = np.zeros((len(self.texts), len(self.vocabulary)), np.float32)
        for k, words in enumerate(self.texts):
            _, row = self.vocabulary.places(words)
            np.add.at(out[k], row, self.weights[row])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)

    def finish(self, vectors: np.ndarray) -> None:
        """Keep orthonormal vectors, and as many more as let every item keep ENERGY of its own."""
        whole = self.item_vectors()
        kept = ((whole @ vectors) ** 2).sum(axis=1)
        poor = whole[kept < ENERGY]
        if len(poor):
            more = (poor - (poor @ vectors) @ vectors.T).T
            vectors = np.hstack([vectors, np.linalg.qr(more)[0]]).astype(np.float32)
        latent = whole @ vectors
        self.energy = (latent**2).sum(axis=1)
        self.basis = np.vstack([vectors * self.weights[:, None], np.zeros((1, vectors.shape[1]))]).astype(np.float32)
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-6)).astype(np.float32)
        sizes = np.array([len(x) for x in self.texts])
        self.scales, low, size = {}, 0, WINDOW
        while low < sizes.max(initial=0):
            own = np.flatnonzero((sizes > low) & (sizes <= size))
            if len(own):
                self.scales[size] = own
            low, size = size, 2 * size

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, begin, end) of the windows of the documents that are near an item; begin is no more than _STEP words off."""
        found = [(np.zeros(0, np.int64),) * 3]
        n_steps = -(-np.diff(first) // _STEP)
        before = np.append(0, np.cumsum(n_steps))
        starts = np.repeat(first[:-1], n_steps) + spans(np.zeros(len(n_steps), np.int64), n_steps) * _STEP
        stops = np.minimum(starts + _STEP, np.repeat(first[1:], n_steps))
        if not len(starts):
            return found[0]
        at, row = self.vocabulary.places(hashes)
        energy = self.idf[cell(hashes)] ** 2
        own = np.zeros(len(hashes), np.float32)
        own[at] = energy[at]
        all_before, own_before = (np.append(0, np.cumsum(np.add.reduceat(x, starts), dtype=np.float64)) for x in (energy, own))
        near, used = {}, np.zeros(len(starts) + 1, np.int64)
        for size in self.scales:
            block = size // 2 // _STEP
            n = np.maximum(1, -(-n_steps // block) - 1) * (n_steps > 0)
            begin = np.repeat(before[:-1], n) + spans(np.zeros(len(n), np.int64), n) * block
            end = np.minimum(begin + 2 * block, np.repeat(before[1:], n))
            some = own_before[end] - own_before[begin] >= MIN_SHARE * (all_before[end] - all_before[begin])
            near[size] = begin[some], end[some]
            np.add.at(used, begin[some], 1)
            np.add.at(used, end[some], -1)
        used = np.cumsum(used)[:-1] > 0
        rows = np.full(len(hashes) + _STEP, len(self.vocabulary))  # the last row of the basis is zero
        rows[at] = row
        steps = np.flatnonzero(used)
        vectors = np.zeros((len(steps) + 1, self.basis.shape[1]), np.float32)
        for k in range(_STEP):
            vectors[:-1] += self.basis[np.where(starts[steps] + k < stops[steps], rows[starts[steps] + k], len(self.vocabulary))]
        place = np.full(len(starts) + 1, len(steps))
        place[steps] = np.arange(len(steps))
        for size, (begin, end) in near.items():
            items = self.scales[size]
            for lo in range(0, len(begin), 4096):
                b, e = begin[lo : lo + 4096], end[lo : lo + 4096]
                vector = np.zeros((len(b), vectors.shape[1]), np.float32)
                for k in range(size // _STEP):
                    vector += vectors[np.where(b + k < e, place[np.minimum(b + k, len(starts))], len(steps))]
                vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-6)
                w, i = np.nonzero(vector @ self.latent[items].T >= MIN_COSINE)
                found.append((self.own[items[i]], starts[b[w]], stops[e[w] - 1]))
        return tuple(np.concatenate(x) for x in zip(*found))


def matches(items: Items, spaces: list[Space], column: pa.Array) -> dict[tuple[int, int], float]:
    """{(row, number of the item): share} of the items found in the texts of a batch."""
    hashes, first = tokens(column)
    out = {(doc, k): 1.0 for doc, k in items.whole(hashes, first)}
    at, row = items.vocabulary.places(hashes)
    rows = np.full(len(hashes), len(items.vocabulary))
    rows[at] = row
    tried = [items.by_rare_words(at, row, first)]
    for space in spaces:
        item, begin, end = space.candidates(hashes, first)
        doc = np.searchsorted(first, begin, side="right") - 1
        low, high = np.maximum(begin - items.size[item], first[doc]), end - 1
        stop = np.minimum(end + items.reach[item], first[doc + 1])
        # A stretch with enough words in order has at least as many words that items know.
        some = np.flatnonzero(np.searchsorted(at, stop) - np.searchsorted(at, low) >= at_least(LIKELY, items.size[item]))
        some = some[np.lexsort((low[some], item[some]))]
        item, low, high = item[some], low[some], high[some]
        if len(item) > 1:  # windows overlap: each start once
            reach = np.maximum.accumulate(high + item * (len(hashes) + 1)) - item * (len(hashes) + 1)
            low[1:] = np.where(item[1:] == item[:-1], np.maximum(low[1:], reach[:-1] + 1), low[1:])
        tried.append((item, low, high))
    for candidates in tried:
        item, start, share = items.check(rows, first, *candidates)
        doc = np.searchsorted(first, start, side="right") - 1
        for key, value in zip(zip(doc.tolist(), item.tolist()), share.tolist()):
            out[key] = max(out.get(key, 0.0), value)
    return out


def by_frequency(vocabulary: Vocabulary, idf: np.ndarray) -> np.ndarray:
    """The place of each word in a table of pairs: frequent ones stand together, so that most sums stay in the cache."""
    out = np.empty(len(vocabulary), np.int64)
    out[np.argsort(idf[cell(vocabulary.hashes)], kind="stable")] = np.arange(len(vocabulary))
    return out


def add_pairs(flat: np.ndarray, vocabulary: Vocabulary, idf: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> None:
    """Add T to flat, where T + T^T is A^T A for the unit TF-IDF rows A of the passages of a batch, words by_frequency().

    T has nothing above its diagonal: flat has the rows below, row k of k + 1 numbers.
    """
    starts, sizes = passages_of(first)
    if not len(starts):
        return
    at, row = vocabulary.places(hashes)
    all_owners = np.repeat(np.arange(len(starts)), sizes)[at]
    norm = np.sqrt(np.add.reduceat(idf[cell(hashes)] ** 2, starts))
    values = idf[cell(vocabulary.hashes)][row] / np.maximum(norm[all_owners], 1e-6)
    rows = by_frequency(vocabulary, idf)[row]
    ends = np.append(np.searchsorted(all_owners, np.arange(PAIR_PASSAGES, len(starts), PAIR_PASSAGES)), len(rows))
    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
        owner, value, row = all_owners[lo:hi], values[lo:hi], rows[lo:hi]
        np.add.at(flat, row * (row + 3) // 2, value**2 / 2)
        for apart in range(1, min(PASSAGE, len(row))):
            same = owner[apart:] == owner[:-apart]
            if not same.any():
                break
            one, other = row[:-apart][same], row[apart:][same]
            high = np.maximum(one, other)
            np.add.at(flat, high * (high + 1) // 2 + np.minimum(one, other), (value[:-apart] * value[apart:])[same])


def corpus_products(docs: DataFrame, spaces: list[Space], right: list[np.ndarray], idf: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """((A^T A) right, trace of A^T A) of each space for the passages of all docs, in one pass."""
    hashes = np.unique(np.concatenate([s.vocabulary.hashes for s in spaces]))
    words = Vocabulary(hashes) if len(hashes) <= PAIR_WORDS else None
    shared = docs.sparkSession.sparkContext.broadcast((spaces, right, words, idf))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, factors, words, idf = shared.value
        total, traces = [np.zeros(x.shape, np.float32) for x in factors], np.zeros(len(own))
        pairs = np.zeros(len(words) * (len(words) + 1) // 2, np.float32) if words else None
        for batch in pieces(batches, 0):
            hashes, first = tokens(batch.column(0))
            if words:
                add_pairs(pairs, words, idf, hashes, first)
                continue
            for k, space in enumerate(own):
                product, trace = space.gram_times(hashes, *passages_of(first), factors[k])
                total[k] += product
                traces[k] += trace
        for k, space in enumerate(own):
            if words:
                at = by_frequency(words, idf)[np.searchsorted(words.hashes, space.vocabulary.hashes)]
                traces[k] = 2 * pairs[at * (at + 3) // 2].sum(dtype=np.float64)
                for lo in range(0, len(at), PRODUCT_ROWS):
                    own_rows = at[lo : lo + PRODUCT_ROWS, None]
                    high = np.maximum(own_rows, at)
                    part = pairs[high * (high + 1) // 2 + np.minimum(own_rows, at)]
                    total[k][lo : lo + PRODUCT_ROWS] = (part * np.where(own_rows == at, 2, 1).astype(np.float32)) @ factors[k]
            for block, lo in enumerate(range(0, len(total[k]), PRODUCT_ROWS)):
                row = [[k], [block], [total[k][lo : lo + PRODUCT_ROWS].tobytes()], [traces[k] if not block else 0.0]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.float64()))], names=["space", "block", "part", "trace"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                now = sums.setdefault((r["space"], r["block"]), [0.0, 0.0])
                now[0], now[1] = now[0] + np.frombuffer(r["part"], np.float32).astype(np.float64), now[1] + r["trace"]
        for (k, block), (part, trace) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([trace])], names=["space", "block", "part", "trace"])

    schema = "space int, block int, part binary, trace double"
    out, trace = [np.zeros(x.shape) for x in right], np.zeros(len(spaces))
    for row in spread(docs.select("text")).mapInArrow(multiply, schema).repartition("space", "block").mapInArrow(add, schema).toLocalIterator():
        lo = row["block"] * PRODUCT_ROWS
        own = out[row["space"]][lo : lo + PRODUCT_ROWS]
        own += np.frombuffer(row["part"]).reshape(own.shape)
        trace[row["space"]] += row["trace"]
    shared.destroy()
    return out, trace


def fit(docs: DataFrame, rows: list[tuple], idf: np.ndarray) -> tuple[Items, list[Space]]:
    """Items, and spaces for them: singular vectors of the items and of the passages of all documents.

    One product of the Gram matrix with a basis of the items and of random directions is made, in one pass over docs;
    its singular vectors come from that by Nystrom's method.
    """
    items = Items(rows, idf)
    long = np.flatnonzero(items.size >= LEAST_WORDS)
    spaces = [Space(items, long[at : at + SPACE], idf) for at in range(0, len(long), SPACE)]
    if not spaces:
        return items, spaces
    random = np.random.default_rng(2)
    right = []
    for space in spaces:
        wide = min(max(RANK, len(space.own)) + EXTRA, len(space.vocabulary))
        start = np.hstack([space.item_vectors().T, random.standard_normal((len(space.vocabulary), wide))])
        right.append(np.linalg.qr(start[:, :wide])[0].astype(np.float32))
    corpus, trace = corpus_products(docs, spaces, right, idf)
    for k, space in enumerate(spaces):
        of_items, own = space.of_items(right[k])
        product = BENCHMARK_SHARE / max(own, 1e-9) * of_items + (1 - BENCHMARK_SHARE) / max(trace[k], 1e-9) * corpus[k]
        product += 1e-6 * max(1e-9, np.linalg.norm(product)) * right[k]
        value, turn = np.linalg.eigh((right[k].T @ product + product.T @ right[k]) / 2)
        factor = product @ (turn / np.sqrt(np.maximum(value, 1e-7 * value[-1])))
        space.finish(np.linalg.svd(factor, full_matrices=False)[0][:, :RANK].astype(np.float32))
    return items, spaces


def item_words(rows: list[tuple]) -> list[tuple]:
    """(item, words, answer) of rows (item, text, answer or None); without an answer the last ANSWER_WORDS words stand for it."""
    out = []
    for item, text, answer in rows:
        words, own = tokens(pa.array([text or ""]))[0], tokens(pa.array([answer or ""]))[0]
        out.append((item, words, own if len(own) else words[-ANSWER_WORDS:]))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Items of the benchmark in blocks of bounded size."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text", answer.alias("answer"))
    blocks = max(1, -(-rows.count() // PASS_ITEMS))
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        found = item_words(sorted(((r["item_id"], r["text"], r["answer"]) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
        if any(len(words) for _, words, _ in found):
            yield found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, contaminated) for every benchmark item found in a row of docs(doc_id, text).

    share is that of the item's words that a stretch of the document has in order. Null and empty texts match
    nothing, nor do items without words; items of fewer than LEAST_WORDS words are found where they are a whole document.
    A null doc_id or item_id is returned as null; equal texts get equal rows; items with one text are all found; other
    columns are not read. benchmark(item_id, text) may have a column `answer`. An empty table of either gives no rows.
    Each PASS_ITEMS items are two more passes over docs, one to fit their spaces and one to search.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, share double, contaminated boolean"
    out, idf = docs.sparkSession.createDataFrame([], schema), None
    for rows in _blocks(benchmark):
        idf = inverse_frequencies(docs) if idf is None else idf
        shared = docs.sparkSession.sparkContext.broadcast(fit(docs, rows, idf))

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            items, spaces = shared.value
            found = sorted(matches(items, spaces, batch.column(1)).items())
            row = batch.column(0).take(pa.array([k[0] for k, _ in found], pa.int64()))
            names = pa.array([items.rows[k[1]][0] for k, _ in found], pa.int64())
            return pa.RecordBatch.from_arrays([row, names, pa.array([v for _, v in found], pa.float64()), pa.array([True] * len(found), pa.bool_())], names=["doc_id", "item_id", "share", "contaminated"])

        out = out.unionByName(map_batches(spread(docs), run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in whose text no benchmark item is found.

    Rows with a null or empty text stay; repeated rows and null ids are judged like any others; with an empty benchmark
    all rows stay; an empty table gives no rows.
    """
    out, place, idf = spread(docs), docs.columns.index("text"), None
    for rows in _blocks(benchmark):
        idf = inverse_frequencies(docs) if idf is None else idf
        shared = docs.sparkSession.sparkContext.broadcast(fit(docs, rows, idf))

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            bad = {row for row, _ in matches(*shared.value, batch.column(place))}
            return batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(lambda batches, run=run: (run(b) for b in pieces(batches, place)), docs.schema)
    return out


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, share and contaminated for every item of benchmark in every whole text of documents; see contaminated()."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
