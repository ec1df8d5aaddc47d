"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dictspark.llm import wordhash
from dictspark.llm.common import discard, materialize, pieces, spread, table, text_bytes
from dictspark.llm.components import connected_components

#: Bins of the two permutations; coordinates of a signature; its bands of ROWS coordinates each.
BINS, BANDS, ROWS = 1 << 20, 32, 5
#: Members checked against one copy of their leader's text.
SALT = 512

#: Bits of the table that sifts ids before texts are dealt out.
SIFT = 1 << 23
#: Sets outside its largest component from which a shingle is hot; then two, and LEVELS at most, must be shared.
HOT, LEVELS = 64, 3

_SIGNATURE_SCHEMA = "id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"
_PERMUTATIONS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def permutations(bins: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """(sigma, windows): windows[i] holds, for every shift, the place to which the shifted second permutation takes i."""
    if (bins, coordinates) not in _PERMUTATIONS:
        random = np.random.default_rng(97)
        sigma = random.permutation(bins).astype(np.uint32)
        pi = random.permutation(bins).astype(np.uint32)
        _PERMUTATIONS[bins, coordinates] = sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: coordinates - 1]]), coordinates)
    return _PERMUTATIONS[bins, coordinates]


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS, bins: int = BINS) -> np.ndarray:
    """Coordinate k is the least image of the set under the second permutation shifted by k places."""
    sigma, windows = permutations(bins, coordinates)
    places = sigma[(shingles & np.uint64(bins - 1)).astype(np.int64)]
    out = np.full(coordinates, bins, np.uint32)
    for at in range(0, len(places), 1024):
        np.minimum(out, windows[places[at : at + 1024]].min(axis=0), out=out)
    return out


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            raw, bounds = text_bytes(batch.column(1))
            hashes, first = wordhash.words(raw, bounds)
            n = batch.num_rows
            size, digest = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            sig = np.full((n, BANDS * ROWS), BINS, np.uint32)
            for i in range(n):
                own = wordhash.shingles(hashes[first[i] : first[i + 1]], width)
                size[i] = len(own)
                if len(own):
                    sig[i] = signature(own)
                    digest[0, i] = wordhash.mix(own).sum(dtype=np.uint64)
                    digest[1, i] = wordhash.mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
            keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
            for k in range(ROWS):
                keys = wordhash.mix(keys * np.uint64(0x9FB21C651E98DF25) + sig[:, k::ROWS][:, :BANDS])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), bands], names=["id", "n", "d1", "d2", "bands"])

    return run


def _verify(width: int, percent: int):
    """Rows by leader and salt, the leader's own first: yields the (leader, id) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, []
        for batch in pieces(batches, 1):
            raw, bounds = text_bytes(batch.column("text"))
            hashes, first = wordhash.words(raw, bounds)
            ids, leader, salt, tag = (batch.column(k).to_pylist() for k in ("id", "leader", "salt", "tag"))
            found = []
            for i in range(batch.num_rows):
                own = wordhash.shingles(hashes[first[i] : first[i + 1]], width)
                if (leader[i], salt[i]) != now:
                    now, leaders = (leader[i], salt[i]), []
                if tag[i] == 0:
                    leaders.append(own)
                    continue
                for other in leaders:
                    small, large = sorted((len(own), len(other)))
                    if small == 0 or 100 * small < percent * large:
                        continue
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (small + large - both):
                        found.append((leader[i], ids[i]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of pairs (leader, id) whose whole shingle sets have a Jaccard similarity of percent / 100 or more.

    Texts travel once for each pair; a leader's text once for every SALT members, so that a leader with many
    members is spread over many tasks.
    """
    counted = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    members = pairs.join(counted, "leader").select("id", "leader", F.lit(1).alias("tag"), F.expr("cast(pmod(xxhash64(id), salts) as int)").alias("salt"))
    heads = counted.select(F.col("leader").alias("id"), "leader", F.lit(0).alias("tag"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    rows = members.unionByName(heads).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    rows = rows.select("id", "text", "leader", "tag", "salt")
    dealt = rows.repartition(F.col("leader"), F.col("salt")).sortWithinPartitions("leader", "salt", "tag", "id")
    return dealt.mapInArrow(_verify(width, percent), "a bigint, b bigint").distinct()


def _members(width: int, text: int):
    """A row for each shingle of each set; part tells apart the texts of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            hashes, first = wordhash.words(*text_bytes(batch.column(text)))
            sets = [wordhash.shingles(hashes[a:b], width) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            size = np.array([len(own) for own in sets], np.int64)
            part = np.array([wordhash.mix(own).sum(dtype=np.uint64) for own in sets], np.uint64).view(np.int64)
            token = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            take = pa.array(np.repeat(np.arange(batch.num_rows), size))
            own = [batch.column("id").take(take), batch.column("comp").take(take), pa.array(np.repeat(part, size)), pa.array(np.repeat(size, size))]
            yield pa.RecordBatch.from_arrays([pa.array(token), *own], names=["token", "id", "comp", "part", "n"])

    return run


def prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(token, id, comp, n, at, prefix): the rarest shingles of each set, without those of a single component.

    at is the place in the set's order, prefix the size of its prefix. Similar sets share one of their prefixes, and l of
    l - 1 shingles more. The order is that of exact counts: shingles of one component, which pair nothing, come first,
    and so places are told by those that follow.
    """
    rows = materialize(docs.mapInArrow(_members(width, docs.columns.index("text")), "token bigint, id bigint, comp bigint, part bigint, n bigint"), "shingles")
    counts = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("token", "c")
    order = Window.partitionBy("id", "part").orderBy(F.desc("c"), F.desc("token"))
    least = F.expr(f"cast(ceil({percent} * n / 100) as bigint)")
    placed = rows.join(counts, "token").withColumn("at", F.col("n") - F.dense_rank().over(order)).withColumn("prefix", F.col("n") - least + 1)
    out = materialize(placed.where(f"at < prefix + {LEVELS - 1}").select("token", "id", "comp", "n", "at", "prefix"), "prefixes")
    discard(rows)
    return out


def prefix_pairs(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(leader, id) of all rows of docs(id, comp, text) in different components that may be similar enough.

    All sets are put in one order, rare shingles first. Two sets whose similarity suffices share a shingle of their
    prefixes; at the first of these, what is left of both bounds what they can still share. Pairs that fall below
    the bound are never made. Sets outside the component that has most of a shingle's sets are paired with all of its
    sets, so that a large family costs what its neighbours are. Where more than HOT sets are outside, the second and third
    shingle that similar sets must share are asked for as well, so that a shingle of many sets doesn't pair them all.
    """
    rows = prefixes(docs, width, percent)
    keyed, level, out = rows.where("at < prefix").select(F.col("token").alias("key"), "id", "comp", "n", "at", F.col("at").alias("last")), 1, None
    left = "least(x.n - x.at, y.n - y.at)"
    while keyed is not None:
        families = keyed.groupBy("key", "comp").agg(F.count("*").alias("c"))
        groups = families.groupBy("key").agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("most")).where("c > most.c")
        groups = materialize(groups.select("key", F.col("most.comp").alias("main"), (F.col("c") - F.col("most.c") > HOT).alias("hot")), "groups")
        now = groups if level == LEVELS else groups.where("not hot")
        x, y = keyed.join(now.select("key", "main"), "key").where("comp <> main").alias("x"), keyed.alias("y")
        found = y.join(x, F.expr(f"x.key = y.key and x.comp <> y.comp and (y.comp = x.main or x.comp < y.comp) and 100 * {left} >= {percent} * (x.n + y.n - {left})"))
        found = found.select(F.least("x.id", "y.id").alias("leader"), F.greatest("x.id", "y.id").alias("id")).where("leader < id")
        out = found if out is None else out.unionByName(found)
        if level == LEVELS or groups.where("hot").isEmpty():
            break
        level += 1
        more = rows.select("id", F.col("token").alias("next"), F.col("at").alias("place"), "prefix")
        wider = keyed.join(groups.where("hot").select("key"), "key").join(more, "id").where(f"place > last and place < prefix + {level - 1}")
        keyed = materialize(wider.select(F.xxhash64("key", "next").alias("key"), wider["id"], "comp", "n", "at", F.col("place").alias("last")), "prefixes")
    return out.distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text) whose doc_id is one of ids(id); most others go before texts are dealt out.

    A table of SIFT bits is broadcast, whatever the number of ids; what it lets pass by chance goes in the join.
    """
    bit = F.expr(f"pmod(xxhash64(doc_id), {SIFT})")
    bits = ids.select(F.col("id").alias("doc_id")).select(bit.alias("bit"))
    bits = bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    sifted = docs.withColumn("bit", bit).join(F.broadcast(bits), F.expr("bit div 64 = word and bit_get(bits, cast(bit % 64 as int)) = 1"), "left_semi").drop("bit")
    return sifted.join(ids.select(F.col("id").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Documents are linked whose sets of distinct width-word shingles have a Jaccard similarity of percent / 100 or
    more. Equal sets are one class from the start. Classes that share a band of the signature are candidates. First
    each is checked against the leader with which it shares most bands; the leader of a bucket is its member with
    most company in all its buckets, so that a family of copies has few. Then prefix_pairs() finds every pair in
    buckets that still hold several components, and all of these are checked. Checks use whole sets.

    Null or wordless texts are linked with nothing. Rows with a null doc_id are returned with a null component_id and
    kept. Rows that share a doc_id count as one document with several texts. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = materialize(spread(docs).mapInArrow(_signatures(width), _SIGNATURE_SCHEMA), "signatures")
    sets = ["d1", "d2", "n"]
    usable = signed.where("n > 0 and id is not null")
    classes = materialize(usable.groupBy(*sets).agg(F.min(F.struct("id", "bands")).alias("r")).select(*sets, "r.*"), "classes")

    rows = classes.select(F.explode("bands").alias("key"), "id")
    shared = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("key", "c")
    buckets = materialize(rows.join(shared.hint("merge"), "key"), "buckets")
    company = buckets.groupBy("id").agg(F.sum("c").alias("company"))
    leaders = buckets.join(company, "id").groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("m"))).alias("r")).select("key", (-F.col("r.m")).alias("leader"))
    shares = buckets.select("key", "id").join(leaders, "key").where("id <> leader").groupBy("id", "leader").count()
    best = materialize(shares.groupBy("id").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader")), "pairs")
    near = materialize(texts_of(docs, company), "near")
    firm = materialize(verified(near, best, width, percent), "links")
    labels = connected_components(firm)

    placed = buckets.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = placed.join(split, "key", "left_semi").select("id", "comp").distinct()
    texts = materialize(near.select(F.col("doc_id").alias("id"), "text").join(open_, "id"), "open")
    rest = materialize(prefix_pairs(texts, width, percent), "pairs")
    late = materialize(verified(near, rest, width, percent), "links")
    if not late.isEmpty():
        labels = connected_components(firm.unionByName(late))
    discard(buckets, best, near, firm, texts, rest, late)

    named = classes.select(*sets, "id").join(labels, "id", "left").select(*sets, F.coalesce("comp", "id").alias("component_id"))
    whole = signed.select("id", *sets).join(named, sets, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return whole.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those whose doc_id is not the smallest of its group.

    Rows with a null or wordless text or a null doc_id stay; rows that share a doc_id stay or go together; an empty table
    gives no rows.
    """
    gone = near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles have a similarity of 0.85 or more; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
