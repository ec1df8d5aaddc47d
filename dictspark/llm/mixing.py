"""Mixing sources: temperature weights by bisection, realised as budgeted permutations of blocks of documents.

The weight of a source is its share of all tokens to the power alpha, normalised. alpha = 1 keeps the corpus as it is,
alpha = 0 makes all sources equal; between them alpha is bisected to meet a limit on repetition or a target entropy.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dictspark.llm.common import discard, materialize, table

#: Least number of blocks into which a hash deals the documents of each source; it grows as the square root of their number.
BLOCKS = 4096
#: Sources up to which the alpha is bisected on the driver and plans are broadcast; more are summed up and joined by Spark.
SMALL = 100_000
REPETITION = 1.25
NO_SOURCE = ""


def token_count(text: Column) -> Column:
    """Words between white space; none in null and blank texts."""
    words = F.trim(F.translate(text, "\t\n\x0b\f\r", "     "))
    return F.when(F.length(words) > 0, F.size(F.split(words, " +"))).otherwise(0).cast("bigint")


def temperature(shares: list[float], alpha: float) -> list[float]:
    powers = [s**alpha if s else 0.0 for s in shares]
    return [p / sum(powers) for p in powers] if any(powers) else powers


def bisect_alpha(shares: list[float], repetition: float | None = None, entropy: float | None = None, steps: int = 60) -> float:
    """The least alpha in [0, 1] at which no weight exceeds repetition times its share, or the entropy (in nats) is at most that asked for.

    Both the greatest ratio and the entropy fall as alpha grows; where even alpha = 1 doesn't meet the target it is 1.
    """
    some = [s for s in shares if s]

    def moments(alpha: float) -> tuple[float, float]:
        return math.fsum(s**alpha for s in some), math.fsum(s**alpha * alpha * math.log(s) for s in some)

    return _bisected(moments, min(some, default=0.0), repetition, entropy, steps)


def _bisected(moments: Callable[[float], tuple[float, float]], least: float, repetition: float | None, entropy: float | None, steps: int = 60) -> float:
    """bisect_alpha() by moments: the sums of share ^ alpha and of share ^ alpha x ln(share ^ alpha); least: the least share."""

    def met(alpha: float) -> bool:
        if not least:
            return True
        powers, logs = moments(alpha)
        if repetition is not None and least ** (alpha - 1) / powers > repetition * (1 + 1e-12):  # the least share grows most
            return False
        return entropy is None or math.log(powers) - logs / powers <= entropy

    if met(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if met(middle) else (middle, high)
    return high


def _unit(*columns: Column | str) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def mixture(docs: DataFrame, budget: float = 1.0, repetition: float | None = REPETITION, entropy: float | None = None, seed: int = 5) -> DataFrame:
    """A plan with one row for each source: source, tokens, weight, alpha, quota, epochs, and where the last epoch stops.

    The quota is weight x budget x all tokens. Whole epochs read every document once; the last, partial epoch reads
    blocks in the order of a hash, then the documents of one block in the order of a hash, up to that whose middle
    passes the quota: a source misses its quota by half a document at most. No number of sources is too large.
    """
    n_blocks = max(BLOCKS, 1 << math.ceil(math.log2(max(1, docs.count())) / 2))
    source = F.coalesce("source", F.lit(NO_SOURCE))
    sized = docs.select("doc_id", source.alias("source"), token_count(F.col("text")).alias("tokens"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_blocks)).alias("block"))
    blocks = materialize(sized.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    totals = materialize(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), "totals")
    n, whole, least = totals.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)), F.min(F.when(F.col("tokens") > 0, F.col("tokens")))).first()
    share = F.col("tokens") / F.lit(float(whole or 1))
    if n <= SMALL:
        alpha = bisect_alpha([r["tokens"] / (whole or 1) for r in totals.orderBy("source").toLocalIterator()], repetition, entropy)
    else:

        def moments(alpha: float) -> tuple[float, float]:
            power = F.pow(share, F.lit(alpha))
            return tuple(totals.where("tokens > 0").agg(F.sum(power), F.sum(power * F.lit(alpha) * F.log(share))).first())

        alpha = _bisected(moments, (least or 0) / (whole or 1), repetition, entropy)
    powers = totals.where("tokens > 0").agg(F.sum(F.pow(share, F.lit(alpha)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(alpha)) / F.lit(powers)).otherwise(0.0)
    plan = totals.select("source", "tokens", weight.alias("weight"), F.lit(float(alpha)).alias("alpha"), F.lit(n_blocks).alias("blocks"))
    plan = plan.withColumn("quota", F.col("weight") * F.lit(float(budget * whole)))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + 1e-9)).otherwise(1).cast("int"))
    plan = materialize(plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("epochs") * F.col("tokens"))), "plan")

    order = Window.partitionBy("source").orderBy("key", "block")
    keyed = blocks.select("source", "block", "tokens", _unit("block", "source", F.lit(seed)).alias("key"))
    reached = keyed.withColumn("upto", F.sum("tokens").over(order)).join(_small(plan.select("source", "rest"), n), "source")
    edge = reached.where("upto > rest and upto - tokens <= rest").groupBy("source").agg(F.min(F.struct("upto", "key", "block", "tokens")).alias("e"))
    edge = edge.select("source", F.col("e.key").alias("edge_key"), F.col("e.block").alias("edge_block"), (F.col("e.upto") - F.col("e.tokens")).alias("before"))
    edged = materialize(plan.join(_small(edge, n), "source", "left"), "edges")

    inner = sized.join(_small(edged.select("source", "edge_block", "before", "rest"), n), "source").where("block = edge_block")
    inner = inner.select("source", "doc_id", "tokens", _unit("doc_id", F.lit(seed + 1)).alias("doc_key"), "before", "rest")
    inside = inner.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_key", "doc_id")) + F.col("before"))
    last = inside.where("upto - tokens / 2 <= rest").groupBy("source").agg(F.max(F.struct("doc_key", "doc_id")).alias("last"))
    names = ["source", "tokens", "weight", "alpha", "blocks", "quota", "epochs", "edge_key", "edge_block"]
    out = materialize(edged.join(last, "source", "left").select(*names, F.col("last.doc_key").alias("last_key"), F.col("last.doc_id").alias("last_id")), "mixture")
    discard(blocks, totals, plan, edged)
    return out


def _dealt(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(row, copies, key, epochs, of, weight): each row of docs as a struct, how often it is read, where it stands in an epoch."""
    id_ = F.col("doc_id").cast("bigint")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_.alias("doc_id"), F.coalesce("source", F.lit(NO_SOURCE)).alias("source"))
    found = rows.join(_small(plan, plan.count()), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    key, own = _unit("block", "source", F.lit(seed)), _unit("doc_id", F.lit(seed + 1))
    earlier = (key < F.col("edge_key")) | ((key == F.col("edge_key")) & (F.col("block") < F.col("edge_block")))
    within = (F.col("block") == F.col("edge_block")) & (F.struct(own, F.col("doc_id")) <= F.struct("last_key", "last_id"))
    partial = F.coalesce(earlier | (within & F.col("last_key").isNotNull()), F.lit(False))
    of = F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(1.0)
    return found.select("row", (F.col("epochs") + partial.cast("int")).alias("copies"), key.alias("key"), "epochs", of.alias("of"), "weight")


def mixed(docs: DataFrame, budget: float = 1.0, repetition: float | None = REPETITION, entropy: float | None = None, seed: int = 5) -> DataFrame:
    """(doc_id, source, epoch, position, weight) for every reading of a row of docs(doc_id, source, text).

    position runs from 0 to about 1 over the whole mixture: sorting by it interleaves the sources at their weights,
    block by block. A null source counts as the source ''; null and blank texts have no tokens and go with their
    block; rows that share a doc_id go together; a source without any token is read once; an empty table gives no
    rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    dealt = _dealt(docs.select("doc_id", "source"), mixture(docs, budget, repetition, entropy, seed), seed)
    read = dealt.where("copies > 0").withColumn("epoch", F.explode(F.expr("sequence(0, copies - 1)")))
    return read.select("row.doc_id", "row.source", "epoch", ((F.col("epoch") + F.col("key")) / F.col("of")).alias("position"), "weight")


def resample(docs: DataFrame, budget: float = 1.0, repetition: float | None = REPETITION, seed: int = 5) -> DataFrame:
    """The rows of docs, all columns, as often as the mixture reads them.

    Nulls, repeated ids and empty tables are treated as by mixed(); copies of a row are equal in every column.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    read = _dealt(docs, mixture(keyed, budget, repetition, None, seed), seed).where("copies > 0")
    return read.withColumn("epoch", F.explode(F.expr("sequence(0, copies - 1)"))).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of a row of documents at tempered weights: doc_id, source, epoch, position, weight; see mixed()."""
    return mixed(table(spark, sf_dir, "documents"))
