"""Mixing sources to target weights.

A source's share p of all tokens becomes the weight w = p**a / sum(p**a). The exponent a (an inverse temperature, 0 to 1) is
found by bisection: the flattest mixture whose entropy does not pass the target, made steeper if a source would otherwise be
read more than ``max_repeats`` times. A source's budget is its weight's part of all tokens to be read. It is realised in whole
passes and one partial pass: every pass is a permutation of the source's documents by the digest of (seed, epoch, doc_id), dealt
in blocks of leading digest bits; the partial pass is the longest prefix of its permutation within the budget. Sums over blocks
find the block in which the budget ends, and only that block is sorted.

Defined cases: tokens are words, so a null or empty text weighs nothing and is read with its source's passes; a null source is
the source ''; a null doc_id has the digest of an empty id; repeated rows stand together, in or out; sources without tokens get
weight 0 and one pass if ``cover`` is set; an empty table gives an empty result. Other columns are not read by ``schedule`` and are
carried by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, words

STEPS = 60
BLOCK_DOCS, BLOCK_BITS = 4096, 16
#: Sources that the driver holds or a join broadcasts; beyond it sums run in Spark and joins shuffle.
SMALL = 100_000


def digest(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def exponent(sources: DataFrame, budget: float | None, entropy: float, max_repeats: float) -> tuple[float, float, int]:
    """(a, sum of p**a, all tokens) over ``sources`` (source, tokens). ``budget`` None: the least that reads each document once."""
    live = sources.filter("tokens > 0")
    held = [r["tokens"] for r in live.select("tokens").limit(SMALL + 1).collect()]
    if len(held) <= SMALL:
        held.sort()
        sums = lambda a: tuple(math.fsum(f) for f in zip(*[(n, (n / total) ** a, (n / total) ** a * a * math.log2(n / total)) for n in held], strict=True))
        total, least, most = sum(held), min(held, default=0), max(held, default=0)
    else:
        total, least, most = live.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
        share = F.col("tokens") / F.lit(total)
        sums = lambda a: tuple(live.agg(F.sum("tokens"), F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * a * F.log2(share))).first())
    if not total:
        return 1.0, 1.0, 0

    def fits(a: float) -> tuple[bool, bool]:
        _, z, plogp = sums(a)
        share = least / total
        read = total * z / (most / total) ** a * (most / total) if budget is None else budget
        return math.log2(z) - plogp / z >= entropy * math.log2(max(2, count)), read * share**a / z <= max_repeats * least

    count = len(held) if len(held) <= SMALL else live.count()

    def bisect(low: float, high: float, ok) -> float:
        """The end of [low, high] at which ``ok`` still holds for all below."""
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low

    steep = 1.0 if fits(1.0)[0] else bisect(0.0, 1.0, lambda a: fits(a)[0])
    if not fits(steep)[1]:
        steep = bisect(steep, 1.0, lambda a: not fits(a)[1])
    return steep, sums(steep)[1], total


def plan(sized: DataFrame, seed: int, budget_ratio: float | None, entropy: float, max_repeats: float, cover: bool) -> DataFrame:
    """(source, passes, bits, cut_block, cut_key, cut_id) from ``sized`` (doc_id, source, n_tokens): all documents ``passes``
    times, then in the partial pass those before (cut_block, cut_key, cut_id) and itself."""
    sources = cut(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = None if budget_ratio is None else budget_ratio * total
    a, z, total = exponent(sources, budget, entropy, max_repeats)
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    if budget is None:
        most = (sources.agg(F.max("tokens")).first()[0] or 0) / max(total, 1)
        budget = total * z * most ** (1 - a)
    read = F.floor(F.lit(budget) * F.pow(share, F.lit(a)) / F.lit(z) + F.lit(1e-6))
    read = F.when(F.col("tokens") == 0, F.lit(0)).otherwise(read).cast("long")
    read = F.greatest(read, F.col("tokens")) if cover else read
    bits = F.ceil(F.log2(F.col("docs") / F.lit(float(BLOCK_DOCS))))
    plans = sources.select(
        "source", read.alias("read"), F.when(F.col("tokens") > 0, F.floor(read / F.col("tokens"))).otherwise(F.lit(int(cover))).cast("int").alias("passes"),
        F.greatest(F.lit(0), F.least(F.lit(BLOCK_BITS), bits)).cast("int").alias("bits"), "tokens",
    )
    plans = cut(plans.withColumn("rest", F.col("read") - F.col("passes") * F.col("tokens")).drop("read", "tokens"))
    docs = on_source(sized, plans, ["passes", "bits", "rest"])
    docs = docs.withColumn("key", digest(seed, F.col("passes"), F.col("doc_id"))).withColumn("block", block_of(F.col("key"), F.col("bits")))
    blocks = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("block")))
    ends = cut(blocks.filter("upto > rest").groupBy("source").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("upto") + F.col("n")).alias("left")), "block").alias("x")))
    ends = ends.select("source", F.col("x.block").alias("cut_block"), F.col("x.left").alias("left"))
    small = ends.count() <= SMALL
    inside = docs.join(F.broadcast(ends) if small else ends, "source").filter("block = cut_block")
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key", F.coalesce("doc_id", F.lit(-(1 << 63)))))
    last = inside.withColumn("upto", run).filter("upto <= left").groupBy("source").agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("x"))
    last = last.select("source", F.col("x.key").alias("cut_key"), F.col("x.id").alias("cut_id"))
    out = plans.join(ends.drop("left"), "source", "left").join(last, "source", "left")
    # no block passes the budget: all blocks are read
    out = out.withColumn("cut_block", F.coalesce("cut_block", F.lit(1 << BLOCK_BITS))).withColumn("cut_key", F.coalesce("cut_key", F.lit("")))
    return cut(out.withColumn("cut_id", F.coalesce("cut_id", F.lit(-(1 << 63)))))


def block_of(key: Column, bits: Column) -> Column:
    return F.floor(F.conv(F.substring(key, 1, BLOCK_BITS // 4), 16, 10).cast("long") / F.pow(F.lit(2.0), F.lit(BLOCK_BITS) - bits)).cast("int")


def on_source(docs: DataFrame, plans: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with its source's plan columns: one row a source, broadcast up to SMALL sources."""
    own = plans.select("source", *columns)
    return docs.join(F.broadcast(own) if own.count() <= SMALL else own, "source")


def epochs(docs: DataFrame, plans: DataFrame, seed: int) -> DataFrame:
    """``docs`` (doc_id, source, ...) once for each pass that reads it, with ``epoch`` and ``block``."""
    docs = on_source(docs, plans, ["passes", "bits", "cut_block", "cut_key", "cut_id"])
    key = digest(seed, F.col("passes"), F.col("doc_id"))
    docs = docs.withColumn("_key", key).withColumn("_block", block_of(F.col("_key"), F.col("bits")))
    upto = F.struct(F.col("_block"), F.col("_key"), F.coalesce("doc_id", F.lit(-(1 << 63)))) <= F.struct("cut_block", "cut_key", "cut_id")
    times = F.col("passes") + F.when(upto, 1).otherwise(0)
    docs = docs.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    return docs.withColumn("block", block_of(digest(seed, F.col("epoch"), F.col("doc_id")), F.col("bits"))).drop("passes", "bits", "cut_block", "cut_key", "cut_id", "_key", "_block")


def sized(docs: DataFrame) -> DataFrame:
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_of(F.col("source")).alias("source"), F.size(words(F.col("text").cast("string"))).cast("long").alias("n_tokens")))


def schedule(docs: DataFrame, seed: int = 1, budget_ratio: float | None = 1.0, entropy: float = 0.95, max_repeats: float = 4.0, cover: bool = False) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block): one row for each time a document is to be read; the order of reading is by
    epoch, block and digest. ``budget_ratio``: tokens to read, over all tokens; ``entropy``: the least entropy of the weights, over
    its greatest possible."""
    rows = sized(docs)
    return epochs(rows, plan(rows, seed, budget_ratio, entropy, max_repeats, cover), seed)


def mix(docs: DataFrame, seed: int = 1, budget_ratio: float | None = None, entropy: float = 1.0, max_repeats: float = 2.0, cover: bool = True) -> DataFrame:
    """The rows of ``docs``, each as often as its source's weight asks for. The defaults keep every document: the largest
    source is read once, and smaller ones up to ``max_repeats`` times."""
    plans = plan(sized(docs), seed, budget_ratio, entropy, max_repeats, cover)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_of(F.col("source")).alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return epochs(rows, plans, seed).select("_row.*")
