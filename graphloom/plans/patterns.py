"""Plan patterns that the operators share: ladders, ranked tables, ordered distinct, bounded loops and ordered sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/graphloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ladder(steps: list[DataFrame], seed: str, candidate: str, cap: int = 5) -> DataFrame:
    """(seed, step, outcome, candidate_count, candidates): for each seed the first step with a candidate; ``candidates`` are its
    first ``cap`` in order. Each step is a table (seed, candidate)."""
    rows = None
    for k, step in enumerate(steps):
        step = step.select(seed, candidate).distinct().withColumn("step", F.lit(k))
        rows = step if rows is None else rows.unionByName(step)
    first = rows.withColumn("_first", F.min("step").over(Window.partitionBy(seed))).filter("step = _first")
    out = first.groupBy(seed, "step").agg(F.count(F.lit(1)).alias("candidate_count"), F.slice(F.array_sort(F.collect_list(candidate)), 1, cap).alias("candidates"))
    return out.withColumn("outcome", F.when(F.col("candidate_count") == 1, F.lit("resolved")).otherwise(F.lit("ambiguous")))


def ranked_table(df: DataFrame, key: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key with ``rank``, ``total`` and ``dropped``; totals come from a pre-aggregated join, so the
    ranking alone is a window and keeps Spark's limit of rows a group."""
    total = df.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    rows = df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).filter(F.col("rank") <= cap)
    return rows.join(total, key).withColumn("dropped", F.greatest(F.lit(0).cast("long"), F.col("total") - cap))


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in ``order``: an aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def grown(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], most: int, whole: bool = False) -> DataFrame:
    """The rows reachable from ``seeds`` with their first ``hop``: each round applies ``step`` to the newest rows and keeps what
    was not there before, until nothing is new or ``most`` rounds are done; with ``whole`` the latter is an error."""
    keys = seeds.columns
    seen = settled(seeds.distinct().withColumn("hop", F.lit(0)))
    newest = seen
    for hop in range(1, most + 1):
        fresh = step(newest.select(*keys)).select(*keys).distinct().join(seen.select(*keys), keys, "left_anti")
        newest = settled(fresh.withColumn("hop", F.lit(hop)))
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    else:
        if whole:
            raise RuntimeError(f"rows are still new after {most} rounds")
    return seen


#: Of ``meeting``: pairs that one task goes through, about; rows of the left and of the right side in one array; rows of the right side
#: that one task holds of a key.
PAIRS, LEFT, RIGHT, HELD = 20_000_000, 512, 256, 32_768


def meeting(left: DataFrame, right: DataFrame, key: str, pairs: int | None = None) -> DataFrame:
    """(``key``, ls, and the columns of ``right``): the rows of both sides with an equal key; ls is an array of left rows, the right
    columns are arrays of equal length. Each pair of rows stands in one row once.

    A key's rows are dealt over a grid, so a hot key goes to many tasks and each holds ``HELD`` rows of the right side at most. Copies of
    rows are few (one of a left row for ``HELD`` right ones, one of a right row for ``HELD / 4`` left ones), pairs are not shuffled.
    Both sides follow the order of their columns: with ls exploded first, left values stand in runs and right ones repeat, so files of
    the pairs stay small."""
    left, right = left.filter(F.col(key).isNotNull()), right.filter(F.col(key).isNotNull())
    ls, rs = [c for c in left.columns if c != key], [c for c in right.columns if c != key]
    n, m = F.col("_n"), F.col("_m")
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("_m")), key)
    parts = F.greatest(F.lit(1), F.least(n, F.ceil(n * m / (pairs or PAIRS)), F.ceil(4 * n / F.least(m, F.lit(HELD)))))
    grid = settled(counts.select(key, parts.cast("int").alias("_parts"), F.ceil(m / HELD).cast("int").alias("_cells")))
    tasks = min(10_000, grid.agg(F.sum(F.col("_parts") * F.col("_cells"))).first()[0] or 1)
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    dealt = lambda own, k: F.pmod(F.xxhash64(*own), F.col(k)).cast("int")
    left = left.join(grid, key).withColumn("_part", dealt(ls, "_parts")).withColumn("_cell", each("_cells"))
    right = right.join(grid, key).withColumn("_cell", dealt(rs, "_cells"))

    def packed(rows: DataFrame, at: list[str], own: list[str], size: int, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*at).orderBy(*own)) - 1
        return rows.withColumn("_block", F.floor(place / size)).groupBy(*at, "_block").agg(F.sort_array(F.collect_list(F.struct(*own))).alias(name)).drop("_block")

    at = [key, "_cell", "_part"]
    right = packed(right, [key, "_cell"], rs, RIGHT, "rs").select(key, "_cell", *[F.col(f"rs.{c}").alias(c) for c in rs]).join(grid.select(key, "_parts"), key).withColumn("_part", each("_parts")).drop("_parts")
    left = packed(left.select(*at, *ls).repartition(tasks, *at), at, ls, LEFT, "ls")
    return left.join(right.repartition(tasks, *at).hint("shuffle_hash"), at).select(key, "ls", *rs)


def unfused(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions; generated code ends here. Two nested explodes in one piece of it would buffer all rows of
    both before the first is passed on."""
    return df.coalesce(10_000)


def ordered_sum(order: Column, value: Column) -> Column:
    """A sum of doubles in a stated order, the same on every cluster."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["v"])
