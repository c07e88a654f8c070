"""Shared plumbing of the corpus operators: table access, lineage cuts, block tables and neighbour rows."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every word definition here: space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's own setting, or (tests only) a new one."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


#: The setting under which Spark deletes the shuffle files of a write when it has ended, not when the driver next collects garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, compression: str = "zstd", free: bool = False, rows: int = 0) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again, so later steps survive a lost executor. With ``free``
    its shuffle files go at once. ``rows``, for tables of large rows: that many make a row group, and no reader holds more at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/graphloom/{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    if rows:
        writer = writer.option("parquet.block.row.count.limit", rows)
    before = spark.conf.get(FREE, None)
    if free:
        spark.conf.set(FREE, "true")
    try:
        writer.parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(FREE)
        elif free:
            spark.conf.set(FREE, before)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_._cut_path = path
    return table_


def discard(table_: DataFrame) -> None:
    """Deletes a table that ``cut`` wrote, once all that was made from it is written too."""
    spark = table_.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table_._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], size: str, by: list[str], most: int = 500, hot: int = 20_000) -> DataFrame:
    """``rows`` joined with ``few``, one row a key, whose column ``size`` says how many rows have it. A key of over ``most`` rows is
    dealt over several tasks by a digest of ``by``. The list of such keys is broadcast: at most ``hot`` of them, the largest."""
    sizes = few.select(*keys, size).filter(F.col(size) > most)
    n = sizes.count()
    while n > hot:
        most *= 4
        sizes = few.select(*keys, size).filter(F.col(size) > most)
        n = sizes.count()
    if not n:
        return rows.join(few.drop(size), keys)
    parts = F.ceil(F.col(size) / most).cast("int")
    rows = rows.join(F.broadcast(sizes.select(*keys, parts.alias("_parts"))), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    few = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > most, parts - 1).otherwise(0)))).drop(size)
    return rows.join(few, [*keys, "_part"]).drop("_part")


def words(text: str | Column) -> Column:
    """The words of a text as an array, without empty ones; null gives no words."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as keep it apart from ``columns`` (whatever the case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts_for(total_bytes: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(total_bytes / per_part))


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` ascending cut points of an integer key, from an approximate percentile sketch of all rows."""
    if n <= 1:
        return []
    at = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(key, at, 10_000).alias("b")).first()["b"]
    return sorted(set(got or []))


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """The number of cut points at or below ``key`` (null: 0), found in two steps of about sqrt(n) comparisons each."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: "array(" + ",".join(f"{x}L" if x >= 0 else f"({x}L)" for x in xs) + ")"
    heads = F.expr(longs([r[0] for r in rows]))
    body = F.expr("array(" + ",".join(longs(r) for r in rows) + ")")
    row = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(body, row), lambda b: b <= key))
    return F.when(key.isNull() | (key < F.lit(bounds[0])), F.lit(0)).otherwise((row - 1) * step + inside).cast("int")


def with_followers(df: DataFrame, key: str, columns: list[str], per_part: int, most: int = 100_000) -> DataFrame:
    """The rows of ``df`` (key, columns) with ``bucket``, ``place`` (from 1, in order of key, nulls first, then columns) and
    ``guest``: each bucket of consecutive rows also holds, as its last row with ``guest`` true, a copy of the first row of the
    next one (of the first bucket, in the last). So a row's follower stands in its own bucket, and no window goes over more."""
    low = -(1 << 63)
    n = min(most, parts_for(plan_bytes(df), per_part))
    bounds = range_bounds(df.select(key), key, n)
    rows = df.withColumn("bucket", range_bucket(F.col(key), bounds))
    # One row a bucket, at most ``most``: the first key of each and the bucket it is a guest of.
    heads = rows.groupBy("bucket").agg(F.min(F.coalesce(F.col(key), F.lit(low))).alias("_key"))
    w = Window.orderBy("bucket")
    heads = heads.select("bucket", "_key", F.lag("bucket").over(w).alias("_host"), F.max("bucket").over(Window.partitionBy()).alias("_end"))
    heads = cut(heads.select(F.col("bucket").alias("_own"), "_key", F.coalesce("_host", "_end").alias("_host")))
    first = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("_own")) & (F.coalesce(F.col(key), F.lit(low)) == F.col("_key")))
    first = first.groupBy("_own", "_host", key).agg(F.min(F.struct(*columns)).alias("_c"))
    guests = first.select(key, *[F.col(f"_c.{c}").alias(c) for c in columns], F.col("_host").alias("bucket"), F.lit(True).alias("guest"))
    both = rows.select(key, *columns, "bucket", F.lit(False).alias("guest")).unionByName(guests)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("guest", F.col(key).asc_nulls_first(), *columns)))


def plan_bytes(df: DataFrame, text: str = "text") -> int:
    """The optimizer's size of a scan: bytes of its files, without reading them. Of a table without such a size, the bytes of
    its texts are summed."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 58:
        return size
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def by_id_ranges(df: DataFrame, key: str, per_part: int, most: int = 20_000) -> tuple[DataFrame, int]:
    """``df`` with ``bucket``, ascending ranges of an integer key with about equal rows, one partition for each bucket. The
    number of buckets follows the input's bytes up to ``most``, which bounds the cut points that the driver holds."""
    n = min(most, parts_for(plan_bytes(df), per_part))
    bounds = range_bounds(df.select(key), key, n)
    return df.withColumn("bucket", range_bucket(F.col(key), bounds)).repartitionById(len(bounds) + 1, F.col("bucket")), len(bounds) + 1
