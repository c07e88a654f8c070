"""Per-session read state: stubs for repeated content, first writers, roll-ups, pruning, freshness and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_state(reads: DataFrame, key: list[str], content: str, order: list[str], size: str) -> DataFrame:
    """The state after the last read of each key: reads, stubs since the content last changed, bytes delivered and the last
    content. A read of unchanged content is a stub and delivers nothing; changed content starts the stubs again."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = reads.withColumn("_same", F.coalesce(F.lag(content).over(w) == F.col(content), F.lit(False)))
    rows = rows.withColumn("_island", F.sum((~F.col("_same")).cast("int")).over(w))
    islands = rows.groupBy(*key, "_island").agg(F.count(F.lit(1)).alias("_n"), F.min(size).alias("_any"), F.min_by(size, F.struct(*order)).alias("_size"), F.max(content).alias("_content"))
    last = F.struct("_island", (F.col("_n") - 1).alias("stubs"), F.col("_content").alias("content"))
    return islands.groupBy(*key).agg(F.sum("_n").alias("read_count"), F.max(last).alias("_l"), F.sum("_size").alias("bytes_delivered")).select(*key, "read_count", F.col("_l.stubs").alias("stub_count"), F.col("_l.content").alias("content"), "bytes_delivered")


def first_writer(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """(key, name, copies): the first name under which each content was seen keeps it."""
    return rows.groupBy(*key).agg(F.min_by(name, F.struct(*order)).alias("first_" + name), F.count(F.lit(1)).alias("copies"))


def decisions(reads: DataFrame, session: str, path: str, content: str, order: list[str]) -> DataFrame:
    """Each read with its decision: stub (same path, same content), elsewhere (same content under another path) or fresh."""
    by_path = Window.partitionBy(session, path).orderBy(*order)
    by_content = Window.partitionBy(session, content).orderBy(*order)
    before = F.count(F.lit(1)).over(by_content.rowsBetween(Window.unboundedPreceding, -1))
    same = F.coalesce(F.lag(content).over(by_path) == F.col(content), F.lit(False))
    return reads.withColumn("decision", F.when(same, F.lit("stub")).when(before > 0, F.lit("elsewhere")).otherwise(F.lit("fresh")))


def pruned(state: DataFrame, last: Column, cutoff: Column) -> DataFrame:
    return state.filter(~(last < cutoff))


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or changed rows between two digest tables."""
    a, b = old.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_o")), new.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_n"))
    both = a.join(b, key, "full")
    kind = F.when(F.col("_o").isNull(), F.lit("added")).when(F.col("_n").isNull(), F.lit("removed")).when(~F.col("_a").eqNullSafe(F.col("_b")), F.lit("changed"))
    return both.select(key, kind.alias("change")).filter("change is not null")


def verdict(changes: DataFrame, records: DataFrame) -> DataFrame:
    """One row: fresh, stale with the number of changes, or unknown without any record."""
    n = changes.agg(F.count(F.lit(1)).alias("changes")).crossJoin(records.agg(F.count(F.lit(1)).alias("recorded")))
    return n.select(F.when(F.col("recorded") == 0, F.lit("unknown")).when(F.col("changes") > 0, F.lit("stale")).otherwise(F.lit("fresh")).alias("verdict"), "changes")


def scoped_merge(old: DataFrame, new: DataFrame, key: str, in_scope: Column) -> DataFrame:
    """Rows of ``new``, and of ``old`` those outside the scope whose key is not in ``new``, with where they come from."""
    carried = old.filter(~in_scope).join(new.select(key), key, "left_anti")
    return new.withColumn("origin", F.lit("new")).unionByName(carried.withColumn("origin", F.lit("carried")))


def runs(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key, run, value, length): equal neighbours collapsed."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = (~F.coalesce(F.lag(value).over(w).eqNullSafe(F.col(value)), F.lit(False))).cast("int")
    first = F.when(F.row_number().over(w) == 1, F.lit(1)).otherwise(new)
    rows = rows.withColumn("_new", first).withColumn("run", F.sum("_new").over(w))
    return rows.groupBy(*key, "run").agg(F.max(value).alias(value), F.count(F.lit(1)).alias("length"))
