"""Canonical export: families in one shape, total order, counts and digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def facts(families: list[tuple[str, DataFrame]]) -> DataFrame:
    """(family, rank, file, line, json) of all families; duplicates stay. Each table has file, line and its own columns."""
    out = None
    for rank, (name, rows) in enumerate(families):
        body = F.to_json(F.struct(F.lit(name).alias("family"), *[F.col(c) for c in rows.columns]))
        rows = rows.select(F.lit(name).alias("family"), F.lit(rank).alias("rank"), "file", "line", body.alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("rank", "file", "line", "json")


def counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """(family, facts) for every family, also those without facts."""
    spark = rows.sparkSession
    all_ = spark.createDataFrame([(n,) for n in names], "family string")
    return all_.join(rows.groupBy("family").agg(F.count(F.lit(1)).alias("n")), "family", "left").select("family", F.coalesce("n", F.lit(0)).cast("long").alias("facts"))


def digest(rows: DataFrame) -> DataFrame:
    """(files, digest): a digest of all facts in canonical order, as a tree: each file's ordered lines, then the files' digests in
    order. So no task ever holds more than one file's facts, and the root holds one short line a file."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line", "json"))), lambda r: r["json"])
    files = rows.groupBy("file").agg(F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("d"))
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("file", "d"))), lambda r: F.concat(r["d"], F.lit(" "), r["file"]))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(all_, "\n"), 256).alias("digest"))


def occurrences(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("json")
    return rows.withColumn("n", F.count(F.lit(1)).over(w))
