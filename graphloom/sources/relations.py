"""Code-graph relations: fixed schemas, readers, and the relations that the test tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SITE = T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType())])
DEFS = T.StructType([T.StructField(n, t) for n, t in (
    ("seq", T.LongType()), ("id", T.StringType()), ("name", T.StringType()), ("namespace", T.StringType()), ("kind", T.StringType()), ("file", T.StringType()),
    ("line", T.IntegerType()), ("end_line", T.IntegerType()), ("local", T.BooleanType()), ("methods", T.ArrayType(T.StringType())), ("also_in", T.ArrayType(SITE)),
)])
EDGES = T.StructType([T.StructField(n, t) for n, t in (
    ("seq", T.LongType()), ("kind", T.StringType()), ("from_file", T.StringType()), ("from_line", T.IntegerType()), ("to", T.StringType()), ("to_file", T.StringType()),
    ("tier", T.StringType()), ("member", T.StringType()), ("message", T.StringType()), ("evidence", T.StringType()), ("candidates", T.ArrayType(T.StringType())),
)])
ORACLE = T.StructType([T.StructField(n, t) for n, t in (
    ("file", T.StringType()), ("line", T.IntegerType()), ("target", T.StringType()), ("member", T.StringType()), ("receiverKind", T.StringType()), ("external", T.BooleanType()),
)])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON record a line; a record that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tree(spark: SparkSession, path: str, extensions: list[str], skipped: list[str]) -> DataFrame:
    """(path, text, sha256) of the source files under a folder; bytes that are no UTF-8 become U+FFFD."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = rows.filter(F.lower(F.substring_index("path", ".", -1)).isin(*extensions) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in skipped])))
    return rows.select("path", F.expr("make_valid_utf8(cast(content AS STRING))").alias("text"), F.sha2("content", 256).alias("sha256"))


def source_lines(tree: DataFrame) -> DataFrame:
    lines = tree.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select(F.col("path").alias("file"), (F.col("line") + 1).alias("line"), F.when(F.col("line") == 0, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text")).alias("text"))


class Demo:
    """The relations that the driver's tables stand for: suppliers are files, parts definitions, lineitems edges."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def files(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("n"), "s_nationkey", F.lit("/s"), "s_suppkey").alias("file"))

    def n_files(self) -> int:
        return self.table("supplier").count()

    def defs(self) -> DataFrame:
        n = self.n_files()
        p = self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("namespace"), F.col("p_type").alias("kind"), (F.col("p_partkey") % n).alias("file_id"), F.col("p_size").alias("line"), (F.col("p_size") + 5).alias("end_line"))
        return p.join(self.files(), "file_id")

    def def_sites(self) -> DataFrame:
        n = self.n_files()
        own = self.defs().select("id", "file_id", "line")
        also = own.filter("line % 10 = 0").select("id", ((F.col("file_id") + 1) % n).alias("file_id"), "line")
        return own.unionByName(also).join(self.files(), "file_id").select("id", "file", "line")

    def edges(self) -> DataFrame:
        n = self.n_files()
        to = self.files().select(F.col("file_id").alias("_to"), F.col("file").alias("to_file"))
        rows = self.table("lineitem").join(self.files(), F.col("l_suppkey") == F.col("file_id")).join(to, F.col("l_partkey") % n == F.col("_to"))
        tier = F.when(F.col("l_returnflag") == "A", F.lit("ext")).when(F.col("l_returnflag") == "R", F.lit("guess"))
        return rows.select(
            ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("seq"), F.when(F.col("l_linestatus") == "F", F.lit("uses-type")).otherwise(F.lit("uses-member")).alias("kind"),
            F.col("file").alias("from_file"), F.col("l_linenumber").alias("from_line"), F.col("l_partkey").alias("to"), "to_file", tier.alias("tier"), F.col("l_quantity").alias("quantity"),
        )
