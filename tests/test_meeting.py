import pytest
from pyspark.sql import functions as F

from graphloom.plans import catalogue, patterns


@pytest.mark.parametrize("held", [7, 1000])
def test_every_pair_meets_once(spark, monkeypatch, held):
    for name, value in {"PAIRS": 50, "LEFT": 4, "RIGHT": 3, "HELD": held}.items():
        monkeypatch.setattr(patterns, name, value)
    left = [(f"k{n % 3}" if n % 10 else None, n % 7 and n) for n in range(60)]
    right = [(f"k{n % 4}" if n % 11 else None, n if n % 5 else None, f"v{n}") for n in range(50)]
    rows = patterns.meeting(spark.createDataFrame(left, "k string, l long"), spark.createDataFrame(right, "k string, r long, v string"), "k")
    got = [(x["k"], a["l"], r, v) for x in rows.collect() for a in x["ls"] for r, v in zip(x["r"], x["v"], strict=True)]
    assert sorted(got, key=repr) == sorted(((k, a, r, v) for k, a in left for k2, r, v in right if k is not None and k == k2), key=repr)


def test_a_hot_message_goes_to_several_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(patterns, "PAIRS", 10_000, raising=False)
    e = spark.range(1200).select(F.col("id").alias("event_id"), (F.col("id") % 600).alias("user_id"), F.when(F.col("id") % 2 == 0, "purchase").otherwise("view").alias("event_type"), F.lit("m").alias("props"))
    e.unionByName(spark.sql("SELECT 1L AS event_id, CAST(NULL AS LONG) AS user_id, 'view' AS event_type, 'm' AS props UNION ALL SELECT 2L, 5L, 'view', NULL")).write.parquet(f"{tmp_path}/events.parquet")
    rows = catalogue.QUERIES["bus_hop_pairs"](spark, str(tmp_path))
    by_task = rows.groupBy(F.spark_partition_id()).count().collect()
    assert sum(x[1] for x in by_task) == 300 * 301 == rows.distinct().count()
    assert len(by_task) > 1 and max(x[1] for x in by_task) < 300 * 301
