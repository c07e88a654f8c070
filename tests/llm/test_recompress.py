"""What the rounds of op7 hold on disk and in memory."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from graphloom.llm import _common, recompress


def shuffle_files(spark):
    top = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for d in top for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_shuffle_files_go_with_the_write(spark):
    before, had = shuffle_files(spark), spark.conf.get(_common.FREE, None)
    table = recompress.cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(_common.FREE, None) == had and table.count() == 7


def test_readers_hold_few_chunks(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(recompress, "CHUNK", 1 << 10)
    texts = [(i, i, " ".join(f"w{rng.randrange(9999)}" for _ in range(60))) for i in range(100)]
    table = recompress.chunks(spark.createDataFrame(texts, "doc_id long, row long, text string").coalesce(1), 50)
    path = table._cut_path.removeprefix("file:")
    groups = [pq.ParquetFile(f"{path}/{f}").metadata.row_group(k).num_rows for f in os.listdir(path) if f.endswith(".parquet") for k in range(pq.ParquetFile(f"{path}/{f}").num_row_groups)]
    assert sum(groups) == table.count() > recompress.HELD and max(groups) <= recompress.HELD


def test_rows_under_one_digest_stay_apart():
    rows = np.array([[1, 1, 2, 1], [3, 1, 0, 0], [1, 1, 2, 1], [3, 1, 0, 0], [8, 2, 0, 0]])
    keys, of, twice = recompress.distinct(rows, np.array([5, 5, 5, 6, 5]))
    assert (keys[of] == rows).all() and len(keys) == 3 and twice[of].tolist() == [False, True, False, True, False]


def test_cells():
    column = pa.array([[b"x"], [b"a", b"", "\u00e9".encode()], []], pa.list_(pa.binary()))
    assert [recompress.plain(c) for c in column] == [[b"x"], [b"a", b"", "\u00e9".encode()], []]
    assert recompress.plain(pa.array([[1, 2], None], pa.list_(pa.int64()))[1]) is None
