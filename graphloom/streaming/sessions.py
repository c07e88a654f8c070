"""Session read state as a stream: the same rules as operators.sessions.read_state, kept by key between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session string, path string, read_count long, stub_count long, content string, bytes_delivered long"
STATE = "read_count long, stub_count long, content string, bytes_delivered long"


def read_states(reads: DataFrame) -> DataFrame:
    """The state after each micro-batch of every key it touched. ``reads``: session, path, content, size, ts, seq. Rows of a key
    are taken in order of (ts, seq) inside a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reads_, stubs, content, delivered = state.get if state.exists else (0, 0, None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        for new, size in zip(rows["content"], rows["size"], strict=True):
            reads_ += 1
            if new == content:
                stubs += 1
            else:
                stubs, content, delivered = 0, new, delivered + int(size)
        state.update((reads_, stubs, content, delivered))
        yield pd.DataFrame([[*key, reads_, stubs, content, delivered]], columns=["session", "path", "read_count", "stub_count", "content", "bytes_delivered"])

    return reads.groupBy("session", "path").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def first_contents(reads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first row of each content of a session within the watermark."""
    return reads.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "content"])
