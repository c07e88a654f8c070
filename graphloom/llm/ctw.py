"""Language-model scores by context-tree weighting over byte streams.

A text's stream is its lower-cased words, a space after each, and a line feed. Each byte is eight binary decisions; the
probability of a decision mixes Krichevsky-Trofimov estimates of all context depths with the weights that context-tree weighting
gives them after training. The same job counts words for the unigram base.

Documents are dealt into blocks of bounded size. A block's distinct grams (context and byte) and word digests, with their
training counts, are sorted runs, cut into shards; a shard merges the runs of all blocks and answers each block for the keys it
sent. So nothing of the corpus is broadcast, hot words cost one entry a block, and tables grow with the distinct keys. Gram
shards hold whole subtrees (all contexts with the same two recent bytes); the nodes above them, at most 256 * 255, are summed in
Spark and broadcast. Words are told apart by 64-bit digests.

Defined cases: null or empty text is the end alone; repeated rows all count and get equal scores; a null doc_id trains and is not
held out; without training rows all decisions have probability one half and the base is log10(0.1 / 0.1); an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _ctw
from ._bytes import IS_SPACE, LOWER, mix, slices, strings, tokens, word_hashes
from ._common import cut, parts_for, plan_bytes

GRAM, WORD = 0, 1
NEWLINE, SPACE = 10, 32
SHARD_KEYS = 1_500_000
MASK = np.uint64((1 << 8 * (_ctw.DEPTH + 1)) - 1)


class Lookup:
    """Values of distinct non-zero 64-bit keys; a key that finds its slot taken goes into a smaller table of what is left."""

    ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        while len(keys):
            bits = max(4, int(len(keys) * 2 - 1).bit_length())
            odd = np.uint64(self.ODD[len(self.tables) % 3])
            slot = (keys * odd) >> np.uint64(64 - bits)
            held, value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype)
            held[slot], value[slot] = keys, values
            lost = held[slot] != keys
            # the values of those that stay must be their own
            value[slot[~lost]] = values[~lost]
            self.tables.append((odd, np.uint64(64 - bits), held, value))
            keys, values = keys[lost], values[lost]

    def get(self, keys: np.ndarray, default=0) -> np.ndarray:
        out, open_ = None, None
        for odd, shift, held, value in self.tables:
            asked = keys if open_ is None else keys[open_]
            slot = (asked * odd) >> shift
            miss = held[slot] != asked
            if out is None:
                out = value[slot]
                open_ = np.flatnonzero(miss)
            else:
                out[open_[~miss]] = value[slot[~miss]]
                open_ = open_[miss]
            if not len(open_):
                return out
        if out is None:
            return np.full(len(keys), default)
        out[open_] = default
        return out


def stream(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams of all texts, first gram of each text, digests of all words, first word of each text and one more)."""
    raw, off = strings(column)
    raw = LOWER[raw]
    starts, ends, first = tokens(raw, off)
    words = word_hashes(raw, starts, ends)
    n, texts, depth = np.diff(first), len(off) - 1, _ctw.DEPTH
    size = ends - starts
    text = np.repeat(np.arange(texts), n)
    shift = np.arange(len(starts)) + text * (depth + 1) + depth
    ink = raw[~IS_SPACE[raw]]
    out = np.full(len(ink) + len(starts) + texts * (depth + 1) + 8, NEWLINE, np.uint8)
    place = np.arange(len(ink)) + np.repeat(shift, size)
    out[place + 8] = ink
    out[np.cumsum(size) + shift + 8] = SPACE
    # eight bytes up to each place, most recent lowest
    view = np.ndarray((len(out) - 8,), ">u8", out.data, 1, (1,)).astype(np.uint64) & MASK
    length = np.zeros(texts + 1, np.int64)
    before = np.concatenate([[0], np.cumsum(size)])
    length[1:] = np.cumsum(before[first[1:]] - before[first[:-1]] + n + 1)
    use = np.ones(len(view), bool)
    heads = length[:-1] + np.arange(texts) * depth
    for k in range(depth):
        use[heads + k] = False
    return view[use], length[:-1], words, first


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[head], np.add.reduceat(c, head) if len(head) else c


def shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    own = mix(keys >> np.uint64(8) & np.uint64(0xFFFF)) if kind == GRAM else keys
    return (own >> np.uint64(33)).astype(np.int64) % shards


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def runs(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, block, kind, keys, counts): the sorted distinct keys of each block with their counts in training rows."""

    def step(batches):
        block, held = None, {GRAM: ([], []), WORD: ([], [])}

        def squeeze():
            for kind, (keys, counts) in held.items():
                if len(keys) > 1:
                    k, c = merged(keys, counts)
                    held[kind] = ([k], [c])

        def out():
            squeeze()
            for kind, (keys, counts) in held.items():
                if not keys:
                    continue
                at = shard_of(kind, keys[0], shards)
                for s in np.unique(at):
                    own = at == s
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([s], pa.int32()), "block": pa.array([block], pa.int32()), "kind": pa.array([kind], pa.int32()),
                        "keys": pa.array([keys[0][own].tobytes()], pa.binary()), "counts": pa.array([counts[0][own].astype(np.int64).tobytes()], pa.binary()),
                    })

        for batch in batches:
            for part in slices(batch):
                block = part.column("block")[0].as_py()
                apart = part.column("held_out").to_numpy(zero_copy_only=False)
                for off, text in ((False, part.column("text").filter(pa.array(~apart))), (True, part.column("text").filter(pa.array(apart)))):
                    if len(text):
                        grams, _, words, _ = stream(text)
                        for kind, keys in ((GRAM, grams), (WORD, words)):
                            k, c = np.unique(keys, return_counts=True)
                            held[kind][0].append(k)
                            held[kind][1].append(c * 0 if off else c)
                if sum(map(len, held[GRAM][0])) > 3_000_000:
                    squeeze()
        if block is not None:
            yield from out()

    return docs.mapInArrow(step, "shard int, block int, kind int, keys binary, counts binary")


def shard_rows(batches) -> dict[int, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The runs of one shard by kind: (block, keys, counts)."""
    out: dict[int, list] = {GRAM: [], WORD: []}
    for batch in batches:
        for block, kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "keys", "counts")), strict=True):
            out[kind].append((block, np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)))
    return out


def top_nodes(table: DataFrame, shards: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For depths 1 and 0, (zeros, ones, weight) by node * 256 + recent byte, and by node."""

    def step(batches):
        rows = shard_rows(batches)[GRAM]
        if rows:
            key, zero, one, below = _ctw.Tree(*merged([k for _, k, _ in rows], [c for _, _, c in rows]), 2).roots()
            yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(8)).astype(np.int64)), pa.array(zero), pa.array(one), pa.array(below)], ["node", "zero", "one", "below"])

    nodes = table.filter(f"kind = {GRAM}").repartitionById(shards, F.col("shard")).mapInArrow(step, "node long, zero double, one double, below double")
    got = nodes.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "below")]).toArrow()  # at most 255 * 256 rows
    node = got.column("node").to_numpy()
    out, rows = [], [got.column(c).to_numpy() for c in ("zero", "one", "below")]
    for size in (1 << 16, 1 << 8):
        zero, one, below = (np.bincount(node, r, size) for r in rows)
        own = _ctw.kt(zero, one)
        both = np.logaddexp(own, below)
        out.append((zero, one, np.exp(own - both)))
        node, rows = np.arange(size) >> 8, [zero, one, both - np.log(2)]
        # nodes that no gram passes add nothing above
        rows[2] = np.where(np.bincount(got.column("node").to_numpy(), minlength=1 << 16) > 0, rows[2], 0) if size == 1 << 16 else rows[2]
    return out


def answers(table: DataFrame, shards: int, top: list) -> DataFrame:
    """(block, kind, keys, values): for each run, log10 of each gram's probability as f4, or each word's training count as i8."""
    shared = table.sparkSession.sparkContext.broadcast(top)

    def step(batches):
        for kind, rows in shard_rows(batches).items():
            if not rows:
                continue
            keys, counts = merged([k for _, k, _ in rows], [c for _, _, c in rows])
            if kind == GRAM:
                tree = _ctw.Tree(keys, counts, 2)
                near = (tree.roots()[0] >> np.uint64(8)).astype(np.int64)
                (z1, o1, w1), (z0, o0, w0) = shared.value
                value = tree.predict([(z1[near], o1[near], w1[near]), (z0[near >> 8], o0[near >> 8], w0[near >> 8])]).astype(np.float32)
            else:
                value = counts
            for block, own, _ in rows:
                found = value[np.searchsorted(keys, own)]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "kind": pa.array([kind], pa.int32()), "keys": pa.array([own.tobytes()], pa.binary()), "values": pa.array([found.tobytes()], pa.binary())})

    return table.repartitionById(shards, F.col("shard")).mapInArrow(step, "block int, kind int, keys binary, values binary")


def score(docs: DataFrame, block_bytes: int = 24 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = parts_for(plan_bytes(docs), block_bytes)
    shards = max(2, math.ceil(blocks * 2_000_000 / SHARD_KEYS))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int"))
    table = cut(runs(docs.repartitionById(blocks, F.col("block")), shards))
    # the first exchange of the texts is not needed any more: let Spark's cleaner take its files
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    top = top_nodes(table, shards)

    def totals(batches):
        rows = shard_rows(batches)[WORD]
        if rows:
            _, counts = merged([k for _, k, _ in rows], [c for _, _, c in rows])
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(counts.sum())]), "v": pa.array([int((counts > 0).sum())])})

    n, v = table.filter(f"kind = {WORD}").repartitionById(shards, F.col("shard")).mapInArrow(totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    ends = docs.filter("not held_out").count()
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    low = n + 0.1 * (v + 1)
    keys = answers(table, shards, top).select("block", F.lit(0).alias("part"), "kind", "keys", "values", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text"))
    texts = docs.select("block", F.lit(1).alias("part"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("values"), "doc_id", "held_out", "text")

    def step(batches):
        held, look = {GRAM: [], WORD: []}, {}
        for batch in batches:
            is_key = batch.column("part").to_numpy() == 0
            for row in np.flatnonzero(is_key).tolist():
                kind = batch.column("kind")[row].as_py()
                held[kind].append((np.frombuffer(batch.column("keys")[row].as_py(), np.uint64), np.frombuffer(batch.column("values")[row].as_py(), np.float32 if kind == GRAM else np.int64)))
            rest = batch.slice(int(is_key.sum()))
            if not rest.num_rows:
                continue
            if not look:
                for kind, rows in held.items():
                    look[kind] = Lookup(*(np.concatenate(x) for x in zip(*rows, strict=True))) if rows else Lookup(np.zeros(0, np.uint64), np.zeros(0))
                held.clear()
            for part in slices(rest):
                grams, first, words, word = stream(part.column("text"))
                total = np.add.reduceat(look[GRAM].get(grams).astype(np.float64), first)
                count = look[WORD].get(words)
                m, text = part.num_rows, np.repeat(np.arange(part.num_rows), np.diff(word))
                base = np.bincount(text, np.log10((count + 0.1) / low), m) + math.log10((ends + 0.1) / low)
                known = np.bincount(text, count > 0, m).astype(np.int64) + (ends > 0)
                size = np.diff(np.append(first, len(grams)))
                columns = [
                    part.column("doc_id"), part.column("held_out"), pa.array(np.diff(word) + 1), pa.array(known), pa.array(np.full(m, n, np.int64)),
                    pa.array(base), pa.array(total), pa.array(size), pa.array(-total / math.log10(2) / size),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    both = keys.unionByName(texts).repartitionById(blocks, F.col("block")).sortWithinPartitions("part")
    return both.mapInArrow(step, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
