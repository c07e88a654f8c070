"""Substring dedup by recompression: word windows that stand in a document with a smaller id are removed.

Texts are sequences of symbols, first their words. Each round names, in Spark, the runs of one symbol and the pairs of neighbouring
symbols that texts hold: which neighbours pair follows from a digest of the two symbols alone (a left one before a right one), and
each distinct run or pair is named, over all chunks, by the first place that has it, so equal substrings get equal symbols inside
and names are exact, not digests. For each symbol the words on which its making depends are known (a text's edge lies outside). Only what stands
in two documents gets a name: a window inside which anything without a name was made stands in one document alone, is dead, and
symbols in no live window leave the rounds.

After the rounds every live window goes by the symbol of the highest round made inside it; neighbouring windows that go by the same
one are a group with the text of all their words. Groups under one symbol with equal words are removed in all documents but the
first; where the words under a symbol differ, the windows of one group of each kind are compared one by one, word for word. Windows
inside which no symbol was made are compared whole. So every removal rests on equal words.

Documents are dealt into chunks of bounded size that hold their words as codes; a round sends each distinct run or pair of a chunk
once, so a hot one costs one row a chunk. Whole copies of a text need no rounds: they lose all that a window covers. All other steps
are aggregations, which combine before an exchange, and joins whose hot keys are dealt over several tasks.

Defined cases: null text has no words; documents shorter than a window lose nothing and give nothing; rows with a null doc_id lose
nothing and give nothing; rows with equal doc_id give nothing to each other; repeated rows are all returned; a window that
repeats inside one document alone stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import partial
from itertools import chain, compress, count, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import mix
from ._common import cut as _cut
from ._common import discard, spread_join

#: Each step's shuffle files are deleted when its table is written: together they take several times the input.
cut = partial(_cut, free=True)

#: Rounds of pair naming, and those of them that name runs of one symbol too.
ROUNDS, RUN_ROUNDS = 5, (0, 3)
#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK = 4 << 20
#: Places of a chunk's list of words, runs or pairs, and chunks of a partition, that names have room for.
PLACES, CHUNKS = 1 << 24, 1 << 16
#: Chunks in a row group of their tables: as many a reader holds.
HELD = 4
#: Rows and bytes of words in a batch of groups.
BATCH_ROWS, BATCH = 2048, 4 << 20
#: Bits of the filter of first documents; 32768 of them are one value of the built-in bitmap aggregate.
FILTER_BITS = 1 << 26
FAR = 1 << 30
PRODUCTION = ("left", "left_n", "right", "right_n")
STATE = "chunk long, docs array<long>, first binary, ref binary, step binary, size binary, low binary, high binary, live binary, made int, left array<long>, left_n array<int>, right array<long>, right_n array<int>, twice array<boolean>"


def press(x: np.ndarray) -> pa.Array:
    """One binary cell of an array's compressed bytes."""
    return pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes())])


def unpress(cell: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), kind)


def room(n: int, most: int = PLACES) -> None:
    if n > most:
        raise ValueError(f"{n} entries where names have room for {most}")


def chunks(docs: DataFrame, window: int) -> DataFrame:
    """(chunk, docs, rows, first, codes, words, twice): the words of texts of at least ``window`` words as codes of the chunk's
    distinct ``words``, with which of them stand in two of its documents."""

    def run(batches):
        held, size = [], 0

        def out():
            code = defaultdict(count().__next__)
            ids = np.array([h[0] for h in held], np.int64)
            first = np.cumsum([0, *(len(h[2]) for h in held)])
            codes = np.fromiter(map(code.__getitem__, chain.from_iterable(h[2] for h in held)), np.int32, int(first[-1]))
            room(len(code))
            own = np.repeat(ids, np.diff(first))
            least, most = np.full(len(code), 1 << 62), np.full(len(code), -(1 << 62))
            np.minimum.at(least, codes, own)
            np.maximum.at(most, codes, own)
            columns = [
                pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([[h[1] for h in held]], pa.list_(pa.int64())), pa.array([first.astype(np.int64).tobytes()]), press(codes),
                pa.array([list(code)], pa.list_(pa.binary())), pa.array([least < most], pa.list_(pa.bool_())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["docs", "rows", "first", "codes", "words", "twice"])

        for batch in batches:
            for doc_id, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words = text.as_py().split()
                if len(words) < window:
                    continue
                held.append((doc_id, row, words))
                size += len(text.as_py())
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    made = docs.select("doc_id", "row", "text").mapInArrow(run, "docs array<long>, rows array<long>, first binary, codes binary, words array<binary>, twice array<boolean>")
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return cut(made.withColumn("chunk", F.spark_partition_id().cast("long") * CHUNKS + F.when(number < CHUNKS, number).otherwise(F.raise_error(F.lit("too many chunks in a partition")))), rows=HELD)


def named(table: DataFrame, keys: list[str], round_: int) -> DataFrame:
    """(chunk, at, name): the names of the chunks' words, runs or pairs that stand in two documents, with their places in its list. A
    name is the least place that has the word, run or pair, so it is exact and the same when a task is run again."""
    rows = table.select("chunk", F.posexplode(F.arrays_zip(*keys, "twice")).alias("at", "p"))
    # the last bit of a place is set if the chunk itself has it in two documents; other chunks have other documents
    rows = rows.select(((F.col("chunk") * PLACES + F.col("at")) * 2 + F.col("p.twice").cast("int")).alias("place"), *[F.col(f"p.{k}").alias(k) for k in keys])
    w = Window.partitionBy(*keys)
    both = (F.count(F.lit(1)).over(w) > 1) | (F.col("place").bitwiseAND(1) == 1)
    both = rows.select("place", F.shiftright(F.min("place").over(w), 1).alias("first"), both.alias("both")).filter("both")
    # the last three bits of a name are the round
    both = both.select(F.shiftright("place", 25).alias("chunk"), F.shiftright("place", 1).bitwiseAND(PLACES - 1).cast("int").alias("at"), ((F.col("first") + 1) * 8 + round_).alias("name"))
    return both.groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("name").alias("name"))


def lookup(at: np.ndarray | None, name: np.ndarray | None, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    if at is not None:
        out[at] = name
    return out


class Symbols:
    """The symbols of a chunk: name (0: none), first word and the word after the last, and the words low to high on which their
    making depends (FAR out where a text's edge or a dropped symbol takes part); ``live`` marks the first words of live windows."""

    def __init__(self, name, start, stop, low, high, live):
        self.name, self.start, self.stop, self.low, self.high, self.live = name, start, stop, low, high, live

    def sift(self, window: int) -> None:
        """Windows inside which a nameless symbol was made die; symbols in no live window go."""
        n = len(self.live)
        dead = (self.name == 0) & (self.high - self.low < window) & (self.low >= 0)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.maximum(self.high[dead] - window + 1, 0), 1)
        np.add.at(edge, np.minimum(self.low[dead] + 1, n), -1)
        self.live &= np.cumsum(edge)[:n] == 0
        before = np.concatenate([[0], np.cumsum(self.live)])
        keep = before[self.start + 1] > before[np.maximum(self.stop - window, 0)]
        for field in ("name", "start", "stop", "low", "high"):
            setattr(self, field, getattr(self, field)[keep])

    def paired(self, first: np.ndarray, round_: int):
        """One round: (symbols, production of each or -1, productions as rows of PRODUCTION, document of each production)."""
        name, start, stop, low, high = self.name, self.start, self.stop, self.low, self.high
        n = np.ones(len(name), np.int64)
        text = np.searchsorted(first, start, "right")
        if round_ in RUN_ROUNDS and len(name):
            near = (start[1:] == stop[:-1]) & (text[1:] == text[:-1])
            head = np.ones(len(name), bool)
            head[1:] = ~near | (name[1:] != name[:-1]) | (name[1:] == 0)
            at = np.flatnonzero(head)
            n = np.diff(np.append(at, len(name)))
            tail = at + n - 1
            has_prev, has_next = np.append(False, near)[at], np.append(near, False)[tail]
            bare = name[at] == 0
            # that a run ends where it does depends on the symbols beside it
            new_low = np.where(bare, low[at], np.where(has_prev, low[at - 1], -FAR))
            new_high = np.where(bare, high[tail], np.where(has_next, high[np.minimum(tail + 1, len(name) - 1)], FAR))
            name, start, stop, low, high, text = name[at], start[at], stop[tail], new_low, new_high, text[at]
        m = len(name)
        if not m:
            return Symbols(name, start, stop, low, high, self.live), np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        near = np.append((start[1:] == stop[:-1]) & (text[1:] == text[:-1]), False)
        was = np.append(False, near[:-1])
        side = mix(name.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (n.astype(np.uint64) << np.uint64(8)) + np.uint64(round_ + 1)) & np.uint64(1)
        left, right = (side == 0) & (name != 0), (side == 1) & (name != 0)
        nxt, prv = np.minimum(np.arange(m) + 1, m - 1), np.maximum(np.arange(m) - 1, 0)
        pair = left & near & right[nxt]
        second = np.append(False, pair[:-1])
        new_low = np.where(right & ~second, np.where(was, low[prv], -FAR), low)
        new_high = np.where(left, np.where(near, high[nxt], FAR), high)
        made = pair | (n > 1) & (name != 0)
        rows = np.stack([name, n, np.where(pair, name[nxt], 0), np.where(pair, n[nxt], 0)], 1)
        keep = ~second
        stop = np.where(pair, stop[nxt], stop)
        made, rows, text = made[keep], rows[keep], text[keep]
        production = np.full(len(made), -1)
        production[made] = np.arange(int(made.sum()))
        return Symbols(name[keep], start[keep], stop[keep], new_low[keep], new_high[keep], self.live), production, rows[made], text[made] - 1


def distinct(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, number of each row among them, which of them stand in two documents), in order of a digest."""
    if not len(rows):
        return rows, np.zeros(0, np.int64), np.zeros(0, bool)
    # rows that differ under one digest may break up those of a third: then it is listed twice, which names take
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    order = np.argsort(mix((rows.view(np.uint64) * odd).sum(1, dtype=np.uint64)))
    own = rows[order]
    head = np.append(True, (own[1:] != own[:-1]).any(1))
    of = np.empty(len(rows), np.int64)
    of[order] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    return own[at], of, np.minimum.reduceat(doc[order], at) < np.maximum.reduceat(doc[order], at)


def packed(chunk: int, docs: np.ndarray, first: np.ndarray, symbols: Symbols, window: int, round_: int) -> pa.RecordBatch:
    """The state of a chunk after the symbols got their names: what the next round makes of them, and its distinct productions."""
    symbols.sift(window)
    made, production, rows, text = symbols.paired(first, round_)
    keys, of, twice = distinct(rows, docs[text])
    room(len(keys))
    ref = made.name.copy()
    ref[production >= 0] = -1 - of[production[production >= 0]]
    small = lambda x: press(x.astype(np.int32))
    lists = [pa.array([x], pa.list_(kind)) for x, kind in zip((*keys.T, twice), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()), strict=True)]
    columns = [
        pa.array([chunk]), pa.array([docs], pa.list_(pa.int64())), pa.array([first.tobytes()]), press(ref), small(np.diff(made.start, prepend=0)), small(made.stop - made.start),
        small(np.maximum(made.low - made.start, -FAR)), small(np.minimum(made.high - made.start, FAR)), press(np.packbits(made.live)), pa.array([len(keys)], pa.int32()), *lists,
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STATE.split(", ")])


def unpacked(row: dict) -> tuple[np.ndarray, Symbols]:
    """(first words of the documents, symbols) of a state row with the names of its productions."""
    first = np.frombuffer(row["first"], np.int64)
    step, size, low, high = (unpress(row[c], np.int32).astype(np.int64) for c in ("step", "size", "low", "high"))
    ref, start = unpress(row["ref"], np.int64).copy(), np.cumsum(step)
    got = lookup(row["at"], row["name"], row["made"])
    new = ref < 0
    ref[new] = got[-1 - ref[new]]
    low, high = np.where(low <= -FAR, -FAR, start + low), np.where(high >= FAR, FAR, start + high)
    live = np.unpackbits(unpress(row["live"], np.uint8), count=int(first[-1])).astype(bool)
    return first, Symbols(ref, start, start + size, low, high, live)


def listed(column: pa.Array) -> list[bytes]:
    """The values of a binary array, cut from one copy of its bytes."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = bytes(memoryview(data)[off[0] : off[-1]]) if data is not None else b""
    return [raw[a:b] for a, b in pairwise((off - off[0]).tolist())]


def plain(cell: pa.Scalar):
    """A cell's value; lists of numbers are arrays."""
    if not isinstance(cell, pa.ListScalar) or not cell.is_valid:
        return cell.as_py()
    return listed(cell.values) if pa.types.is_binary(cell.values.type) or pa.types.is_large_binary(cell.values.type) else cell.values.to_numpy(zero_copy_only=False)


def rows_of(batches, columns: list[str]):
    """The rows of Arrow batches one by one as dictionaries, so one chunk at a time is in Python's hands."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: plain(batch.column(c)[k]) for c in columns}


def open_windows(first: np.ndarray, window: int) -> np.ndarray:
    live = np.zeros(int(first[-1]), bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        live[a : max(a, b - window + 1)] = True
    return live


def recompressed(table: DataFrame, window: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The chunks' state after ``rounds`` rounds and the names (chunk, at, name) of its last productions."""

    def begin(batches):
        for row in rows_of(batches, ["chunk", "docs", "first", "codes", "at", "name", "size"]):
            first, names = np.frombuffer(row["first"], np.int64), lookup(row["at"], row["name"], row["size"])
            name = names[unpress(row["codes"], np.int32)]
            at = np.arange(len(name))
            yield packed(row["chunk"], row["docs"], first, Symbols(name, at, at + 1, at, at, open_windows(first, window)), window, 0)

    def go_on(round_):
        def run(batches):
            for row in rows_of(batches, ["chunk", "docs", "first", "ref", "step", "size", "low", "high", "live", "made", "at", "name"]):
                first, symbols = unpacked(row)
                yield packed(row["chunk"], row["docs"], first, symbols, window, round_)

        return run

    got = named(table, ["words"], 0)
    state = cut(table.select("chunk", "docs", "first", "codes", F.size("words").alias("size")).join(got, "chunk", "left").mapInArrow(begin, STATE), rows=HELD)
    for r in range(1, rounds):
        got = named(state, list(PRODUCTION), r)
        state, last = cut(state.drop(*PRODUCTION, "twice").join(got, "chunk", "left").mapInArrow(go_on(r), STATE), rows=HELD), state
        discard(last)
    return state, named(state, list(PRODUCTION), rounds)


def least(value: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The place of the least value in each range from_..to, the first of equals, by doubling blocks."""
    out, size = np.empty(len(from_), np.int64), np.frexp((to - from_ + 1).astype(np.float64))[1] - 1
    best = np.arange(len(value))
    for j in range(int(size.max()) + 1 if len(size) else 0):
        if j:
            other = best[1 << (j - 1) :]
            m = min(len(best), len(other))
            a, b = best[:m], other[:m]
            best = np.where(value[b] < value[a], b, a)
        own = size == j
        a, b = best[from_[own]], best[to[own] - (1 << j) + 1]
        out[own] = np.where(value[b] < value[a], b, a)
    return out


def anchored(symbols: Symbols, window: int) -> tuple[np.ndarray, ...]:
    """(key, first window, windows, place of the symbol in the first) of groups of neighbouring live windows that go by the same
    symbol, and the first words of live windows inside which none was made."""
    open_ = np.flatnonzero(symbols.live)
    own = np.flatnonzero((symbols.name != 0) & (symbols.low >= 0) & (symbols.high < FAR))
    name, start, low, high = symbols.name[own], symbols.start[own], symbols.low[own], symbols.high[own]
    from_, to = np.searchsorted(low, open_), np.searchsorted(high, open_ + window - 1, "right") - 1
    ok = from_ <= to
    # the highest round first, then by a digest of the name
    value = (np.uint64(7) - (name.view(np.uint64) & np.uint64(7))) << np.uint64(61) | mix(name.view(np.uint64)) >> np.uint64(3)
    at, symbol = open_[ok], least(value, from_[ok], to[ok])
    head = np.append(True, (symbol[1:] != symbol[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(head)
    return name[symbol[head]], at[head], np.diff(np.append(head, len(at))), start[symbol[head]] - at[head], open_[~ok]


def groups(table: DataFrame, window: int, rounds: int) -> DataFrame:
    """(key, place, n, words, doc_id, row, at): groups of ``n`` live windows with the text of all their words, at their first words
    ``at`` in the document; windows without a symbol are groups of one, those of equal words in a document together."""

    def run(batches):
        for row in rows_of(batches, ["docs", "rows", "words", "codes", "first", "ref", "step", "size", "low", "high", "live", "made", "at", "name"]):
            first, symbols = unpacked(row)
            symbols.sift(window)
            if not symbols.live.any():
                continue
            out, size = [], 0
            for group in found(row["words"], unpress(row["codes"], np.int32), first, symbols):
                out.append(group)
                size += len(group[3])
                if len(out) == BATCH_ROWS or size >= BATCH:
                    yield batch_of(row, out)
                    out, size = [], 0
            if out:
                yield batch_of(row, out)

    def found(words, codes, first, symbols):
        key, at, n, place, bare = anchored(symbols, window)
        text = lambda a, b: b" ".join([words[c] for c in codes[a:b].tolist()])
        own = np.searchsorted(first, at, "right") - 1
        for k, a, m, p, d in zip(key.tolist(), at.tolist(), n.tolist(), place.tolist(), own.tolist(), strict=True):
            yield k, p, m, text(a, a + m + window - 1), d, [a - int(first[d])]
        own = np.searchsorted(first, bare, "right") - 1
        for d in np.unique(own).tolist():
            alike: dict[bytes, list[int]] = {}
            for a in bare[own == d].tolist():
                alike.setdefault(text(a, a + window), []).append(a - int(first[d]))
            for t, places in alike.items():
                yield xxhash.xxh64_intdigest(t) >> 1, 0, 1, t, d, places

    def batch_of(row, out):
        part = list(zip(*out, strict=True))
        columns = [
            pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int32()), pa.array(part[3], pa.binary()).cast(pa.string()),
            pa.array([row["docs"][d] for d in part[4]], pa.int64()), pa.array([row["rows"][d] for d in part[4]], pa.int64()), pa.array(part[5], pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "place", "n", "words", "doc_id", "row", "at"])

    state, last = recompressed(table, window, rounds)
    both = table.select("chunk", "docs", "rows", "first", "codes", "words").join(state.drop(*PRODUCTION, "twice", "docs", "first").join(last, "chunk", "left"), "chunk")
    out = cut(both.mapInArrow(run, "key long, place int, n int, words string, doc_id long, row long, at array<int>"))
    discard(state)
    return out


def removed(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """(doc_id, row, at, n): n windows from each word ``at`` on that also start in a document with a smaller doc_id."""
    kind = ["key", "place", "n", "words"]
    table = chunks(docs, window)
    own = groups(table, window, rounds)
    discard(table)
    kinds = own.groupBy(*kind).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows_"))
    kinds = cut(kinds)
    keys = kinds.groupBy("key").agg(F.min("first").alias("low"), F.max("last").alias("high"), F.count(F.lit(1)).alias("kinds")).filter("low < high")
    kinds = cut(kinds.join(keys.select("key", (F.col("kinds") > 1).alias("mixed")), "key").filter("mixed or first < last").select(*kind, "first", "mixed", "rows_"))
    own = cut(spread_join(own, kinds, kind, "rows_", ["doc_id", "row"]).filter("doc_id > first or mixed").select(*kind, "doc_id", "row", "at", (F.col("doc_id") > F.col("first")).alias("gone")))

    def open_(batches):
        for batch in batches:
            for key, n, words, doc_id, row, at in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "words", "doc_id", "row", "at")), strict=True):
                ws = words.split(" ")
                m = n * len(at)
                columns = [
                    pa.array([key] * m, pa.int64()), pa.array([" ".join(ws[i : i + window]) for _ in at for i in range(n)], pa.string()),
                    pa.array([doc_id] * m, pa.int64()), pa.array([row] * m, pa.int64()), pa.array([a + i for a in at for i in range(n)], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "words", "doc_id", "row", "at"])

    # of every kind of group under a symbol, those of its first document are compared window by window
    each = cut(own.filter("not gone").select("key", "n", "words", "doc_id", "row", "at").mapInArrow(open_, "key long, words string, doc_id long, row long, at int"))
    first = cut(each.groupBy("key", "words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows_")).filter("first < last").drop("last"))
    single = spread_join(each, first, ["key", "words"], "rows_", ["doc_id", "row"]).filter("doc_id > first").select("doc_id", "row", "at", F.lit(1).alias("n"))
    return own.filter("gone").select("doc_id", "row", F.explode("at").alias("at"), "n").unionByName(single)


def bitmap_of(rows: DataFrame) -> DataFrame:
    """A bitmap of FILTER_BITS bits over (doc_id, row), in pieces: a table of bounded size."""
    bit = F.xxhash64("doc_id", "row").bitwiseAND(FILTER_BITS - 1) + 1
    return cut(rows.groupBy(F.bitmap_bucket_number(bit).alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits")))


def marked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with ``hit``: false only for rows whose (doc_id, row) is not in ``found``. The bitmap behind it has FILTER_BITS
    bits, so it can be broadcast, and rows that need no join are not shuffled."""
    bit = F.xxhash64("doc_id", "row").bitwiseAND(FILTER_BITS - 1) + 1
    place = F.bitmap_bit_position(bit)
    rows = docs.join(F.broadcast(bitmap_of(found)), F.bitmap_bucket_number(bit) == F.col("_b"), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col("_b").isNotNull() & (F.floor(byte / F.pow(F.lit(2.0), (place % 8).cast("double"))) % 2 == 1)
    return rows.select(*docs.columns, F.coalesce(hit, F.lit(False)).alias("hit"))


def dedup(docs: DataFrame, window: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row: the words that no removed window covers, joined by one space."""
    return _kept(docs, window, rounds, False)


def digests(docs: DataFrame, window: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """As ``dedup``, with the SHA-256 of the kept text in place of it."""
    return _kept(docs, window, rounds, True)


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row) of the first documents of all texts, and of the rows whose whole text stands in a document with a smaller id."""
    texts = cut(docs.filter("doc_id is not null").select("doc_id", "row", F.unhex(F.sha2("text", 256)).alias("sha")))
    firsts = cut(texts.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows_")))
    rows = cut(spread_join(texts, firsts, ["sha"], "rows_", ["doc_id", "row"]).select("doc_id", "row", (F.col("doc_id") > F.col("first")).alias("copy")))
    return rows.filter("not copy").drop("copy"), rows.filter("copy").drop("copy")


def _kept(docs: DataFrame, window: int, rounds: int, digest: bool) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    firsts, again = copies(docs)
    # a copy that the bitmap lets through is looked at like any other text
    own = marked(docs.filter("doc_id is not null"), firsts).filter("hit").drop("hit")
    gone = removed(own, window, rounds).unionByName(again.select("doc_id", "row", F.lit(0).alias("at"), F.lit(-1).alias("n")).distinct())
    gone = cut(gone.groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "n")).alias("gone")))
    last = "kept_sha256" if digest else "kept_text"

    def lay(batches):
        for batch in batches:
            size, lost, kept = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("gone"), strict=True):
                words = text.as_py().split()
                out = words
                if spans.is_valid and len(words) >= window:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at, n = (spans.values.field(c).to_numpy().astype(np.int64) for c in ("at", "n"))
                    n = np.where(n < 0, len(words) - window + 1, n)  # the whole text
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n + window - 1, -1)
                    out = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
                line = b" ".join(out)
                size.append(len(words))
                lost.append(len(words) - len(out))
                kept.append(hashlib.sha256(line).hexdigest() if digest else line.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", last])

    rows = marked(docs, gone)
    hit = rows.filter("hit").join(gone, ["doc_id", "row"], "left").select("doc_id", "text", "gone")
    plain = rows.filter("not hit").select("doc_id", "text", F.lit(None).cast(gone.schema["gone"].dataType).alias("gone"))
    return hit.unionByName(plain).mapInArrow(lay, f"doc_id long, n_words long, n_removed long, {last} string")
