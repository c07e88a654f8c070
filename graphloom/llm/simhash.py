"""Near-duplicate groups of SimHash fingerprints through a Gray-order hierarchical index.

Fingerprints come from word shingles (XXH64, majority of each bit). The index has three trees. In each, the top nodes are the
distinct values of one of three bit blocks: two fingerprints that differ in at most two bits agree on one block, so one of the
trees holds both under one top node with no difference accumulated so far. A top node with more than ``node_rows`` codes is
factored again by three blocks of the remaining bits, and once more after that; then at most 19 bits are free, so a node's size
has a bound. Under a top node, codes are sorted by Gray rank, and every eight neighbours share an upper node that keeps the bits
all of them have (their AND and their OR). Pairs of nodes are walked from the top; a pair whose shared bits already differ in
more than ``distance`` places is dropped with all its codes. Links found are merged at once, so a node gives each code at most
one row, never all pairs. The components of these rows are then found with Spark rounds.

Defined cases: null or wordless text has fingerprint zero and links like any other; fewer words than a shingle make one shingle;
repeated rows and equal fingerprints share a component; a null doc_id is kept and is never a component's id unless all are null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER_TABLE, slices
from ._common import cut
from .components import components

FAN = 8
#: Widths of the three blocks at each factoring: of 64 bits, of the 43 left, of the 29 left.
BLOCKS = ((21, 21, 22), (15, 14, 14), (10, 10, 9))
ROWS_A_PART = 400_000


def fingerprint_batch(texts: list[str | None], shingle: int, seed: int) -> np.ndarray:
    """The 64-bit fingerprints of texts, as signed integers."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        got = shingle_hashes(text, shingle, seed)
        hashes += got
        counts[k] = len(got)
    return majority(np.array(hashes, np.uint64), counts)


def shingle_hashes(text: str | None, shingle: int, seed: int) -> list[int]:
    """The XXH64 of each word shingle of the lower-cased text, in order; of all words if they are fewer; none without words."""
    xx = xxhash.xxh64_intdigest
    ws = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()
    if not ws:
        return []
    line = b" ".join(ws)
    if len(ws) <= shingle:
        return [xx(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return [xx(line[a:b], seed) for a, b in zip(starts[: len(ws) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits set in over half of them, as signed integers; zero for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    if len(hashes):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(counts)
        sums = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(counts[full])[:-1]]), axis=0, dtype=np.int64)
        out[full] = np.packbits(sums * 2 > counts[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprint_batch(part.column("text").to_pylist(), shingle, seed))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    r = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of each (a, b); ``parent`` points every entry at its set's first entry, before and after."""
    while len(a):
        a, b = parent[a], parent[b]
        keep = a != b
        a, b = a[keep], b[keep]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def index_links(node: np.ndarray, code: np.ndarray, distance: int, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first codes of their sets) for the codes linked to an earlier one under the same top node."""
    a, b = linked(node, code, distance, chunk=chunk)
    return code[a], code[b]


def linked(node: np.ndarray, code: np.ndarray, distance: int, accept: Callable | None = None, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(places, places of the first of their sets) for the codes linked to another one under the same top node. With ``accept``,
    a function of two arrays of places, codes within ``distance`` link only where it is true."""
    size = np.unique(node, return_inverse=True, return_counts=True)
    order = np.flatnonzero(size[2][size[1]] > 1)
    if not len(order):
        return order, order
    order = order[np.lexsort((gray_rank(code[order]), node[order]))]
    node, code = node[order], code[order]
    levels = [(code, code, np.arange(len(code)), node)]  # AND, OR, first child, top node
    first_leaf = [np.arange(len(code))]
    while len(levels[-1][3]) > len(np.unique(levels[-1][3])):
        both, any_, _, top = levels[-1]
        new = np.concatenate([[True], top[1:] != top[:-1]])
        at = np.arange(len(top))
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        heads = np.flatnonzero(place % FAN == 0)
        levels.append((np.bitwise_and.reduceat(both, heads), np.bitwise_or.reduceat(any_, heads), heads, top[heads]))
        first_leaf.append(first_leaf[-1][heads])
    parent = np.arange(len(code))
    roots = np.arange(len(levels[-1][0]))
    work = [(len(levels) - 1, roots[i : i + chunk], roots[i : i + chunk]) for i in range(0, len(roots), chunk)]
    while work:
        level, i, j = work.pop()
        if level:
            low = np.minimum.reduceat(parent, first_leaf[level])
            high = np.maximum.reduceat(parent, first_leaf[level])
            open_ = (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
            i, j = i[open_], j[open_]
            heads, n = levels[level][2], len(levels[level - 1][0])
            stop = np.append(heads[1:], n)
            ni, nj = (stop - heads)[i], (stop - heads)[j]
            total = ni * nj
            pair = np.repeat(np.arange(len(i)), total)
            k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            a, b = heads[i][pair] + k // nj[pair], heads[j][pair] + k % nj[pair]
            ordered = a <= b if level > 1 else a < b
            a, b = a[ordered], b[ordered]
            both, any_ = levels[level - 1][0], levels[level - 1][1]
            apart = np.bitwise_count((both[a] & ~any_[b]) | (both[b] & ~any_[a]))
            a, b = a[apart <= distance], b[apart <= distance]
            if level == 1 and accept is None:
                parent = merge(parent, a, b)
                continue
            if level == 1:
                for s in range(0, len(a), chunk):
                    x, y = a[s : s + chunk], b[s : s + chunk]
                    open_ = parent[x] != parent[y]
                    x, y = x[open_], y[open_]
                    right = accept(order[x], order[y])
                    parent = merge(parent, x[right], y[right])
                continue
            within = np.bitwise_count((any_[a] | any_[b]) & ~(both[a] & both[b])) <= distance
            if accept is None and within.any():  # every code of both nodes is a link of every other
                for x in (a[within], b[within]):
                    stop = np.append(first_leaf[level - 1][1:], len(code))
                    count = (stop - first_leaf[level - 1])[x]
                    head = np.repeat(first_leaf[level - 1][x], count)
                    parent = merge(parent, head, head + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                parent = merge(parent, first_leaf[level - 1][a[within]], first_leaf[level - 1][b[within]])
                a, b = a[~within], b[~within]
            work += [(level - 1, a[s : s + chunk], b[s : s + chunk]) for s in range(0, len(a), chunk)]
    moved = parent != np.arange(len(code))
    return order[moved], order[parent[moved]]


def _blocks(width: int, level: int):
    """Array of (block number and value, the bits left) of ``rest``, a column of ``width`` bits."""
    out, low = [], width
    for t, w in enumerate(BLOCKS[level]):
        low -= w
        value = F.expr(f"shiftrightunsigned(rest, {low}) & {(1 << w) - 1}L")
        above = F.expr(f"shiftleft(shiftrightunsigned(rest, {low + w}), {low})") if low + w < 64 else F.lit(0)
        below = F.expr(f"rest & {(1 << low) - 1}L")
        out.append(F.struct((F.lit(t << max(BLOCKS[level])) + value).alias("node"), above.bitwiseOR(below).cast("long").alias("left")))
    return F.array(*out)


def top_nodes(codes: DataFrame, node_rows: int) -> DataFrame:
    """(node, fp): every code under its top nodes; those with more than ``node_rows`` codes are factored again."""
    current, width, done = codes.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("node")), 64, None
    for level, widths in enumerate(BLOCKS):
        bits = max(widths) + 2
        rows = current.select("fp", "node", F.explode(_blocks(width, level)).alias("x"))
        rows = rows.select("fp", F.expr(f"shiftleft(node, {bits})").bitwiseOR(F.col("x.node")).alias("node"), F.col("x.left").alias("rest"))
        width -= min(widths)
        last = level == len(BLOCKS) - 1
        full = None if last else cut(rows.groupBy("node").count().filter(F.col("count") > node_rows).select("node"))
        ready = rows if last or full.isEmpty() else rows.join(full, "node", "left_anti")
        # a node's number is unique for its level, and the level goes into its sign and top bits
        ready = ready.select((F.col("node") * 3 + level).alias("node"), "fp")
        done = ready if done is None else done.unionByName(ready)
        if last or full.isEmpty():
            return done
        current = rows.join(full, "node", "left_semi")
    return done


def groups(prints: DataFrame, distance: int = 2, node_rows: int = 200_000) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``prints`` (doc_id, fp)."""
    if not 0 <= distance <= 2:
        raise ValueError("three blocks find up to two differing bits")
    prints = cut(prints)
    codes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = max(1, -(-3 * codes.count() // ROWS_A_PART))

    def run(batches):
        got = [(b.column("node").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if not got:
            return
        node, code = (np.concatenate(x) for x in zip(*got, strict=True))
        a, b = index_links(node, code.view(np.uint64), distance)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    links = top_nodes(codes, node_rows).repartition(parts, "node").mapInArrow(run, "a long, b long")
    found = components(links)
    first = found.join(codes, found["node"] == codes["fp"]).groupBy("root").agg(F.min("first").alias("component_id"))
    named = found.join(first, "root").select(F.col("node").alias("fp"), F.col("component_id").alias("linked"))
    codes = codes.join(named, "fp", "left").select("fp", F.coalesce("linked", "first").alias("component_id"))
    return prints.join(codes, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprint as 16 lower-case hex digits, component_id the smallest doc_id reachable."""
    found = groups(fingerprints(docs, shingle, seed), distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
