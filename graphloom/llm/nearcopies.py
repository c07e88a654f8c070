"""Near copies of whole documents: a similarity of 0.8 or more of the sets of their five-word shingles.

The Gray-order index of ``simhash`` holds SimHash fingerprints of these sets. At 0.8, fingerprints of 64 bits differ in about ten
bits, so no block of bits is shared and bit blocks cannot be its top nodes. Here a top node is instead a band: three minima of
the set under three of 256 hash functions, equal in two documents with probability s^3 at a similarity of s. Each document stands
under ten top nodes, so a pair at 0.8 meets with a probability of 0.9992. Under a top node the walk is that of ``simhash``: codes
by Gray rank, upper nodes with the bits all of their codes share, pairs of groups dropped once the accumulated differences pass
``DISTANCE``. A pair left is proposed if its share of equal minima among all 256 estimates a similarity of ``PROPOSED`` or more;
the standard error of the estimate is 0.025 at 0.8, so ``PROPOSED`` stands four of them below. Proposals only choose the sets to
look at: their shingles are fetched by set_id, the walk is repeated inside each component of proposals, and pairs not yet merged
link by the exact similarity of their two sets, ``least`` or more. Equal sets are one code from the start, and found links are
merged at once, so a group of copies costs rows in its size, not pairs. Top nodes of over ``node_rows`` codes are split by ten
further bands; components of over ``GROUP_ROWS`` sets are looked at by top nodes again.

Defined cases: texts without words are copies of each other; fewer than five words make one shingle; of equal rows one
stays, of rows of one doc_id with unlike texts each is decided by its own text; rows with a null doc_id all stay; an empty table gives an empty one; other columns are passed on unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import mix, slices, tidy
from ._common import cut, parts_for, unused
from .components import components
from .simhash import linked, majority, shingle_hashes

MINIMA, BANDS, WIDTH, LEVELS = 256, 10, 3, 2
DISTANCE, PROPOSED = 22, 0.7
ROWS_A_PART, BYTES_A_PART, GROUP_ROWS, BROADCAST_ROWS = 100_000, 24 << 20, 5_000, 2_000_000
#: Odd multipliers of the hash functions.
FACTORS = (mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: list[str | None], shingle: int = 5, seed: int = 42) -> tuple[list[np.ndarray], np.ndarray]:
    """The shingle set of each text in ascending order, and its digest."""
    sets = [np.unique(np.array(shingle_hashes(t, shingle, seed), np.uint64)) for t in texts]
    return sets, np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)


def similarity(x: bytes, y: bytes) -> float:
    """Jaccard similarity of two sets stored as ascending 64-bit numbers."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if min(len(a), len(b)) == 0:
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)


def sketch(texts: list[str | None], shingle: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: a digest of its shingle set, the set's SimHash, one byte of each minimum, and the band keys."""
    sets, digest = shingle_sets(texts, shingle, seed)
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    fp = majority(hashes, counts)
    full = np.flatnonzero(counts)
    least = np.zeros((len(texts), MINIMA), np.uint32)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        low = hashes.astype(np.uint32)
        for k, factor in enumerate(FACTORS):
            least[full, k] = np.minimum.reduceat(low * factor, starts)
    keys = np.zeros((len(texts), LEVELS * BANDS), np.uint64)
    for k in range(LEVELS * BANDS):
        key = np.full(len(texts), k, np.uint64)
        for j in range(WIDTH):
            key = mix(key + least[:, k * WIDTH + j])
        keys[:, k] = key
    return digest, fp, least.astype(np.uint8), keys.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, fp, minima, bands) for each row with a doc_id; texts without words have no bands."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                digest, fp, minima, keys = sketch(part.column("text").to_pylist())
                empty = xxhash.xxh64_intdigest(b"") - (1 << 64 if xxhash.xxh64_intdigest(b"") >> 63 else 0)
                sizes = np.where(digest == empty, 0, keys.shape[1])
                bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(keys[sizes > 0].ravel()))
                columns = [part.column("doc_id"), pa.array(digest), pa.array(fp), pa.array([m.tobytes() for m in minima], pa.binary()), bands]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set_id", "fp", "minima", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    return rows.mapInArrow(tidy(run), "doc_id long, set_id long, fp long, minima binary, bands array<long>")


def top_nodes(prints: DataFrame, node_rows: int) -> DataFrame:
    """(node, set_id) for the top nodes that hold more than one set; those with over ``node_rows`` are split by the next bands."""
    done, rows = None, prints.select("set_id", F.explode(F.slice("bands", 1, BANDS)).alias("node")).distinct()
    for level in range(LEVELS):
        rows = cut(rows)
        sizes = cut(rows.groupBy("node").count().filter("count > 1"))
        last = level == LEVELS - 1
        full = sizes.filter(F.col("count") > node_rows)
        split = not last and not full.isEmpty()
        ready = rows.join(sizes.filter(F.col("count") <= node_rows) if split else sizes, "node", "left_semi").select("node", "set_id")
        done = ready if done is None else done.unionByName(ready)
        if not split:
            return done
        further = prints.select("set_id", F.slice("bands", (level + 1) * BANDS + 1, BANDS).alias("bands")).distinct()
        rows = rows.join(full, "node", "left_semi").join(further, "set_id")
        rows = rows.select("set_id", F.explode("bands").alias("band"), "node").select(F.xxhash64("node", "band").alias("node"), "set_id")
    return done


def stored_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, shingles) for the sets of ``wanted`` (set_id, doc_id), read from the texts of these documents again."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets, digest = shingle_sets(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digest), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "set_id", "shingles"])

    wanted = cut(wanted)
    ids = wanted.select("doc_id").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    rows = rows.mapInArrow(tidy(run), "doc_id long, set_id long, shingles binary")
    return rows.join(wanted, ["doc_id", "set_id"], "left_semi").select("set_id", "shingles").dropDuplicates(["set_id"])


def links(nodes: DataFrame, codes: DataFrame, sets: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """(a, b): sets linked under their nodes, merged to one row a set and node. ``codes``: (set_id, fp, minima), one row a set.
    Without ``sets`` the links are proposals; with it (set_id, shingles) they have a similarity of ``least`` or more."""

    def run(batches):
        parts = []
        for b in batches:
            shingles = b.column("shingles").to_pylist() if exact else []
            parts.append((*(b.column(c).to_numpy() for c in ("node", "set_id", "fp")), np.frombuffer(b"".join(b.column("minima").to_pylist()), np.uint8).reshape(-1, MINIMA), np.array([*shingles, None], object)[:-1]))
        if not parts:
            return
        node, ids, code, minima, shingles = (np.concatenate(x) for x in zip(*parts, strict=True))
        # bytes of unequal minima agree by chance once in 256
        need = MINIMA * (PROPOSED + (1 - PROPOSED) / 256)

        def accept(x, y):
            ok = (minima[x] == minima[y]).sum(1) >= need
            if exact:
                for k in np.flatnonzero(ok):
                    ok[k] = similarity(shingles[x[k]], shingles[y[k]]) >= least
            return ok

        a, b = linked(node, code.view(np.uint64), DISTANCE, accept)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    exact = sets is not None
    nodes = cut(nodes)
    parts = -(-nodes.count() // ROWS_A_PART)
    members = nodes.join(codes.join(nodes.select("set_id").distinct(), "set_id", "left_semi"), "set_id")
    if exact:
        parts = max(parts, parts_for(int(nodes.count() * (sets.agg(F.avg(F.octet_length("shingles"))).first()[0] or 0)), BYTES_A_PART))
        members = members.join(sets, "set_id")
    return members.repartition(max(1, parts), "node").mapInArrow(tidy(run), "a long, b long")


def grouped(docs: DataFrame, least: float, node_rows: int) -> DataFrame:
    """(doc_id, set_id, root) for each row with a doc_id: its set and the set that names its group of near copies."""
    prints = cut(sketches(docs))
    firsts = cut(prints.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")))
    heads = prints.join(firsts, ["set_id", "doc_id"], "left_semi")
    codes = heads.select("set_id", "fp", "minima").dropDuplicates(["set_id"])
    nodes = cut(top_nodes(heads, node_rows))
    proposed = cut(components(links(nodes, codes)).withColumnRenamed("node", "set_id"))
    sizes = proposed.groupBy("root").count()
    large = proposed.join(sizes.filter(F.col("count") > min(GROUP_ROWS, node_rows)), "root", "left_semi").select("set_id")
    small = proposed.join(large, "set_id", "left_anti").select(F.col("root").alias("node"), "set_id")
    sets = cut(stored_sets(docs, firsts.join(proposed, "set_id", "left_semi")))
    found = components(links(small.unionByName(nodes.join(large, "set_id", "left_semi").select("node", "set_id")), codes, sets, least))
    found = found.withColumnRenamed("node", "set_id")
    return prints.select("doc_id", "set_id").join(found, "set_id", "left").select("doc_id", "set_id", F.coalesce("root", "set_id").alias("root"))


def groups(docs: DataFrame, least: float = 0.8, node_rows: int = 50_000) -> DataFrame:
    """(doc_id, component_id) for each row with a doc_id: the smallest doc_id of its group of near copies."""
    rows = cut(grouped(docs, least, node_rows))
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, least: float = 0.8, node_rows: int = 50_000) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with its smallest doc_id stays, and of several rows with
    that doc_id in the group, one of the smallest set_id."""
    id_, set_, kept_, rows_ = unused(docs.columns, "_id", "_set", "_kept", "_rows")
    rows = cut(grouped(docs, least, node_rows))
    first = cut(rows.groupBy("root").agg(F.min(F.struct("doc_id", "set_id")).alias("x")).select(F.col("x.doc_id").alias(id_), F.col("x.set_id").alias(set_)))
    stay = first.groupBy(id_).agg(F.count(F.lit(1)).alias(kept_))
    by_id = rows.groupBy(F.col("doc_id").alias(id_)).agg(F.count(F.lit(1)).alias(rows_)).join(stay, id_, "left").filter(F.col(kept_).isNull() | (F.col(rows_) > 1))
    marked = docs.join(by_id, F.col("doc_id").cast("long") == F.col(id_), "left")
    kept = marked.filter(F.col(id_).isNull()).select(*docs.columns)
    # a doc_id of several rows may stand in several groups: its rows are told apart by their sets
    schema = T.StructType([*docs.schema.fields, T.StructField(id_, T.LongType()), T.StructField(set_, T.LongType())])
    again = marked.filter(F.col(kept_).isNotNull()).select(*docs.columns, id_).mapInArrow(with_set(set_), schema)
    again = again.join(first, [id_, set_], "left_semi").dropDuplicates([id_, set_])
    return kept.unionByName(again.select(*docs.columns))


def with_set(name: str):
    """A step over batches that adds the digest of each text's shingle set as a last column ``name``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                digest = shingle_sets([None if t is None else str(t) for t in part.column("text").to_pylist()])[1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digest)], [*part.schema.names, name])

    return tidy(run)
