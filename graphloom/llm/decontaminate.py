"""Benchmark decontamination: approximate occurrences of test items inside documents.

An item of m characters (white space runs as one space, lower case) may be matched with up to k = floor(rate * m) edits. It is
split into k + 1 pieces; where it occurs, one piece occurs exactly and, by the ring form of the pigeonhole argument, one such
piece is followed by the next piece with at most one edit. Exact pieces are found with one Aho-Corasick automaton, the follower
is tested by its halves, and what is left is verified with Myers' bit-parallel distance.

Defined cases: null or empty items match nothing; null or empty documents hold nothing; repeated items and repeated rows are all
reported; an item longer than a document can match it only within k edits; an empty table on either side gives an empty
result; other columns are not read by ``matches`` and are kept by ``clean``. Items are read in groups of at most
``group_chars`` characters, each one pass over the documents, so a benchmark of any size is searched whole in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import slices, tidy
from ._common import cut, unused

FIELDS = "doc_id long, item_id long, distance int, start long, stop long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, stop) of the best match of ``item`` in ``text`` with at most ``most`` edits, the first of equals."""
    m, peq = len(item), {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, stop, n = mask, 0, m, most + 1, -1, len(text)
    for j, c in enumerate(text):
        x = peq.get(c, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn, hp = vp & d0, vn | (mask & ~(vp | d0))
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        x = hp << 1 & mask
        vn, vp = x & d0, (hn << 1 & mask) | (mask & ~(x | d0))
        if score < best:
            best, stop = score, j + 1
        elif score - best >= n - j:
            break
    return (best, stop) if stop >= 0 else None


class Finder:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, pieces = [], {}
        for item_id, text in items:
            if not (t := normal(text)):
                continue
            k = min(int(rate * len(t)), len(t) - 1)
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            number = len(self.items)
            self.items.append((item_id, t, k))
            for j in range(k + 1):
                after = t[cuts[j + 1] : cuts[j + 2]] if j < k else ""
                half = len(after) // 2
                pieces.setdefault(t[cuts[j] : cuts[j + 1]], []).append((number, cuts[j], after[:half], after[half:], half))
        self.automaton = ahocorasick.Automaton()
        for piece, own in pieces.items():
            self.automaton.add_word(piece, (len(piece), own))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop) of the best occurrence of each item, as places in the normal form of the text."""
        t = normal(text)
        if not self.items or not t:
            return
        places: dict[int, list[int]] = {}
        for end, (size, own) in self.automaton.iter(t):
            e = end + 1
            for number, at, left, right, half in own:
                h = e + half
                if not right or t.startswith(left, e) and left or t.startswith(right, h) or t.startswith(right, h + 1) or t.startswith(right, max(e, h - 1)):
                    places.setdefault(number, []).append(e - size - at)
        for number, diagonals in places.items():
            item_id, item, k = self.items[number]
            best, low, high = None, None, None
            for d in [*sorted(set(diagonals)), None]:
                if low is not None and (d is None or d - k > high):
                    if (got := myers(item, t[low:high], k)) and (best is None or got[0] < best[0]):
                        best = (got[0], low + got[1])
                    low = None
                if d is not None:
                    low, high = max(0, d - k) if low is None else low, d + len(item) + k
            if best is not None:
                distance, stop = best
                back = myers(item[::-1], t[max(0, stop - len(item) - k) : stop][::-1], distance)
                yield item_id, distance, stop - (back[1] if back else len(item)), stop


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.1, group_chars: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, distance, start, stop): each item that occurs in a document, at its best place."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = -(-size // group_chars) or 1
    out = None
    for g in range(groups):
        own = items if groups == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()])

        def run(batches, shared=shared):
            finder = Finder(shared.value, rate)
            for batch in batches:
                for part in slices(batch):
                    rows = [(d, *m) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for m in finder.find(t)]
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "item_id", "distance", "start", "stop"])

        found = docs.mapInArrow(tidy(run), FIELDS)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.1) -> DataFrame:
    """The rows of ``docs`` without those whose doc_id holds an item; a row with a null doc_id goes by its text."""
    found = cut(matches(docs, items, rate).select("doc_id").distinct())
    held, sha = unused(docs.columns, "_held", "_sha")
    kept = docs.join(found.withColumnRenamed("doc_id", held), F.col("doc_id").cast("long") == F.col(held), "left_anti")
    if found.filter("doc_id is null").isEmpty():
        return kept
    unnamed = docs.filter("doc_id is null").withColumn(sha, F.sha2("text", 256))
    again = matches(unnamed.select(F.xxhash64(sha).alias("doc_id"), "text"), items, rate).select("doc_id").distinct()
    unnamed = unnamed.join(again.withColumnRenamed("doc_id", held), F.xxhash64(sha) == F.col(held), "left_anti").drop(sha)
    return kept.filter("doc_id is not null").unionByName(unnamed)
