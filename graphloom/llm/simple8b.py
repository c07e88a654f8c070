"""Token ids in word-aligned Simple-8b blocks: writer, reader and the table of file images.

An image is one binary value, little-endian:

* header: magic ``S8B1``, version u32, documents u64, ids u64, blocks u64, words u64, escapes u64;
* documents: ids i64 each, then lengths u64 each, then a null flag u8 each;
* block directory: for each block its first word u64 (a block holds BLOCK ids, the last one what is left);
* words u64: the top four bits select (count, width) of the ids packed below, the first in the lowest bits;
* escapes: positions u64, then values u64, of ids of 60 bits or more, which are packed as 0.

Every block starts on a word of its own, so any block decodes alone, and a block decodes with one gather per selector.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import LOWER_TABLE, release, slices, tidy
from ._common import by_id_ranges, cut

MAGIC, BLOCK = 0x31423853, 1 << 16
#: (ids in a word, bits of each) by selector, most ids first; fixed values of the published Simple-8b scheme without its runs of zeros.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS, WIDTHS = (np.array(x, np.int64) for x in zip(*SELECTORS, strict=True))
#: The selector of least width for each id below 2**16.
CLASS = np.searchsorted(WIDTHS, np.frexp(np.arange(1 << 16))[1]).astype(np.uint8)


def pack(ids: np.ndarray) -> np.ndarray:
    """The words of one block; every id below 2**60. Each word takes as many ids as fit, from left to right."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    # the first selector from the end whose width holds an id, and its greatest over ever longer windows
    need = CLASS[ids] if ids.max() < len(CLASS) else np.searchsorted(WIDTHS, np.frexp(ids.astype(np.float64))[1]).astype(np.uint8)
    best, window, size, least = np.full(n, len(SELECTORS) - 1, np.uint8), need.copy(), 1, int(need.min())
    for s in range(len(SELECTORS) - 2, least - 1, -1):
        count = SELECTORS[s][0]
        for size in range(size, min(count, n)):
            np.maximum(window[: n - size], need[size:], out=window[: n - size])
        size = max(size, min(count, n))
        best[window <= s] = s
    best, starts, p, counts = best.tobytes(), [], 0, COUNTS.tolist()
    add = starts.append
    while p < n:
        add(p)
        p += counts[best[p]]
    best = np.frombuffer(best, np.uint8)
    starts = np.array(starts)
    picked, padded = best[starts], np.concatenate([ids, np.zeros(64, np.uint64)])
    words = np.zeros(len(starts), np.uint64)
    for s in np.unique(picked):
        count, width = SELECTORS[s]
        rows = np.flatnonzero(picked == s)
        word = np.full(len(rows), np.uint64(int(s) << 60))
        for k in range(count):
            word |= padded[starts[rows] + k] << np.uint64(k * width)
        words[rows] = word
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of one block's words."""
    picked = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[picked]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(picked):
        count, width = SELECTORS[s]
        rows = np.flatnonzero(picked == s)
        word, mask = words[rows], np.uint64((1 << width) - 1)
        for k in range(count):
            out[first[rows] + k] = (word >> np.uint64(k * width)) & mask
    return out[:n]


def write_image(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    ids = ids.astype(np.uint64)
    big = np.flatnonzero(ids >> np.uint64(60))
    values = ids[big]
    if len(big):
        ids = ids.copy()
        ids[big] = 0
    blocks = [pack(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    first = np.cumsum([0, *map(len, blocks)])
    head = np.array([MAGIC, 1], "<u4").tobytes() + np.array([len(doc_ids), len(ids), len(blocks), first[-1], len(big)], "<u8").tobytes()
    parts = [head, doc_ids.astype("<i8"), lengths.astype("<u8"), nulls.astype(np.uint8), first[:-1].astype("<u8"), *(b.astype("<u8") for b in blocks), big.astype("<u8"), values.astype("<u8")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, null flags, lengths, ids) of an image."""
    magic, version = np.frombuffer(image, "<u4", 2)
    if (magic, version) != (MAGIC, 1):
        raise ValueError("not a token image")
    docs, n, blocks, words, escapes = map(int, np.frombuffer(image, "<u8", 5, 8))
    at, out = 48, []
    for kind, count in (("<i8", docs), ("<u8", docs), ("u1", docs), ("<u8", blocks), ("<u8", words), ("<u8", escapes), ("<u8", escapes)):
        out.append(np.frombuffer(image, kind, count, at))
        at += out[-1].nbytes
    doc_ids, lengths, nulls, first, packed, where, values = out
    stop = np.append(first[1:], words)[:blocks].astype(np.int64)
    got = [unpack(packed[int(a) : int(b)], min(BLOCK, n - k * BLOCK)) for k, (a, b) in enumerate(zip(first, stop, strict=True))]
    ids = np.concatenate(got) if got else np.zeros(0, np.uint64)
    if escapes:
        ids[where.astype(np.int64)] = values
    return doc_ids, nulls.astype(bool), lengths.astype(np.int64), ids


#: Byte-level BPE's symbols (published rule): printable Latin-1 stands for itself, the other bytes follow U+0100 in order.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SYMBOLS = {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in _PLAIN)}


class WordEncoder:
    """Token ids of texts by a tokenizer whose pieces never cross white space and that lower-cases: words are encoded once
    and kept. Beyond ``most`` words, those seen once are forgotten (and encoded again when they return)."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.whole, self.pieces = self.tokenizer.encode, self.tokenizer.model.tokenize
        self.known: dict[bytes, int] = {}
        self.tails: dict[bytes, list[int]] = {}
        self.flat, self.first, self.seen = array("I"), array("q", [0]), np.zeros(0, np.int64)

    def _ids(self, word: bytes) -> list[int]:
        if word.isalpha() and word.islower():  # ASCII letters: normal form, pieces and byte symbols leave them as they are
            return [t.id for t in self.pieces(word.decode())]
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0180" and text == text.lower():  # Latin letters, composed: only the byte symbols change
            return [t.id for t in self.pieces(word.decode("latin-1").translate(BYTE_SYMBOLS))]
        return self.whole(text, add_special_tokens=False).ids

    def _learn(self, word: bytes) -> int:
        stem = word.rstrip(b".,")
        if len(stem) != len(word) and stem[-1:].isalpha():
            # a run of punctuation after a letter is a piece of its own
            tail = word[len(stem) :]
            if (end := self.tails.get(tail)) is None:
                end = self.tails[tail] = self._ids(tail)
            self.flat.extend(self._ids(stem))
            self.flat.extend(end)
        else:
            self.flat.extend(self._ids(word))
        k = self.known[word] = len(self.first) - 1
        self.first.append(len(self.flat))
        return k

    def _forget(self) -> None:
        keep = np.flatnonzero(self.seen[: len(self.known)] > 1)
        first, flat = np.array(self.first), np.array(self.flat)
        size = np.diff(first)[keep]
        of = np.concatenate([[0], np.cumsum(size)])
        flat = flat[np.repeat(first[keep] - of[:-1], size) + np.arange(of[-1])] if len(keep) else flat[:0]
        new = np.full(len(first), -1)
        new[keep] = np.arange(len(keep))
        self.known = {w: j for w, k in self.known.items() if (j := int(new[k])) >= 0}
        self.flat, self.first, self.seen = array("I", flat.astype(np.uint32).tobytes()), array("q", of.astype(np.int64).tobytes()), np.zeros(0, np.int64)
        self.tails.clear()

    def encode(self, texts: list[bytes | str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end`` appended; number of ids of each)."""
        if len(self.known) > self.most:
            self._forget()
        get, learn, picks, counts = self.known.get, self._learn, [], []
        for text in texts:
            raw = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
            # control strings keep their case: the tokenizer matches them before it lower-cases
            ws = (raw if b"<|" in raw else raw.translate(LOWER_TABLE)).split()
            picks += [k if (k := get(w)) is not None else learn(w) for w in ws]
            counts.append(len(ws))
        picks, first, flat = np.array(picks, np.int64), np.frombuffer(self.first, np.int64), np.frombuffer(self.flat, np.uint32)
        seen = np.bincount(picks, minlength=len(first))
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        size = (first[1:] - first[:-1])[picks]
        of = np.concatenate([[0], np.cumsum(size)])
        words = np.concatenate([[0], np.cumsum(counts)])
        lengths = of[words[1:]] - of[words[:-1]] + 1
        ids = np.full(int(lengths.sum()), end, np.uint32)
        slot = np.ones(len(ids), bool)
        slot[np.cumsum(lengths) - 1] = False
        if len(picks):
            ids[slot] = flat[np.repeat(first[:-1][picks] - of[:-1], size) + np.arange(of[-1])]
        return ids, lengths


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, tokenizer: str, end: int = 1, image_ids: int = 1 << 20, per_part: int = 8 << 20) -> DataFrame:
    """The written table of images (shard, seq, n_ids, image): documents in ascending doc_id (null first, equal ids by text),
    shards in ranges of doc_id, images of about ``image_ids`` ids; a document is never split over images.

    Defined cases: null text is empty and gives the end id alone; repeated rows are all written; an empty table gives no image.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, _ = by_id_ranges(docs, "doc_id", per_part)

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, seq, shard = word_encoder(tokenizer), 0, None
        held: list[tuple] = []

        def image():
            ids = np.concatenate([h[3] for h in held])
            blob = write_image(*(np.concatenate([h[i] for h in held]) for i in range(3)), ids)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "image": pa.array([blob], pa.binary())})

        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                shard = part.column("bucket")[0].as_py()
                ids, lengths = encoder.encode(part.column("text").cast(pa.binary()).to_pylist(), end)
                doc = part.column("doc_id")
                held.append((doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), lengths, ids))
                if sum(len(h[3]) for h in held) >= image_ids:
                    yield image()
                    held, seq = [], seq + 1
                    release()
        if held:
            yield image()

    written = docs.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(tidy(run), "shard int, seq int, n_ids long, image binary")
    return cut(written, "uncompressed")


def read_documents(images: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a table of images: ids are decoded from the images, start
    counts the ids of all documents before it. Offsets come from sums over images, then over at most 20,000 shards."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, nulls, lengths, ids = read_image(batch.column("image")[row].as_py())
                ids, stop = ids.astype("<u4"), np.cumsum(lengths)
                view, start = memoryview(ids.tobytes()), stop - lengths
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(c)[row].as_py(), np.int32)) for c in ("shard", "seq")] + [pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(start), pa.array(lengths), pa.array(np.array(crc, np.int64))],
                    ["shard", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    docs = images.select("shard", "seq", "image").mapInArrow(tidy(run), "shard int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    sizes = images.select("shard", "seq", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n")
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")
    starts = sizes.withColumn("inside", inside).join(shards, "shard").select("shard", "seq", (F.col("before") + F.col("inside")).alias("base"))
    return docs.join(starts, ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    return read_documents(encode_documents(docs, tokenizer, end))
