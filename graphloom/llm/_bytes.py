"""Vectorised text kernels over the UTF-8 buffers of Arrow columns: no Python string is made on these paths."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel works on at a time; arrays of eight bytes for each stay small.
SLICE = 1 << 19
#: Odd multiplier of the polynomial hash, and the two of the finaliser (splitmix64's published constants).
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()


def release() -> None:
    """Gives what a kernel (or training) held back to the system, where the C library can: workers and the driver's process go on
    for long, and what they keep counts beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(step: Callable) -> Callable:
    """``step`` over batches, which gives back what it held when it has ended."""

    def run(batches) -> Iterator:
        yield from step(batches)
        release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int = BASE):
        self.base = base
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, a * np.uint64(pow(b, len(a), 1 << 64))]))
        return self.up, self.down


POWERS = Powers()


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off is not None else np.zeros(1, np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batch, text: str = "text", limit: int = SLICE) -> Iterator:
    """Row ranges of a batch with about ``limit`` bytes of text each; one long text makes a range of its own."""
    _, off = strings(batch.column(text))
    n, at = batch.num_rows, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry than texts)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    ink = ~IS_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, ink[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of words (spans of one byte or more): the sum of one mixed value for each byte and its place in the word, so no
    algebra of a polynomial makes long words collide, as it does with ``span_hash``, which suits buckets only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    head = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(head, size)
    byte = raw[np.repeat(starts, size) + place].astype(np.uint64)
    value = mix((place.astype(np.uint64) << np.uint64(8) | byte) + np.uint64(BASE))
    return mix(np.add.reduceat(value, head) + size.astype(np.uint64))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    up, _ = POWERS.get(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte (or word) spans, equal for equal content wherever it stands."""
    _, down = POWERS.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])
