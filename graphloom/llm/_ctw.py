"""Context-tree weighting of byte grams in numpy.

A gram is one 64-bit value: DEPTH context bytes (at most seven), the most recent next to the coded byte, and that byte lowest. A byte is eight
binary decisions; a decision's node is the byte's bits so far. For each node there is a context tree over the context's bytes, most
recent first. Decisions sorted by (node, recent byte, next byte, ...) have the nodes of every depth in runs, so one sort serves all
depths.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5, to about 1e-13."""
    shift, y = np.ones_like(x), x + 8
    for k in range(8):
        shift = shift * (x + k)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(shift)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sort keys, bits), eight of each for every gram: node, then the context bytes, most recent first."""
    byte = grams & np.uint64(255)
    turned = np.zeros(len(grams), np.uint64)
    for k in range(DEPTH):
        turned = turned << np.uint64(8) | grams >> np.uint64(8 * (k + 1)) & np.uint64(255)
    keys, bits = np.empty((8, len(grams)), np.uint64), np.empty((8, len(grams)), bool)
    for j in range(8):
        node = np.uint64(1 << j) | byte >> np.uint64(8 - j)
        keys[j] = node << np.uint64(8 * DEPTH) | turned
        bits[j] = (byte >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
    return keys.ravel(), bits.ravel()


class Tree:
    """The nodes of depths ``top`` to DEPTH of the decisions of grams with counts (zero counts are allowed)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, top: int):
        self.top, self.size = top, len(grams)
        keys, bits = decisions(grams)
        order = np.argsort(keys, kind="stable")
        keys, self.bits = keys[order], bits[order]
        self.order = order
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        n = np.tile(counts, 8)[order].astype(np.float64)
        self.of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(keys))))
        leaf = keys[head]
        one = np.add.reduceat(np.where(self.bits, n, 0), head) if len(head) else np.zeros(0)
        zero = (np.add.reduceat(n, head) if len(head) else np.zeros(0)) - one
        self.levels = []  # from DEPTH up to top: (keys, zeros, ones, ln P_w, weight of the own estimate, first child)
        key, own = leaf, kt(zero, one)
        self.levels.append((key, zero, one, own, np.ones(len(key)), np.arange(len(key))))
        for d in range(DEPTH - 1, top - 1, -1):
            up = self.levels[-1]
            key = up[0] >> np.uint64(8)
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            add = lambda v: np.add.reduceat(v, head) if len(head) else v  # noqa: B023, E731
            zero, one, below = add(up[1]), add(up[2]), add(up[3])
            own = kt(zero, one)
            both = np.logaddexp(own, below)
            self.levels.append((key[head], zero, one, both - np.log(2), np.exp(own - both), head))

    def roots(self) -> tuple[np.ndarray, ...]:
        """(keys, zeros, ones, ln P_w) of the nodes at the top depth."""
        return self.levels[-1][:4]

    def predict(self, above: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """log10 of each gram's probability of its byte after its context. At each node on the way the own estimate counts with
        its weight and the deeper ones with the rest; a context that was never seen adds nothing below the last one that was.
        ``above``: for each depth over the top, from the nearest up, (zeros, ones, weight) at the top nodes' ancestors."""
        _, zero, one = self.levels[0][:3]
        p, seen = (one + 0.5) / (zero + one + 1), zero + one > 0
        up = np.arange(len(zero))  # each deepest node's ancestor at the level in hand
        rows = []
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            head = level[5]
            up = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(below[1]))))[up]
            rows.append((level[1][up], level[2][up], level[4][up]))
        rows += [(z[up], o[up], w[up]) for z, o, w in above or []]
        for zero, one, weight in rows:
            own = (one + 0.5) / (zero + one + 1)
            p = np.where(seen, weight * own + (1 - weight) * p, own)
            seen |= zero + one > 0
        q = p[self.of]
        out = np.empty(8 * self.size)
        out[self.order] = np.log10(np.where(self.bits, q, 1 - q))
        return out.reshape(8, self.size).sum(0)
