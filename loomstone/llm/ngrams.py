"""Indicators of n-grams of whole texts, as distinct numbers below a power of two, and linear models of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import slices, text_buffers
from .words import LOWER, NOT_SPACE, bounds, hashes, windows

ORDERS = (1, 2, 3, 4)


class Indicators:
    """Distinct n-gram numbers of one text at a time, by a table of flags that is cleared after each: byte n-grams
    below 2**bits and, with words, words and pairs of them in as many numbers above."""

    def __init__(self, bits: int, orders: tuple[int, ...] = ORDERS, words: bool = False) -> None:
        self.bits, self.orders, self.words = bits, orders, words
        self.flags = np.zeros(2 << bits if words else 1 << bits, bool)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        shift, code = np.uint32(32 - self.bits), np.zeros(len(data), np.uint32)
        with np.errstate(over="ignore"):
            for n in range(1, max(self.orders) + 1):
                if len(data) < n:
                    break
                code = code[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
                if n in self.orders:
                    self.flags[(code * np.uint32(0x9E3779B1)) >> shift] = True
        if self.words:
            low = LOWER[data]
            s, e, _ = bounds(low, np.array([0, len(low)]), NOT_SPACE)
            wh = hashes(low, s, e)
            for h in (wh, windows(wh, 2)):
                self.flags[(1 << self.bits) + (h >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found


def pack(found: np.ndarray, dim: int) -> bytes:
    """Numbers below dim in at most dim / 8 bytes and a few: as they are, or as bits where that is shorter."""
    if 32 * len(found) < dim:
        return b"n" + found.astype("<i4").tobytes()
    flags = np.zeros(dim, bool)
    flags[found] = True
    return b"b" + np.packbits(flags).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"n":
        return np.frombuffer(raw, "<i4", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1)))


def texts_of(col: pa.Array):
    """The bytes of each text; long columns are cut into slices first."""
    data, offs = text_buffers(col)
    for i, j in slices(offs):
        for k in range(i, j):
            yield data[offs[k] : offs[k + 1]]


def dual_coordinate_descent(rows: list[bytes], y: np.ndarray, dim: int, cost: np.ndarray, epochs: int = 12, seed: int = 5, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model w, b of packed rows, whose features are worth 1 (times weight) over the root of their number.

    A dual variable at a time is moved to its optimum within [0, cost]; the bias is a feature of value 1."""
    rng, w, b = np.random.default_rng(seed), np.zeros(dim), 0.0
    alpha = np.zeros(len(rows))
    norm = np.zeros(len(rows))
    for i, raw in enumerate(rows):
        r = unpack(raw)
        norm[i] = 1 + (len(r) if weight is None else np.square(weight[r]).sum()) / max(1, len(r))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r = unpack(rows[i])
            s = 1 / np.sqrt(max(1, len(r)))
            v = s if weight is None else s * weight[r]
            dot = float(w[r].sum()) * s if weight is None else float(w[r] @ v)
            grad = y[i] * (dot + b) - 1
            new = min(max(alpha[i] - grad / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                b += step
                alpha[i] = new
    return w, b


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """a, c of 1 / (1 + exp(-(a m + c))) by Newton's method; targets are drawn in a little, so that a stays finite."""
    pos, neg = max((y > 0).sum(), 1), max((y <= 0).sum(), 1)
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, p = np.stack((margin, np.ones(len(margin)))), np.array([1.0, 0.0])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(p @ x, -30, 30)))
        grad = x @ (q - t)
        step = np.linalg.solve((x * (q * (1 - q) + 1e-6)) @ x.T + 1e-3 * np.eye(2), grad)
        p = p - step
        if np.abs(step).max() < 1e-7:
            break
    return max(float(p[0]), 1e-3), float(p[1])
