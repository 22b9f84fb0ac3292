"""Words of whole texts as arrays: boundaries, 64-bit hashes, windows. All by numpy on UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes; longer words are hashed one by one.
_LONG = 64


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    lut = np.zeros(256, bool)
    for lo, hi in ranges:
        lut[lo : hi + 1] = True
    return lut


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z, other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bounds(data: np.ndarray, offs: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends (byte positions) of maximal runs of cls within each text, and words per text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    w = cls[data]
    start = w.copy()
    start[1:] &= ~w[:-1]
    cut = offs[1:-1]
    cut = cut[cut < n]
    start[cut] = w[cut]
    end = np.zeros(n, bool)
    end[:-1] = w[:-1] & ~w[1:]
    end[-1] = w[-1]
    last = cut[cut > 0] - 1
    end[last] = w[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(s, offs))
    return s, e, counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number; past the end they are 0."""
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", room, strides=(1,))


#: How much of eight bytes counts where 0 to 8 of them are a word's.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes, the same for equal words everywhere: eight bytes at a time go
    through a bijection that mixes all bits, so structure in the words doesn't meet structure in the hash.
    Words of up to eight bytes and equal length never share one; long words are hashed by BLAKE2."""
    size = (ends - starts).astype(np.int64)
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64((0xA0761D6478BD642F * (seed + 1)) & _MASK))
        view, k = lanes(data), 0
        live = np.flatnonzero((size > 0) & (size <= _LONG))
        while len(live):
            left = np.minimum(size[live] - k, 8)
            out[live] = mix(out[live] ^ (view[starts[live] + k] & _KEPT[left]))
            k += 8
            live = live[size[live] > k]
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return out


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only: words are grouped by hash, and each is then
    compared with its group's first by its bytes. Should a group hold different words, all go by a table."""
    first, ids = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)[1:]
    size, rep = ends - starts, first[ids]
    same, view, k = size == size[rep], lanes(data), 0
    live = np.flatnonzero(same & (rep != np.arange(len(rep))))
    while len(live) and k <= _LONG:
        kept = _KEPT[np.minimum(size[live] - k, 8)]
        equal = (view[starts[live] + k] & kept) == (view[starts[rep[live]] + k] & kept)
        same[live[~equal]] = False
        k += 8
        live = live[equal & (size[live] > k)]
    raw = data.tobytes() if len(live) or not same.all() else b""
    for i in live.tolist():
        same[i] = raw[starts[i] : ends[i]] == raw[starts[rep[i]] : ends[rep[i]]]
    if same.all():
        return ids.astype(np.int64)
    table: dict[bytes, int] = {}
    return np.array([table.setdefault(raw[a:b], len(table)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def windows(wh: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Rabin-Karp hash of size consecutive word hashes, for each start (also across texts)."""
    n = len(wh) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out = np.uint64(base), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out *= base
            out += wh[k : k + n]
    return mix(out)


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in [s, s + length) for some s."""
    d = np.zeros(n + 1, np.int32)
    if len(starts):
        np.add.at(d, starts, 1)
        np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0
