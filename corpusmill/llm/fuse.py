"""Static 3-wise binary-fuse filters in numpy, after Graf and Lemire (2022), with 16-bit fingerprints."""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = struct.Struct("<QIII")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # MurmurHash3's finaliser
_33, _32, _18, _48 = (np.uint64(x) for x in (33, 32, 18, 48))


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64(seed)
    h = (h ^ (h >> _33)) * _M1
    h = (h ^ (h >> _33)) * _M2
    return h ^ (h >> _33)


def _cells(h: np.ndarray, length: int, count: int) -> np.ndarray:
    """The three cells of each key, in three neighbouring segments."""
    mask = np.uint64(length - 1)
    a = ((h >> _32) * np.uint64(count * length)) >> _32
    b = (a + np.uint64(length)) ^ ((h >> _18) & mask)
    c = (a + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([a, b, c]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> _32)) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter of the distinct 64-bit keys.

    Keys are peeled in rounds: all cells that hold a single key give theirs up at once. Keys of
    one round share none of those cells, so each round is assigned as one array operation.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    length = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    count = max(1, math.ceil(n * factor / length) - 2 + 1)
    for seed in range(1, 1000):
        h = _mixed(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        cells = _cells(h, length, count)
        size = (count + 2) * length
        held = np.bincount(cells.ravel(), minlength=size)
        names = np.zeros(size, np.int64)
        np.add.at(names, cells.ravel(), np.tile(np.arange(n), 3))
        order: list[tuple[np.ndarray, np.ndarray]] = []
        left = n
        while left:
            single = np.flatnonzero(held == 1)
            if not len(single):
                break
            who, first = np.unique(names[single], return_index=True)
            order.append((who, single[first]))
            for row in cells[:, who]:
                np.subtract.at(held, row, 1)
                np.subtract.at(names, row, who)
            left -= len(who)
        if not left:
            break
    else:
        raise ValueError("no seed gave a filter")
    got, prints = np.zeros(size, np.uint16), _prints(h)
    for who, cell in reversed(order):
        at = cells[:, who]
        got[cell] = 0
        got[cell] = prints[who] ^ got[at[0]] ^ got[at[1]] ^ got[at[2]]
    return _HEAD.pack(seed * 0x9E3779B97F4A7C15 % (1 << 64), length, count, n) + got.tobytes()


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key whether the filter may hold it: always true for its own keys."""
    seed, length, count, n = _HEAD.unpack_from(blob)
    if not n:
        return np.zeros(len(keys), bool)
    got = np.frombuffer(blob, np.uint16, offset=_HEAD.size)
    h = _mixed(keys.astype(np.uint64), seed)
    a, b, c = _cells(h, length, count)
    return (got[a] ^ got[b] ^ got[c]) == _prints(h)
