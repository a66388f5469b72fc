"""A static binary-fuse filter (three-wise, 8-bit fingerprints; Graf and Lemire, 2022) on numpy arrays."""

from __future__ import annotations

import math

import numpy as np

from .common import mix64

HEADER = 3


def _places(keys: np.ndarray, seed: int, segment: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    start = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    one = (start + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    two = (start + np.uint64(2 * segment)) ^ (h & mask)
    prints = ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)
    return np.stack([start, one, two]).astype(np.int64), prints


def build(keys: np.ndarray) -> bytes:
    """A filter of distinct 64-bit keys; repeated keys count once."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    segment = min(segment, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 4)))
    slots = max(1, math.ceil(n * factor / segment) - 2)
    span = slots * segment
    for seed in range(1, 200):
        at, prints = _places(keys, seed, segment, span)
        size = span + 2 * segment
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        alive, order = np.ones(n, bool), []
        while True:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            who, first = np.unique(owner[single], return_index=True)
            order.append((who, single[first]))
            alive[who] = False
            for row in at[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, who)
        if not alive.any():
            break
        if seed % 20 == 0:
            span += segment
    else:
        raise RuntimeError("no filter could be built")
    table = np.zeros(size, np.uint8)
    for who, place in reversed(order):
        table[place] = 0
        table[place] = prints[who] ^ table[at[0, who]] ^ table[at[1, who]] ^ table[at[2, who]]
    return np.array([seed, segment, span], "<u8").tobytes() + table.tobytes()


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 of the others."""
    seed, segment, span = (int(x) for x in np.frombuffer(blob, "<u8", HEADER))
    table = np.frombuffer(blob, np.uint8, offset=8 * HEADER)
    at, prints = _places(keys.astype(np.uint64), seed, segment, span)
    return prints == table[at[0]] ^ table[at[1]] ^ table[at[2]]
