"""Static binary-fuse filters (three hashes, 8-bit fingerprints) over 64-bit keys, built and probed in numpy."""

from __future__ import annotations

import math
import struct

import numpy as np

from factloom.llm.words import mix

_HEAD = struct.Struct("<QQII")  # seed, keys, segment length, segments


def _slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in neighbouring segments, and its fingerprint."""
    h = mix(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    g = mix(h)
    mask = np.uint64(length - 1)
    at = np.stack([(first + np.uint64(j)) * np.uint64(length) + ((g >> np.uint64(18 * j)) & mask) for j in range(3)])
    return at.astype(np.int64), ((g >> np.uint64(56)) ^ h).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter that holds every key; keys are uint64, repeats count once."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return _HEAD.pack(0, 0, 1, 1) + bytes(3)
    length = min(1 << 18, 1 << max(0, math.floor(math.log(n) / math.log(3.33) + 2.25))) if n > 1 else 4
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    for seed in range(1, 200):
        segments = max(1, math.ceil(n * factor * (1 + 0.02 * (seed // 10)) / length) - 2)
        at, prints = _slots(keys, seed * 0x9E3779B97F4A7C15 % 2**64, length, segments)
        size = (segments + 2) * length
        degree, owner = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for row in at:
            degree += np.bincount(row, minlength=size)
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        left = n
        while left:
            single = np.flatnonzero(degree == 1)
            who, i = np.unique(owner[single], return_index=True)
            if not len(who):
                break
            rounds.append((who, single[i]))
            left -= len(who)
            for row in at[:, who]:
                degree -= np.bincount(row, minlength=size)
                np.bitwise_xor.at(owner, row, who)
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for who, slot in reversed(rounds):  # a slot of degree one is no slot of any other key of its round
            a, b, c = at[:, who]
            table[slot] = 0
            table[slot] = prints[who] ^ table[a] ^ table[b] ^ table[c]
        return _HEAD.pack(seed * 0x9E3779B97F4A7C15 % 2**64, n, length, segments) + table.tobytes()
    raise RuntimeError("no seed gives a filter")


def probe(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter: never False for one that is."""
    seed, n, length, segments = _HEAD.unpack_from(blob)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=_HEAD.size)
    (a, b, c), prints = _slots(keys.astype(np.uint64), seed, length, segments)
    return (table[a] ^ table[b] ^ table[c]) == prints
