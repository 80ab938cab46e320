"""Values with their owners, packed by shuffle bucket: 48-bit hashes and indexes into short lists of owners."""

from __future__ import annotations

import numpy as np

from factloom.llm.words import mix


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values) % np.uint64(buckets)).astype(np.int64)


def packed(values: np.ndarray, owner: np.ndarray, owners: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """values below 2^48; owner: indexes (up to 65,535) into owners (int64). Rows: bucket, owners, indexes, values."""
    bucket = bucket_of(values, buckets)
    order = np.argsort(bucket, kind="stable")
    ids, cuts = np.unique(bucket[order], return_index=True)
    raw, owner = values[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], owner[order]
    out = []
    for b, lo, hi in zip(ids, cuts, [*cuts[1:], len(order)], strict=True):
        here, local = np.unique(owner[lo:hi], return_inverse=True)
        out.append((int(b), owners[here].astype(np.int64).tobytes(), local.astype("<u2").tobytes(), raw[lo:hi].tobytes()))
    return out


def unpacked(owners: bytes, indexes: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Values and the owner of each."""
    wide = np.zeros((len(values) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(values, np.uint8).reshape(-1, 6)
    return wide.view("<u8")[:, 0], np.frombuffer(owners, np.int64)[np.frombuffer(indexes, "<u2")]
