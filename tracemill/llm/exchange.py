"""Counts exchanged between blocks of documents and ranges of hashes, both of bounded size.

A block asks for its distinct keys, sorted and cut at the ranges' edges; a range gets what all blocks ask of it.
With n keys in all, blocks and ranges of ``side(n)`` keys each give rows of at least ``LEAST`` keys, so rows grow
with the corpus and not with its square, while a task's memory grows with the square root only:
2**20 keys for corpora of up to 6 * 10**10 keys, and 2**24 keys for 10**13.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

#: Keys of a block and of a range, at least, and keys of a row on average, at least.
SIDE, LEAST = 1 << 20, 16


def side(keys: int) -> int:
    """Keys of a block, and of a range."""
    return max(SIDE, math.isqrt(LEAST * keys))


def edges(ranges: int) -> np.ndarray:
    """The first hash of each range but the first."""
    return np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)


def pack(x: np.ndarray) -> bytes:
    """The array's bytes by place, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(blob: bytes, n: int, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(unpack(blob, n, kind), dtype=kind)


def pack_bits(x: np.ndarray) -> bytes:
    return pa.compress(np.packbits(x).tobytes(), codec="zstd", asbytes=True)


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(pa.decompress(blob, -(-n // 8), codec="zstd"), np.uint8), count=n).astype(bool)


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and the number of each element among them."""
    order = np.argsort(x)
    ordered = x[order]
    head = np.ones(len(x), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(x), np.uint32)
    number[order] = np.cumsum(head, dtype=np.uint32) - np.uint32(1)
    return ordered[head], order[head], number
