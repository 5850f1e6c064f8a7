"""Counting quotient filters for packed n-grams: compact, sorted, and exact.

An n-gram of word ids (each of width bits) is packed into two halves, which a
Feistel network permutes: the permutation can be undone, so nothing is lost, and it
spreads keys evenly however crowded their words are. The top bits of a permuted key
are its bucket, the next its quotient, all others its remainder, which is kept
in full. A filter holds the sorted keys of one bucket: a bit for each
quotient that occurs, a bit for each slot that ends a quotient's run, the
remainders as byte planes, and counters of a byte (255: a long of its own). As
filters are sorted, two are merged in one pass, and equal keys add up.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the four rounds: any odd numbers permute.
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
U = np.uint64


def half_bits(n: int, width: int) -> int:
    """Bits of each half of an n-gram of two or three ids; width is at most 32."""
    return width if n == 2 else (3 * width + 1) // 2


def _mask(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


def pack(ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = [i.astype(np.uint64) for i in ids]
    if len(ids) == 2:
        return ids[0], ids[1]
    h = half_bits(3, width)
    low = (ids[1] << U(width)) | ids[2]
    return (ids[0] << U(2 * width - h)) | (low >> U(h)), low & _mask(h)


def unpack(left: np.ndarray, right: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    if n == 2:
        return [left, right]
    h = half_bits(3, width)
    over = 2 * width - h
    low = ((left & _mask(over)) << U(h)) | right
    return [left >> U(over), low >> U(width), low & _mask(width)]


def _mix(x: np.ndarray, k: int, h: int) -> np.ndarray:
    x = (x + U(k & 0xFFFFFFFF)) * U(k)
    x ^= x >> U(29)
    x *= U(ROUNDS[0])
    return (x >> U(64 - h)) & _mask(h)


def permute(left: np.ndarray, right: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    for k in ROUNDS:
        left, right = right, left ^ _mix(right, k, h)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    for k in reversed(ROUNDS):
        left, right = right ^ _mix(left, k, h), left
    return left, right


def summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sum of its counts. Sorted runs are merged, not sorted anew."""
    if not len(left):
        return left, right, counts
    if 2 * h <= 64:
        key = (left << U(h)) | right
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    else:
        order = np.lexsort((right, left))
        a, b = left[order], right[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    at = order[first]
    return left[at], right[at], np.add.reduceat(counts[order], first)


def encode(left: np.ndarray, right: np.ndarray, counts: np.ndarray, h: int, bucket_bits: int) -> bytes:
    """The filter of sorted keys of one bucket."""
    n, free = len(left), h - bucket_bits
    q = min(free, max(0, n.bit_length() - 1))
    inner = left & _mask(free)
    quotient, rest = (inner >> U(free - q)).astype(np.int64), inner & _mask(free - q)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.ones(n, bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    large = counts >= 255
    planes = [(part >> U(8 * i)).astype(np.uint8).tobytes() for part, bits in ((right, h), (rest, free - q)) for i in range(-(-bits // 8))]
    head = np.array([n, q, large.sum()], "<u8")
    return b"".join([head.tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), *planes, np.where(large, 255, counts).astype(np.uint8).tobytes(), counts[large].astype("<u8").tobytes()])


def decode(data: bytes, h: int, bucket_bits: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counts of a filter."""
    n, q, large = (int(x) for x in np.frombuffer(data, "<u8", 3))
    free, at = h - bucket_bits, 24

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    occupied = np.unpackbits(take(-(-(1 << q) // 8)))[: 1 << q]
    ends = np.unpackbits(take(-(-n // 8)))[:n]
    run = np.cumsum(ends) - ends
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    parts = []
    for bits in (h, free - q):
        value = np.zeros(n, np.uint64)
        for i in range(-(-bits // 8)):
            value |= take(n).astype(np.uint64) << U(8 * i)
        parts.append(value)
    counts = take(n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", large, at).astype(np.int64)
    return (U(bucket) << U(free)) | (quotient << U(free - q)) | parts[1], parts[0], counts


class Merger:
    """Filters of one bucket merged as they come: a run of each order of size is held, so each key is merged a logarithmic number of times."""

    def __init__(self, h: int):
        self.h, self.runs = h, []

    def add(self, run: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        while self.runs and len(self.runs[-1][0]) <= 2 * len(run[0]):
            other = self.runs.pop()
            run = summed(*(np.concatenate(pair) for pair in zip(other, run)), self.h)
        self.runs.append(run)

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.runs:
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        return summed(*(np.concatenate(x) for x in zip(*self.runs)), self.h)
