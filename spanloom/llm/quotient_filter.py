"""Counting quotient filters over packed n-grams of word numbers.

An n-gram of numbers below 2**bits is packed into one integer and permuted by a
Feistel network, which can be undone. The permuted value is cut into a shard
number, a quotient and the full remainder, so nothing is lost: shard, place and
remainder give the n-gram back. A filter holds, in the order of the permuted
values, the run length of each quotient, the remainders in as few bytes as they
need, and counters of one byte with the larger ones apart. Filters of a shard are
sorted alike, so they are merged by one pass over sorted values.

Values are two halves (left, right) of at most 63 bits each, as uint64 arrays.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

U = np.uint64
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def half_bits(size: int, bits: int) -> int:
    half = -(-size * bits // 2)
    if half > 63:
        raise ValueError(f"{size} word numbers of {bits} bits don't fit two halves of 63")
    return half


def packed(grams: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of n-grams given as one array of numbers a place."""
    half = half_bits(len(grams), bits)
    mask = U((1 << half) - 1)
    left, right = np.zeros(len(grams[0]), U), np.zeros(len(grams[0]), U)
    for g in grams:
        left = ((left << U(bits)) | (right >> U(half - bits))) & mask
        right = ((right << U(bits)) & mask) | g.astype(U)
    return left, right


def unpacked(left: np.ndarray, right: np.ndarray, size: int, bits: int) -> np.ndarray:
    """n-grams as rows."""
    half = half_bits(size, bits)
    out = np.empty((len(left), size), "i8")
    for k in range(size - 1, -1, -1):
        out[:, k] = right & U((1 << bits) - 1)
        right = (right >> U(bits)) | ((left & U((1 << bits) - 1)) << U(half - bits))
        left = left >> U(bits)
    return out


def permuted(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U((1 << half) - 1)
    for c in ROUNDS:
        left, right = right, left ^ (mix(right + U(c)) & mask)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U((1 << half) - 1)
    for c in reversed(ROUNDS):
        left, right = right ^ (mix(left + U(c)) & mask), left
    return left, right


def summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values with the sums of their counts (ones if none are given)."""
    if not len(left):
        return left, right, np.zeros(0, "i8")
    if 2 * half <= 64:
        key = (left << U(half)) | right
        order = np.argsort(key, kind="stable") if counts is not None else None
        key = np.sort(key) if order is None else key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        left, right = key[first] >> U(half), key[first] & U((1 << half) - 1)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        left, right = left[first], right[first]
    if counts is None:
        return left, right, np.diff(np.append(first, len(order if order is not None else key)))
    return left, right, np.add.reduceat(counts[order], first)


def _bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view("u1").reshape(-1, 8)[:, :width]).tobytes()


def _values(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), "u1")
    out[:, :width] = np.frombuffer(data, "u1", n * width, at).reshape(n, width)
    return out.view("<u8").ravel().astype(U), at + n * width


def encoded(left: np.ndarray, right: np.ndarray, counts: np.ndarray, half: int, shard_bits: int) -> bytes:
    """A filter of sorted distinct values of one shard (the top ``shard_bits`` of left)."""
    free = half - shard_bits
    q = min(free, max(0, int(len(left) - 1).bit_length()))
    rest = free - q
    runs = np.bincount(((left >> U(rest)) & U((1 << q) - 1)).astype("i8"), minlength=1 << q)
    more = np.flatnonzero(counts >= 255)
    long = np.flatnonzero(runs >= 255)
    head = np.array([len(left), q, len(more), len(long)], "<u8").tobytes()
    parts = [head, np.minimum(runs, 255).astype("u1").tobytes(), runs[long].astype("<u8").tobytes()]
    parts += [_bytes(left & U((1 << rest) - 1), -(-rest // 8)), _bytes(right, -(-half // 8))]
    parts += [np.minimum(counts, 255).astype("u1").tobytes(), counts[more].astype("<u8").tobytes()]
    return b"".join(parts)


def decoded(data: bytes, half: int, shard: int, shard_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, counts) of a filter, sorted."""
    n, q, more, long = (int(x) for x in np.frombuffer(data, "<u8", 4))
    free = half - shard_bits
    rest, at = free - q, 32
    runs = np.frombuffer(data, "u1", 1 << q, at).astype("i8")
    at += 1 << q
    runs[runs == 255] = np.frombuffer(data, "<u8", long, at).astype("i8")
    at += 8 * long
    low, at = _values(data, at, n, -(-rest // 8))
    right, at = _values(data, at, n, -(-half // 8))
    counts = np.frombuffer(data, "u1", n, at).astype("i8")
    counts[counts == 255] = np.frombuffer(data, "<u8", more, at + n).astype("i8")
    left = np.repeat(np.arange(1 << q, dtype="u8"), runs) << U(rest) | low
    return left | U(shard) << U(free), right, counts


def merged(filters: list[tuple[np.ndarray, np.ndarray, np.ndarray]], half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted filter of several."""
    if len(filters) == 1:
        return filters[0]
    left, right, counts = (np.concatenate(x) for x in zip(*filters, strict=True))
    return summed(left, right, counts, half)
