"""Word shingles of whole Arrow batches of texts, with numpy and no loop over words."""

from __future__ import annotations

import numpy as np

WORDS = 5
CHUNK = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads each input bit over all 64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK)
        _POWERS[:] = [np.concatenate([np.ones(1, U), np.full(size, b, U)]).cumprod(dtype=U) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def chunks(texts):
    """(first row, Arrow slice of about CHUNK bytes) of a string array; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else []
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHUNK, "right")))
        hi = min(hi, lo + 60_000)
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def _runs_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, from prefix sums of a polynomial."""
    power, inverse = _powers(len(data))
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, UTF-8 bytes of all texts, start and end of each word there) of a non-null Arrow string array."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], "u1")[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, "u1")
    offsets = offsets - offsets[0]
    none = np.zeros(0, "i8")
    if not len(data):
        return none, data, none, none
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], ~solid[:-1]]) | edge[:-1]
    after = np.concatenate([~solid[1:], [True]]) | edge[1:]
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return np.searchsorted(offsets, starts, "right") - 1, data, starts, ends


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, 64-bit hash of each word)."""
    row, data, starts, ends = words(texts)
    return row, _runs_hash(data, starts, ends) if len(row) else np.zeros(0, U)


def _shape_bytes() -> np.ndarray:
    """Capital, small (and any byte beyond ASCII) and digit each become one byte; others stay."""
    out = np.arange(256, dtype="u1")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("a") : ord("z") + 1] = ord("a")
    out[128:] = ord("a")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


def word_and_shape_hashes(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash of the word, hash of its shape with runs of equal bytes as one) of each word."""
    row, data, starts, ends = words(texts)
    if not len(row):
        return row, np.zeros(0, U), np.zeros(0, U)
    shape = _shape_bytes()[data]
    kept = np.ones(len(shape), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    return row, _runs_hash(data, starts, ends), _runs_hash(shape[kept], place[starts], place[ends])


def shingles(texts, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 48-bit shingle, times in the row), sorted by row and shingle.

    A text of fewer words is one shingle; one without words has none.
    """
    row, h = word_hashes(texts)
    n = len(h)
    if not n:
        return np.zeros(0, "i8"), np.zeros(0, U), np.zeros(0, "i8")
    acc = np.zeros(max(0, n - size + 1), U)
    for k in range(size):
        acc = acc * U(0xD6E8FEB86659FD93) + h[k : n - size + 1 + k] if len(acc) else acc
    whole = row[: len(acc)] == row[size - 1 :] if len(acc) else np.zeros(0, bool)
    keys = [(row[: len(acc)][whole].astype(U) << U(48)) | (mix(acc[whole]) >> U(16))]
    counts = np.bincount(row)
    first = np.cumsum(counts) - counts
    for fewer in range(1, size):
        short = np.flatnonzero(counts == fewer)
        if len(short):
            acc = np.full(len(short), fewer, U)
            for k in range(fewer):
                acc = acc * U(0xD6E8FEB86659FD93) + h[first[short] + k]
            keys.append((short.astype(U) << U(48)) | (mix(acc) >> U(16)))
    keys, times = np.unique(np.concatenate(keys), return_counts=True)
    return (keys >> U(48)).astype("i8"), keys & U((1 << 48) - 1), times
