"""An adaptive context-mixing range coder for token ids, over many blocks in step.

A block is coded from a fresh model and so stands alone. Ids are numbered in the
order in which a block first shows them, and three predictors share out the
probability of the next number: order 2 (all on the one last seen after this pair,
by a hashed table), order 1 (after this one) and order 0 (by counts of all numbers
so far, and of news). A number's probability is the sum over the orders of weight
times share, and it is coded as one interval of that sum. Orders 2 and 1 carry a
confidence of 0 to 3 hits; for every pair of confidences the weights are the sums of
what each order gave to the numbers that came. A number that no order names is
coded as news, and its id written out: its high byte by counts, its low byte as it is.

All blocks of a call move one id a step, so numpy's calls are shared by
thousands of blocks. Encoder and decoder run the same model code.

Block: ``SLB3``, number of ids, crc32 of the ids (little-endian 32-bit), number
of 32-bit digits, digits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, HEADER = b"SLB3", struct.Struct("<4sIII")
BLOCK = 4096
SLOT_BITS, MIX_BITS, ZERO_BITS, HIGH_BITS = 12, 12, 18, 14
BITS = MIX_BITS + ZERO_BITS  # of a mixed probability; below 32, as the coder's range is above 2**32
#: (below this step, steps between two tables of order 0).
REFRESH = ((64, 8), (512, 32), (1 << 62, 128))
U, U32 = np.uint64, np.uint64(32)
LOW = U(0xFFFFFFFF)


class BadBlock(ValueError):
    """A block that is cut, not of this format, or fails its checksum."""


class _Model:
    def __init__(self, blocks: int, vocabulary: int, steps: int):
        slots, width = 1 << SLOT_BITS, steps + 2
        self.guess = [np.zeros(blocks * slots, "u2" if width < 1 << 16 else "u4") for _ in range(2)]  # orders 2 and 1; 0 is none
        self.trust = [np.zeros(blocks * slots, "u1") for _ in range(2)]
        self.right = np.ones((blocks * 16, 3), "f4")  # by the two confidences: what orders 2, 1 and 0 gave
        self.right[:, 2] = 2
        self.high = (max(1, vocabulary - 1) >> 8) + 1
        self.highs = (1 + np.rint(16 / (1 + np.arange(self.high)))).astype("f4") * np.ones((blocks, 1), "f4")  # low ids are common ones
        self.names = np.zeros((blocks, width), "u4")  # ids by number, from 1
        self.size, self.known = np.zeros(blocks, "i8"), np.zeros(blocks, "i8")  # numbers given, and in the table
        self.counts = np.zeros((blocks, width), "f4")  # place 0 counts what the table hadn't
        self.counts[:, 0] = 1
        self.base, self.base16 = np.arange(blocks) * slots, np.arange(blocks) * 16
        self.last, self.before = np.zeros(blocks, "i8"), np.zeros(blocks, "i8")
        self.rows = np.arange(blocks)

    @staticmethod
    def _ranges(c: np.ndarray, bits: int) -> np.ndarray:
        """Sums of whole shares of 2**bits by counts; each positive count has one at least, the first the rest.

        Counts are multiples of a half, so sums are exact and a block's ranges don't depend on the others.
        """
        some = c > 0
        share = (1 << bits) - some.sum(axis=1, keepdims=True)
        scale = (share * (1 - 1e-5) / c.sum(axis=1, keepdims=True, dtype="f8")).astype("f4")  # so that rounding up can't pass the share
        f = (c * scale).astype("i4")
        f += some
        f[:, 0] += (1 << bits) - f.sum(axis=1, dtype="i4")
        sums = np.zeros((len(c), c.shape[1] + 1), "i4")
        np.cumsum(f, axis=1, out=sums[:, 1:])
        return sums

    def refresh(self, n: int, step: int) -> None:
        """The ranges of order 0 and of high bytes from the counts so far."""
        if step % next(every for below, every in REFRESH if step < below):
            return
        self.known[:n] = self.size[:n]
        self.sums = self._ranges(self.counts[:n, : int(self.size[:n].max()) + 1], ZERO_BITS)
        self.zero, self.zero_base = self.sums.ravel(), self.rows[:n] * self.sums.shape[1]
        self.high_sums = self._ranges(self.highs[:n], HIGH_BITS)
        above = self.rows[:n, None] << 32
        self.flat, self.high_flat = (self.sums + above).ravel(), (self.high_sums + above).ravel()

    def predict(self, n: int):
        """Guesses and weights of orders 2 and 1 (of 2**MIX_BITS) for the first n blocks."""
        mask = (1 << SLOT_BITS) - 1
        h1 = self.last[:n] & mask
        h2 = (self.last[:n] * 40503 + self.before[:n] * 30727) >> 3 & mask
        self.slot = (self.base[:n] + h2, self.base[:n] + h1)
        g2, g1 = (self.guess[k][self.slot[k]].astype("i8") for k in (0, 1))
        t2, t1 = (self.trust[k][self.slot[k]].astype("i8") for k in (0, 1))
        self.context = self.base16[:n] + t2 * 4 + t1
        r = self.weights = self.right.take(self.context, axis=0)
        scale = ((1 << MIX_BITS) - 4) / r.sum(axis=1)
        return g2, g1, 1 + (r[:, 0] * scale).astype("i8"), 1 + (r[:, 1] * scale).astype("i8")

    def below(self, k: np.ndarray) -> np.ndarray:
        """The shares of order 0 below each block's number."""
        return self.zero.take(self.zero_base[: len(k)] + np.minimum(k, self.sums.shape[1] - 1))

    def mixed(self, k: np.ndarray, g2: np.ndarray, g1: np.ndarray, f2: np.ndarray, f1: np.ndarray):
        """Begin of each number's interval of 2**BITS, and what orders 2, 1 and 0 give to it."""
        f0 = (1 << MIX_BITS) - f2 - f1
        first, after = self.below(k), self.below(k + 1)
        begin = f0 * first + ((f2 * (g2 < k) + f1 * (g1 < k)) << ZERO_BITS)
        given = (f2 * (g2 == k) << ZERO_BITS, f1 * (g1 == k) << ZERO_BITS, f0 * (after - first))
        return begin, given

    def find(self, v: np.ndarray, g2: np.ndarray, g1: np.ndarray, f2: np.ndarray, f1: np.ndarray) -> np.ndarray:
        """The number in whose interval each v of 2**BITS lies: one of the two guesses, else one of order 0, whose place
        v has once the guesses below it are taken off."""
        f0, off = (1 << MIX_BITS) - f2 - f1, np.zeros(len(v), "i8")
        k = np.full(len(v), -1, "i8")
        swap, same = g1 < g2, g1 == g2
        for g, f in ((np.minimum(g1, g2), np.where(swap, f1, f2) + np.where(same, f1, 0)), (np.maximum(g1, g2), np.where(same, 0, np.where(swap, f2, f1)))):
            begin, end = f0 * self.below(g) + off, f0 * self.below(g + 1) + off + (f << ZERO_BITS)
            k = np.where((k < 0) & (v >= begin) & (v < end), g, k)
            off += np.where(v >= end, f << ZERO_BITS, 0)
        rest = np.flatnonzero(k < 0)
        k[rest] = _place(self.flat, self.sums.shape[1], rest, (v[rest] - off[rest]) // f0[rest])
        return k

    def number_of(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of ids that the table hasn't: given since it was made, or the next one."""
        out = self.size[rows] + 1
        wide = int((out - 1 - self.known[rows]).max(initial=0))
        if wide:
            places = self.known[rows][:, None] + np.arange(1, wide + 1)
            hit = (self.names[rows[:, None], np.minimum(places, self.names.shape[1] - 1)] == ids[:, None]) & (places < out[:, None])
            at = hit.argmax(axis=1)
            out = np.where(hit[np.arange(len(rows)), at], self.known[rows] + 1 + at, out)
        return out

    def learn(self, n: int, x: np.ndarray, given: tuple, g2: np.ndarray, g1: np.ndarray, spelt: np.ndarray, ids: np.ndarray) -> None:
        share = 1 / (given[0] + given[1] + given[2])
        for k, g in enumerate(given):
            self.weights[:, k] += g * share
        self.right[self.context] = self.weights
        for k, g in ((0, g2), (1, g1)):
            slot, hit = self.slot[k], g == x
            trust = self.trust[k][slot]
            self.trust[k][slot] = np.where(hit, np.minimum(trust + 1, 3), 1)
            self.guess[k][slot] = x
        if len(spelt):
            self.counts[spelt, 0] += 0.5
            self.highs[spelt, ids >> 8] += 1
            new = x[spelt] > self.size[spelt]
            fresh = spelt[new]
            self.size[fresh] += 1
            self.names[fresh, self.size[fresh]] = ids[new]
        self.counts.ravel()[self.rows[:n] * self.counts.shape[1] + x] += 1
        self.before[:n] = self.last[:n]
        self.last[:n] = x


def _numbers(ids: np.ndarray) -> np.ndarray:
    """Ids by the order in which they first come, from 1."""
    _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
    return (np.argsort(np.argsort(first)) + 1)[inverse]


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """One encoded block for each array of ids (all below ``vocabulary``)."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lens = np.array([len(blocks[i]) for i in order], "i8")
    b, steps = len(order), int(lens[0]) if len(lens) else 0
    ids, numbers = np.zeros((steps, b), "i8"), np.zeros((steps, b), "i8")
    for j, i in enumerate(order):
        if lens[j]:
            ids[: lens[j], j], numbers[: lens[j], j] = blocks[i], _numbers(blocks[i])
    model = _Model(b, vocabulary, steps)
    low, wide, at = np.zeros(b, U), np.full(b, ~U(0)), np.zeros(b, "i8")
    digits = np.zeros((b, steps * 2 + 4), U)

    def put(rows, start, size, bits):
        r = wide[rows] >> U(bits)
        old = low[rows]
        new = old + start.astype(U) * r
        over = new < old
        if over.any():
            digits[rows[over], at[rows[over]] - 1] += U(1)
        r *= size.astype(U)
        out = r <= LOW
        if out.any():
            k = rows[out]
            digits[k, at[k]] = new[out] >> U32
            at[k] += 1
            new[out] <<= U32
            r[out] <<= U32
        low[rows], wide[rows] = new, r

    for t in range(steps):
        n = int(np.searchsorted(-lens, -t, "left"))
        model.refresh(n, t)
        x = numbers[t, :n]
        g2, g1, f2, f1 = model.predict(n)
        k = np.where((x <= model.known[:n]) | (x == g2) | (x == g1), x, 0)
        begin, given = model.mixed(k, g2, g1, f2, f1)
        put(model.rows[:n], begin, given[0] + given[1] + given[2], BITS)
        spelt = np.flatnonzero(k == 0)
        y = ids[t, spelt]
        if len(spelt):
            first = model.high_sums[spelt, y >> 8].astype("i8")
            f = model.high_sums[spelt, (y >> 8) + 1] - first
            put(spelt, (first << 8) + (y & 255) * f, f, HIGH_BITS + 8)
        model.learn(n, x, given, g2, g1, spelt, y)
    rows = np.arange(b)
    for _ in range(2):
        digits[rows, at] = low >> U32
        low <<= U32
        at += 1
    while (over := digits >> U32).any():  # carries move to the digit before
        digits &= LOW
        digits[:, :-1] += over[:, 1:]
    out: list[bytes] = [b""] * b
    for j, i in enumerate(order):
        body = digits[j, : at[j]].astype("<u4").tobytes()
        out[i] = HEADER.pack(MAGIC, lens[j], zlib.crc32(blocks[i].astype("<u4").tobytes()), at[j]) + body
    return out


def _place(flat: np.ndarray, width: int, rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The last place whose range begins at or before v, by one search in the sums of all rows, which lie one above another."""
    return np.searchsorted(flat, v + (rows << 32), "right") - 1 - rows * width


def split_blocks(data: bytes) -> list[bytes]:
    """The blocks of a payload of blocks one after another."""
    out, at = [], 0
    while at < len(data):
        if len(data) - at < HEADER.size or data[at : at + 4] != MAGIC:
            raise BadBlock("no block begins here")
        end = at + HEADER.size + 4 * HEADER.unpack_from(data, at)[3]
        if end > len(data):
            raise BadBlock("cut block")
        out.append(data[at:end])
        at = end
    return out


def decode_blocks(blocks: list[bytes], vocabulary: int) -> list[np.ndarray]:
    """The ids (uint32) of each block; raises BadBlock if a checksum differs."""
    heads = [HEADER.unpack_from(x) for x in blocks]
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][1])
    lens = np.array([heads[i][1] for i in order], "i8")
    b, steps = len(order), int(lens[0]) if len(lens) else 0
    digits = np.zeros((b, max([0, *(h[3] for h in heads)]) + 3), U)
    for j, i in enumerate(order):
        if heads[i][0] != MAGIC or len(blocks[i]) != HEADER.size + 4 * heads[i][3]:
            raise BadBlock("cut block")
        digits[j, : heads[i][3]] = np.frombuffer(blocks[i], "<u4", offset=HEADER.size)
    model = _Model(b, vocabulary, steps)
    code, wide, at = (digits[:, 0] << U32) | digits[:, 1], np.full(b, ~U(0)), np.full(b, 2, "i8")
    ids, width = np.zeros((steps, b), "i8"), digits.shape[1] - 1

    def take(rows, start, size, r, have):
        have = have - start.astype(U) * r
        r = r * size.astype(U)
        out = r <= LOW
        if out.any():
            k = rows[out]
            have[out] = (have[out] << U32) | digits[k, np.minimum(at[k], width)]
            at[k] += 1
            r[out] <<= U32
        code[rows], wide[rows] = have, r

    for t in range(steps):
        n = int(np.searchsorted(-lens, -t, "left"))
        model.refresh(n, t)
        g2, g1, f2, f1 = model.predict(n)
        r = wide[:n] >> U(BITS)
        x = model.find(np.minimum(code[:n] // r, U((1 << BITS) - 1)).astype("i8"), g2, g1, f2, f1)
        begin, given = model.mixed(x, g2, g1, f2, f1)
        take(model.rows[:n], begin, given[0] + given[1] + given[2], r, code[:n])
        spelt, y = np.flatnonzero(x == 0), np.zeros(0, "i8")
        if len(spelt):
            r, have = wide[spelt] >> U(HIGH_BITS + 8), code[spelt]
            v = np.minimum(have // r, U((1 << (HIGH_BITS + 8)) - 1)).astype("i8")
            high = _place(model.high_flat, model.high_sums.shape[1], spelt, v >> 8)
            first = model.high_sums[spelt, high].astype("i8")
            f = model.high_sums[spelt, high + 1] - first
            low = np.minimum((v - (first << 8)) // f, 255)
            take(spelt, (first << 8) + low * f, f, r, have)
            y = (high << 8) | low
            x[spelt] = model.number_of(spelt, y)
        # a damaged block may name numbers that were never given
        x = np.minimum(x, model.names.shape[1] - 1)
        model.learn(n, x, given, g2, g1, spelt, y)
        ids[t, :n] = model.names[model.rows[:n], x]
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * b
    for j, i in enumerate(order):
        got = ids[: lens[j], j].astype("<u4")
        if zlib.crc32(got.tobytes()) != heads[i][2]:
            raise BadBlock("checksum differs")
        out[i] = got
    return out
