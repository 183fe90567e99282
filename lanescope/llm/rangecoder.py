"""Adaptive context-mixing range coder for blocks of token ids, many lanes at a time in numpy.

A block holds up to about a million ids and is coded on its own: models start from nothing and a CRC-32 of the ids
closes it. Its ids are dealt to lanes, each a stretch of the block with a range coder of its own; all lanes step
together and share the block's models, which they update after each step, so coder and decoder stay alike.

For each id a candidate comes from the order-2 table (last id after the two ids before it) or, where that is empty,
the order-1 table. The chance that the candidate is right is mixed in the logistic domain from three adaptive
estimates: by order-2 confidence, by order-1 confidence, and by the candidate's order-0 frequency class; the weights
learn from the errors. That share of the interval goes to the candidate and the rest to the adaptive order-0
frequencies of all ids, which are taken anew each time the count of coded ids has grown by half. All arithmetic
is in integers, so that any machine decodes what another one coded.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"LCM2"
HEAD = struct.Struct("<4sIIII")  # magic, ids, size of the vocabulary, lanes, CRC-32
LANES, MIN_STEPS = 16384, 64
TOTAL, SLOTS, HASH = 24, 20, 18  # bits of the coder's scale, of the order-0 scale, of the order-2 table
EVERY = 4  # steps between updates of the estimates and weights
STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int64)
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)
#: Confidences of either order, agreement, frequency class: one number for all that a prediction depends on.
CELLS = (32, 32, 32)
BITS = np.array([int(x).bit_length() for x in range(1 << 12)], np.int32)
LOST = np.array([n - (n >> 1) for n in range(16)], np.int32)  # what a wrong candidate of confidence n loses


class Models:
    def __init__(self, n_ids: int):
        self.n_ids = n_ids
        self.one = np.zeros(n_ids, np.int32)  # id << 4 | confidence
        self.two = np.zeros(1 << HASH, np.int32)
        self.hit = [np.full(n, 1, np.int64) for n in CELLS]
        self.all = [np.full(n, 3, np.int64) for n in CELLS]
        self.weights = np.array([20000, 20000, 10000], np.int64)
        self.seen = np.zeros(n_ids, np.int64)
        self.waiting: list[np.ndarray] = []
        self.coded = self.next = 0
        self.log: list[tuple[np.ndarray, np.ndarray]] = []
        self._estimates()
        self._frequencies()

    def _estimates(self) -> None:
        """The chance and the share of the interval of a candidate in every cell."""
        self.x = [STRETCH[np.clip(4095 * h // a, 1, 4094)] for h, a in zip(self.hit, self.all, strict=True)]
        two, one, zero = (x * w for x, w in zip(self.x, self.weights, strict=True))
        dot = (two[:, None, None] + one[None, :, None] + zero[None, None, :]) >> 16
        self.p = SQUASH[np.clip(dot, -2047, 2047) + 2047]
        share = np.minimum(self.p, 3840) << (TOTAL - 12)
        share[:2, :2] = 1 << 12  # no order has a candidate
        self.share = share.ravel().astype(np.int32)

    def _frequencies(self) -> None:
        for ids in self.waiting:
            self.seen += np.bincount(ids, minlength=self.n_ids)
        self.waiting = []
        n = int(self.seen.sum())
        f = 1 + self.seen * ((1 << SLOTS) - self.n_ids) // max(n, 1)
        f[0] += (1 << SLOTS) - int(f.sum())
        self.low = np.concatenate([[0], np.cumsum(f)]).astype(np.int64)
        self.slot = np.repeat(np.arange(self.n_ids, dtype=np.int32), f)
        self.klass = np.minimum(31, BITS[np.minimum(f, 4095)])
        self.next = self.coded + max(2048, self.coded // 2)

    def predict(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(candidate, share of the interval) after the ids a, b of each lane."""
        self.h = (a * np.int32(40503) ^ b * np.int32(-1640531535)) >> np.int32(32 - HASH) & np.int32((1 << HASH) - 1)
        self.b = b
        self.e2, self.e1 = self.two[self.h], self.one[b]
        self.c2, self.c1 = self.e2 >> 4, self.e1 >> 4
        self.n2, self.n1 = self.e2 & 15, self.e1 & 15
        c = np.where(self.n2 > 0, self.c2, self.c1)
        agree = (self.c1 == self.c2) * np.int32(1 << 10 | 1 << 5)
        self.cell = (self.n2 << 11) + (self.n1 << 6) + agree + self.klass[c]
        return c, self.share[self.cell]

    def update(self, x: np.ndarray, hit: np.ndarray) -> None:
        self.log.append((self.cell, hit))
        fresh = (x << 4) | np.int32(1)
        for table, at, e, c, n in ((self.two, self.h, self.e2, self.c2, self.n2), (self.one, self.b, self.e1, self.c1, self.n1)):
            wrong = np.where(n > 1, e - LOST[n], fresh)
            table[at] = np.where((c == x) & (n > 0), e + (n < 15), wrong)
        self.waiting.append(x)
        self.coded += len(x)
        if len(self.log) == EVERY:
            cell, hit = (np.concatenate(v) for v in zip(*self.log, strict=True))
            self.log = []
            every, good = (np.bincount(v, minlength=1 << 15).reshape(CELLS) for v in (cell, cell[hit]))
            err = (good << 12) - every * self.p
            for k, others in enumerate(((1, 2), (0, 2), (0, 1))):
                self.weights[k] += (int((err.sum(others) * self.x[k]).sum()) // len(cell)) >> 4
                self.hit[k] += good.sum(others)
                self.all[k] += every.sum(others)
                old = self.all[k] > 1 << 16
                self.hit[k][old] >>= 1
                self.all[k][old] >>= 1
            self.weights = np.clip(self.weights, -(1 << 18), 1 << 18)
            self._estimates()
        if self.coded >= self.next:
            self._frequencies()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // MIN_STEPS))
    steps = -(-n // lanes)
    return -(-n // steps) if steps else 1, steps


def placed(m: Models, x: np.ndarray, p: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of each lane's id on the coder's scale: the candidate has the first p, the order-0 model the rest."""
    start, freq = np.zeros(len(x), np.uint64), p.astype(np.uint64)
    miss = np.flatnonzero(~hit)
    y, q = x[miss], p[miss]
    rest = (1 << TOTAL) - q
    lo, hi = m.low[y] * rest >> SLOTS, m.low[y + 1] * rest >> SLOTS
    start[miss], freq[miss] = q + lo, hi - lo
    return start, freq


def encode_block(ids: np.ndarray) -> bytes:
    """ids: unsigned integers under 2^19. An empty block is a header alone."""
    n = len(ids)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return HEAD.pack(MAGIC, 0, 0, 0, crc)
    n_ids = int(ids.max()) + 1
    if n_ids > 1 << (SLOTS - 1):
        raise ValueError(f"ids must be under {1 << (SLOTS - 1)}")
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    m = Models(n_ids)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    words, used = np.zeros((lanes, steps + 4), np.uint32), np.zeros(lanes, np.int64)
    a = b = np.zeros(lanes, np.int32)
    shift, least, half = np.uint64(TOTAL), np.uint64(1 << 32), np.uint64(32)

    def carry(who: np.ndarray) -> None:
        at = used[who] - 1
        while len(who):
            words[who, at] += np.uint32(1)
            on = words[who, at] == 0
            who, at = who[on], at[on] - 1

    for x in grid:
        c, p = m.predict(a, b)
        hit = x == c
        start, freq = placed(m, x, p.astype(np.int64), hit)
        r = size >> shift
        new = low + start * r
        if (over := new < low).any():
            carry(np.flatnonzero(over))
        low, size = new, freq * r
        if len(out := np.flatnonzero(size < least)):
            words[out, used[out]] = (low[out] >> half).astype(np.uint32)
            used[out] += 1
            low[out] <<= half
            size[out] <<= half
        m.update(x, hit)
        a, b = b, x
    last = low + np.uint64(2**32 - 1)
    if (over := last < low).any():
        carry(np.flatnonzero(over))
    words[np.arange(lanes), used] = (last >> half).astype(np.uint32)
    used += 1
    body = words[np.arange(steps + 4)[None, :] < used[:, None]]
    return HEAD.pack(MAGIC, n, n_ids, lanes, crc) + used.astype("<u4").tobytes() + body.astype("<u4").tobytes()


def decode_block(block: bytes) -> np.ndarray:
    """The ids; an error if the block isn't whole."""
    magic, n, n_ids, lanes, crc = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of ids")
    if not n:
        return np.zeros(0, np.uint32)
    steps = -(-n // lanes)
    used = np.frombuffer(block, "<u4", lanes, HEAD.size).astype(np.int64)
    body = np.frombuffer(block, "<u4", -1, HEAD.size + 4 * lanes)
    if len(body) != used.sum():
        raise ValueError("a block of ids is cut short")
    words = np.concatenate([body, np.zeros(4, "<u4")]).astype(np.uint64)
    end = np.cumsum(used)
    at = end - used
    none = len(words) - 1

    def take(who: np.ndarray) -> np.ndarray:
        got = words[np.where(at[who] < end[who], at[who], none)]
        at[who] += 1
        return got

    every = np.arange(lanes)
    half, shift, least, top = np.uint64(32), np.uint64(TOTAL), np.uint64(1 << 32), np.uint64((1 << TOTAL) - 1)
    value = take(every) << half
    value |= take(every)
    size = np.full(lanes, 2**64 - 1, np.uint64)
    m = Models(n_ids)
    a = b = np.zeros(lanes, np.int32)
    grid = np.zeros((steps, lanes), np.int32)
    for k in range(steps):
        c, p = m.predict(a, b)
        p = p.astype(np.int64)
        r = size >> shift
        d = np.minimum(value // r, top).astype(np.int64)
        hit = d < p
        x = c.copy()
        miss = np.flatnonzero(~hit)
        over = d[miss] - p[miss]
        x[miss] = m.slot[np.minimum((((over + 1) << SLOTS) - 1) // ((1 << TOTAL) - p[miss]), (1 << SLOTS) - 1)]
        start, freq = placed(m, x, p, hit)
        value, size = value - start * r, freq * r
        if len(out := np.flatnonzero(size < least)):
            value[out] = (value[out] << half) | take(out)
            size[out] <<= half
        m.update(x, hit)
        grid[k] = x
        a, b = b, x
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of ids fails its checksum")
    return ids
