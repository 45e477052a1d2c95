"""Adaptive context-mixing range coder for token ids, many blocks side by side in numpy.

A block is coded alone: its model starts afresh and its bytes carry a checksum, so blocks can be decoded in any
order and damage stays in one. Ids are predicted at three orders: order 2 and order 1 remember the id that last
followed the two ids, or the one id, before; order 0 is the list of ids the block has had so far. An id is one of
four events: the order-2 prediction, the order-1 prediction, a known id of order 0, or a new id. Three adaptive
estimates of the event (by order-2 confidence, by order-1 confidence and the event before, and without
context) are mixed with weights that follow how well each has predicted; the mixture drives the range coder.
Known ids are then coded by their place in the list, new ones by number, both as equally likely.

Lanes (blocks) advance in step, so a step is a fixed number of numpy operations on one value per lane. Only sums,
products and quotients of doubles are used, which give the same bits everywhere.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .common import ship

ship(__name__)

SLOTS1, SLOTS2 = 1 << 11, 1 << 12
EVENTS, SCALE = 4, 1 << 12
HIT2, HIT1, KNOWN, NEW = range(4)
LANES = 1024
HEAD, HEAD_SIZE = "<II", 8
U16, U32, U48 = np.uint64(0xFFFF), np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFFFFFF)
B16, B32 = np.uint64(16), np.uint64(32)


class _Model:
    """What has been learned in each lane."""

    def __init__(self, lanes: int, vocab: int, steps: int, places: bool = True):
        self.vocab, self.steps, self.places = vocab, steps, places
        self.lane = np.arange(lanes)
        self.pred1, self.pred2 = np.full(lanes * SLOTS1, -1, dtype=np.int32), np.full(lanes * SLOTS2, -1, dtype=np.int32)
        self.conf1, self.conf2 = np.zeros(lanes * SLOTS1, dtype=np.int8), np.zeros(lanes * SLOTS2, dtype=np.int8)
        # event estimates of a lane: 8 by order-2 confidence, 16 by order-1 confidence and last event, one without context
        self.estimates = np.full((lanes * 25, EVENTS), 0.4)
        self.first = self.lane * 25
        self.weights = np.full((3, lanes), 1 / 3)
        self.last = np.zeros(lanes, dtype=np.int64)
        self.prev1, self.prev2 = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        # place in the list of known ids, from 1: only an encoder looks it up
        self.place = np.zeros(lanes * vocab if places else 0, dtype=np.int16 if steps < 1 << 15 else np.int32)
        self.known = np.zeros(lanes * steps, dtype=np.int32)
        self.n_known = np.zeros(lanes, dtype=np.int64)

    def shrink(self, n: int) -> None:
        """Go on with the first n lanes."""
        for name in ("lane", "first", "last", "prev1", "prev2", "n_known"):
            setattr(self, name, getattr(self, name)[:n])
        self.weights = self.weights[:, :n]

    def predict(self) -> np.ndarray:
        """Cumulative frequencies of the events (lanes x 5, up to SCALE)."""
        self.at1 = self.lane * SLOTS1 + ((self.prev1 * 40503) >> 4) % SLOTS1
        self.at2 = self.lane * SLOTS2 + ((self.prev1 * 40503 + self.prev2 * 30011) >> 4) % SLOTS2
        self.p1, self.p2 = self.pred1[self.at1], self.pred2[self.at2]
        self.c1, self.c2 = self.conf1[self.at1], self.conf2[self.at2]
        self.rows = np.stack([self.first + self.c2 * 2 + (self.p1 == self.p2), self.first + 8 + self.c1 * 4 + self.last, self.first + 24])
        self.now = self.estimates[self.rows]  # 3 x lanes x events
        self.scaled = self.weights / (self.now[:, :, 0] + self.now[:, :, 1] + self.now[:, :, 2] + self.now[:, :, 3])
        p = self.now * self.scaled[:, :, None]
        f = ((p[0] + p[1] + p[2]) * (SCALE - EVENTS - 1)).astype(np.int64) + 1
        cum = np.zeros((len(self.lane), EVENTS + 1), dtype=np.int64)
        cum[:, 1] = f[:, 0]
        cum[:, 2] = cum[:, 1] + f[:, 1]
        cum[:, 3] = cum[:, 2] + f[:, 2]
        cum[:, 4] = SCALE
        return cum

    def event(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The event that each id is, and its place among the known ids (from 0)."""
        place = self.place[self.lane * self.vocab + ids].astype(np.int64) - 1
        e = np.where(ids == self.p2, HIT2, np.where(ids == self.p1, HIT1, np.where(place >= 0, KNOWN, NEW)))
        return e, place

    def learn(self, e: np.ndarray, ids: np.ndarray) -> None:
        n = np.arange(len(e))
        w = self.scaled * self.now[:, n, e]
        w *= 0.97 / (w[0] + w[1] + w[2])
        w += 0.01
        self.weights = w
        self.now *= 0.98
        self.now[:, n, e] += 1.0
        self.estimates[self.rows] = self.now
        self.conf2[self.at2] = np.where(ids == self.p2, np.minimum(self.c2 + 1, 3), 0)
        self.conf1[self.at1] = np.where(ids == self.p1, np.minimum(self.c1 + 1, 3), 0)
        self.pred2[self.at2] = ids
        self.pred1[self.at1] = ids
        # an id may be new although a hash slot predicted it: only unlisted ids are listed
        new = np.flatnonzero(e == NEW)
        if len(new):
            lane = self.lane[new]
            self.known[lane * self.steps + self.n_known[new]] = ids[new]
            self.n_known[new] += 1
            if self.places:
                self.place[lane * self.vocab + ids[new]] = self.n_known[new]
        self.last, self.prev2, self.prev1 = e, self.prev1, ids


def _order(blocks: list[np.ndarray]) -> list[int]:
    """Long blocks first: lanes still at work are then the first ones."""
    return sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))


def encode_blocks(blocks: list[np.ndarray], vocab: int) -> list[bytes]:
    """Bytes of every block (head, coded words)."""
    out: list[bytes] = [b""] * len(blocks)
    order = _order(blocks)
    for k in range(0, len(order), LANES):
        part = order[k : k + LANES]
        for i, data in zip(part, _encode([blocks[i] for i in part], vocab), strict=True):
            out[i] = data
    return out


def _encode(blocks: list[np.ndarray], vocab: int) -> list[bytes]:
    if not 0 < vocab <= 1 << 16:
        raise ValueError("ids must be below 65536")
    sizes = np.array([len(b) for b in blocks])
    steps, lanes = int(sizes[0]) if len(sizes) else 0, len(blocks)
    ids = np.zeros((lanes, max(1, steps)), dtype=np.int64)
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = b
    if steps and (ids.min() < 0 or ids.max() >= vocab):
        raise ValueError("an id is not below the vocabulary's size")
    columns = np.ascontiguousarray(ids.T)
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # lanes longer than each step
    m = _Model(lanes, vocab, max(1, steps))
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, U48)
    words, at = np.zeros((lanes, 3 * steps + 8), dtype=np.uint16), np.zeros(lanes, dtype=np.int64)

    def put(n: int, start, width, total) -> None:
        """Narrow the interval of the first n lanes and write the words that are settled."""
        lo, sp = low[:n], span[:n]
        sp //= total.astype(np.uint64) if isinstance(total, np.ndarray) else np.uint64(total)
        lo += start.astype(np.uint64) * sp
        sp *= width.astype(np.uint64) if isinstance(width, np.ndarray) else np.uint64(width)
        _settle(lo, sp, lambda x, top: _write(words, at, x, top))

    for t in range(steps):
        n = int(live[t])
        if n < len(m.lane):
            m.shrink(n)
        x = columns[t, :n]
        cum = m.predict()
        e, place = m.event(x)
        r = np.arange(n)
        start = cum[r, e]
        put(n, start, cum[r, e + 1] - start, SCALE)
        if (e >= KNOWN).any():
            total = np.where(e == NEW, vocab, np.where(e == KNOWN, m.n_known, 1))
            put(n, np.where(e == NEW, x, np.where(e == KNOWN, place, 0)), 1, total)
        m.learn(e, x)
    for _ in range(3):
        _write(words, at, np.arange(lanes), low >> B32)
        low[:] = (low << B16) & U48
    out = []
    for i, b in enumerate(blocks):
        body = words[i, : at[i]].astype("<u2").tobytes()
        out.append(struct.pack(HEAD, len(b), zlib.crc32(body)) + body)
    return out


def _write(words: np.ndarray, at: np.ndarray, lanes: np.ndarray, top: np.ndarray) -> None:
    words[lanes, at[lanes]] = top.astype(np.uint16)
    at[lanes] += 1


def _settle(low: np.ndarray, span: np.ndarray, shift) -> None:
    """Shift out leading words: those that low and low + span share, and where the interval has become too narrow."""
    while True:
        same = (low ^ (low + span)) < (np.uint64(1) << B32)
        narrow = span < (np.uint64(1) << B16)
        x = np.flatnonzero(same | narrow)
        if not len(x):
            return
        lo, sp = low[x], span[x]
        sp = np.where(same[x], sp, (~lo + np.uint64(1)) & U16)
        shift(x, lo >> B32)
        low[x] = (lo << B16) & U48
        span[x] = (sp << B16) & U48


def decode_blocks(data: list[bytes], vocab: int) -> list[np.ndarray]:
    """Ids of every block. Raises ValueError where bytes and checksum disagree."""
    sizes = []
    for x in data:
        n, crc = struct.unpack_from(HEAD, x)
        if zlib.crc32(x[HEAD_SIZE :]) != crc:
            raise ValueError("a block's checksum does not match its bytes")
        sizes.append(n)
    out: list = [None] * len(data)
    order = sorted(range(len(data)), key=lambda i: -sizes[i])
    for k in range(0, len(order), LANES):
        part = order[k : k + LANES]
        for i, ids in zip(part, _decode([data[i] for i in part], np.array([sizes[i] for i in part]), vocab), strict=True):
            out[i] = ids
    return out


def _decode(data: list[bytes], sizes: np.ndarray, vocab: int) -> list[np.ndarray]:
    steps, lanes = int(sizes[0]), len(data)
    bodies = [np.frombuffer(x, dtype="<u2", offset=HEAD_SIZE) for x in data]
    words = np.zeros((lanes, max(map(len, bodies)) + 4), dtype=np.uint64)
    for i, b in enumerate(bodies):
        words[i, : len(b)] = b
    at = np.full(lanes, 3)
    code = (words[:, 0] << B32) | (words[:, 1] << B16) | words[:, 2]
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, U48)
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")
    m = _Model(lanes, vocab, max(1, steps), places=False)
    out = np.zeros((max(1, steps), lanes), dtype=np.int64)

    def next_word(x: np.ndarray, top: np.ndarray) -> None:
        code[x] = ((code[x] << B16) & U48) | words[x, at[x]]
        at[x] += 1

    def value(n: int, total) -> np.ndarray:
        sp = span[:n]
        sp //= total.astype(np.uint64) if isinstance(total, np.ndarray) else np.uint64(total)
        return ((code[:n] - low[:n]) // sp).astype(np.int64)

    def take(n: int, start, width) -> None:
        lo, sp = low[:n], span[:n]
        lo += start.astype(np.uint64) * sp
        sp *= width.astype(np.uint64) if isinstance(width, np.ndarray) else np.uint64(width)
        _settle(lo, sp, next_word)

    for t in range(steps):
        n = int(live[t])
        if n < len(m.lane):
            m.shrink(n)
        cum = m.predict()
        v = value(n, SCALE)
        e = (v >= cum[:, 1]).astype(np.int64) + (v >= cum[:, 2]) + (v >= cum[:, 3])
        r = np.arange(n)
        start = cum[r, e]
        take(n, start, cum[r, e + 1] - start)
        x = np.where(e == HIT2, m.p2, m.p1).astype(np.int64)
        if (e >= KNOWN).any():
            total = np.where(e == NEW, vocab, np.where(e == KNOWN, m.n_known, 1))
            v = value(n, total)
            take(n, v, 1)
            x = np.where(e == NEW, v, np.where(e == KNOWN, m.known[m.lane * m.steps + np.minimum(v, m.steps - 1)], x))
        out[t, :n] = x
        m.learn(e, x)
    return [out[:n, i].copy() for i, n in enumerate(sizes)]
