"""A range coder for token ids, driven by mixed predictions of orders 0 to 2.

A block is coded on its own: the model starts empty, and nothing outside the block is needed to read it. Its ids are laid out in lanes,
runs of equal length, and all lanes take a step together, so that numpy does the arithmetic of thousands of ids at once. Lanes share the
model: what a step teaches is known to every lane from the next step on.

The model of an id, given the two ids before it in its lane:
  order 2 and order 1 each name the id that followed this context before, with a confidence that grows when it was right and halves when not;
  order 0 has counts of all ids. The three are mixed: for each pair of confidences the block counts which order was right,
  and these counts are the weights. The mixture's distribution function is the weighted sum of the three, so one step of the coder suffices for an id.
"""

from __future__ import annotations

import numpy as np

LANES = 4096
#: A lane has at least so many ids, unless the block itself is shorter.
LANE_IDS = 256
#: Steps after which the counts of order 0 and the weights are brought up to date; at the start after each step.
REFRESH = 16
_EARLY = 8
#: What an id counts for against the one that each id has from the start.
_GAIN = 32
_HASH_BITS = 20
_TOP_CONFIDENCE = 15
#: The mixture's total, the total of order 0, and the share of 1/16 that order 0 always has: each id keeps a part of at least 1.
_BITS, _BITS_0 = 24, 20
_MOST = 15 << 20
#: The coder's window has 56 bits; 24 go out when the range falls below 32.
_WINDOW, _WORD, _LEAST = 56, 24, 1 << 32
_LOW = _LEAST - 1
#: What a hit (second half) or a miss adds to an entry, by its confidence; the outcome by twice a hit of order 2 and a hit of order 1.
_DELTA = np.array([(c >> 1) - c for c in range(16)] + [int(c < _TOP_CONFIDENCE) for c in range(16)], np.int64)
_OUTCOME = np.array([2, 1, 0, 0], np.int64)


def _layout(n: int) -> tuple[int, int]:
    """Lanes and ids of a lane. The last lane is filled up with id 0."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


class _Model:
    def __init__(self, vocabulary: int, lanes: int, inverse: bool = False):
        self.size, self.inverse = vocabulary, inverse
        self.counts = np.ones(vocabulary, np.int64)
        self.follow1 = np.zeros(vocabulary, np.int32)
        self.follow2 = np.zeros(1 << _HASH_BITS, np.int32)
        # outcomes by (order 2 and 1 agree, confidence of 2, confidence of 1): order 2 right, order 1 right, neither
        self.outcomes = np.tile(np.array([1, 1, 2], np.int64), (2 << 8, 1))
        self.before1 = np.zeros(lanes, np.int64)
        self.before2 = np.zeros(lanes, np.int64)
        self.seen: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.refresh()

    def refresh(self) -> None:
        if self.ids:
            self.counts += _GAIN * np.bincount(np.concatenate(self.ids), minlength=self.size)
            self.outcomes += np.bincount(np.concatenate(self.seen), minlength=self.outcomes.size).reshape(-1, 3)
            self.ids, self.seen = [], []
        total = self.counts.sum()
        below = np.zeros(self.size + 1, np.int64)
        np.cumsum(self.counts, out=below[1:])
        step = (((1 << _BITS_0) - self.size) << 20) // int(total)
        below = (below * step >> 20) + np.arange(self.size + 1)
        below[-1] = 1 << _BITS_0
        self.below = below
        if self.inverse:  # the id at each place of order 0's total
            self.at = np.repeat(np.arange(self.size, dtype=np.uint16), np.diff(below))
        weights = self.outcomes[:, :2] * _MOST // self.outcomes.sum(1, keepdims=True)
        self.weight2, self.weight1 = weights[:, 0].copy(), weights[:, 1].copy()
        self.weight0 = (1 << _BITS) - self.weight2 - self.weight1

    def predict(self) -> None:
        """The candidates of orders 2 and 1 (a2, a1) and the parts of the total that the orders have (v2, v1, v0)."""
        # all in 64 bits: numpy is slow where types differ
        self.slot = (self.before2 * 40503 + (self.before1 * 2654435761 >> 5)) & ((1 << _HASH_BITS) - 1)
        self.e2, self.e1 = self.follow2.take(self.slot).astype(np.int64), self.follow1.take(self.before1).astype(np.int64)
        self.a2, self.a1 = self.e2 >> 4, self.e1 >> 4
        self.c2, self.c1 = self.e2 & 15, self.e1 & 15
        self.same = (self.a2 == self.a1).astype(np.int64)
        self.state = (self.c2 << 4) + self.c1 + (self.same << 8)
        self.v2, self.v1, self.v0 = self.weight2.take(self.state), self.weight1.take(self.state), self.weight0.take(self.state)

    def part0(self, ids: np.ndarray) -> np.ndarray:
        """Order 0's share of the mixture below these ids."""
        return self.below.take(ids) * self.v0 >> _BITS_0

    def update(self, ids: np.ndarray, step: int) -> None:
        hit2, hit1 = (ids == self.a2).astype(np.int64), (ids == self.a1).astype(np.int64)
        fresh = (ids << 4) + 1
        self.follow2[self.slot] = _learned(self.e2, self.c2, hit2, fresh)
        self.follow1[self.before1] = _learned(self.e1, self.c1, hit1, fresh)
        self.seen.append(self.state * 3 + _OUTCOME.take(hit2 * 2 + hit1))
        self.ids.append(ids)
        self.before2, self.before1 = self.before1, ids
        if step < _EARLY or step % REFRESH == 0:
            self.refresh()


def _learned(entry: np.ndarray, confidence: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """A hit adds to the confidence, a miss halves it; a miss at a confidence of at most 1 makes the entry ``fresh``."""
    key = (hit << 4) + confidence
    return np.where(key < 2, fresh, entry + _DELTA.take(key)).astype(np.int32)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """The coded block: the number of words of each lane (unsigned 32-bit), then the lanes' 24-bit words, high byte first.

    Ids are 0 to vocabulary - 1 (at most 65,536); no ids give no bytes.
    """
    n = len(ids)
    if not n:
        return b""
    if int(ids.max()) >= vocabulary:
        raise ValueError("an id outside the vocabulary")
    lanes, steps = _layout(n)
    columns = np.zeros(lanes * steps, np.int64)
    columns[:n] = ids
    columns = np.ascontiguousarray(columns.reshape(lanes, steps).T)
    model = _Model(vocabulary, lanes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << _WINDOW, np.int64)
    words, used = np.zeros((lanes, steps + 1), np.int32), np.zeros(lanes, np.int64)
    for step, now in enumerate(columns):
        model.predict()
        start = model.part0(now)
        size = model.part0(now + 1) - start
        start += model.v2 * (model.a2 < now).astype(np.int64) + model.v1 * (model.a1 < now).astype(np.int64)
        size += model.v2 * (model.a2 == now).astype(np.int64) + model.v1 * (model.a1 == now).astype(np.int64)
        span >>= _BITS
        low += span * start
        span *= size
        out = np.flatnonzero(span < _LEAST)
        if len(out):
            gone = low[out]
            words[out, used[out]] = gone >> 32
            used[out] += 1
            low[out] = (gone & _LOW) << _WORD
            span[out] <<= _WORD
        model.update(now, step)
    words[np.arange(lanes), used] = (low + _LOW) >> 32
    used += 1
    for k in range(words.shape[1] - 1, 0, -1):  # carries were kept in the words
        words[:, k - 1] += words[:, k] >> _WORD
        words[:, k] &= (1 << _WORD) - 1
    flat = words[np.arange(words.shape[1]) < used[:, None]]
    return used.astype("<u4").tobytes() + flat.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def _windows(block: bytes, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Each lane's first 56 bits, and the 24-bit words that follow them; beyond its end a lane reads zeros."""
    used = np.frombuffer(block, "<u4", lanes).astype(np.int64)
    raw = np.frombuffer(block, np.uint8, offset=4 * lanes)
    width = 3 * int(used.max()) + 7 + 3
    width += -(width - 7) % 3
    if 3 * int(used.sum()) != len(raw):
        raise ValueError("damaged block: its lanes do not add up")
    lane = np.zeros((lanes, width), np.uint8)
    lane[np.arange(width) < 3 * used[:, None]] = raw
    first = np.zeros(lanes, np.int64)
    for k in range(7):
        first = first << 8 | lane[:, k]
    rest = lane[:, 7:].reshape(lanes, -1, 3).astype(np.int32)
    return first, rest[:, :, 0] << 16 | rest[:, :, 1] << 8 | rest[:, :, 2]


def decode(block: bytes, n: int, vocabulary: int) -> np.ndarray:
    """The n ids of a coded block."""
    if not n:
        return np.zeros(0, np.uint16)
    lanes, steps = _layout(n)
    code, rest = _windows(block, lanes)
    model = _Model(vocabulary, lanes, inverse=True)
    span, used = np.full(lanes, 1 << _WINDOW, np.int64), np.zeros(lanes, np.int64)
    last = rest.shape[1] - 1
    columns = np.empty((steps, lanes), np.int64)
    for step in range(steps):
        model.predict()
        a2, a1, v2, v1, v0 = model.a2, model.a1, model.v2, model.v1, model.v0
        span >>= _BITS
        at = np.minimum(code // span, (1 << _BITS) - 1)
        start2, start1 = model.part0(a2), model.part0(a1)
        size2 = model.part0(a2 + 1) - start2 + v2 + v1 * model.same
        size1 = model.part0(a1 + 1) - start1 + v1 + v2 * model.same
        less1 = (a1 < a2).astype(np.int64)
        start2 += v1 * less1
        start1 += v2 * (1 - less1 - model.same)
        beyond2, beyond1 = at >= start2 + size2, at >= start1 + size1
        hit2, hit1 = (at >= start2) & ~beyond2, (at >= start1) & ~beyond1
        now, start, size = np.where(hit2, a2, a1), np.where(hit2, start2, start1), np.where(hit2, size2, size1)
        miss = np.flatnonzero(~(hit2 | hit1))
        if len(miss):
            passed = v2[miss] * beyond2[miss] + v1[miss] * beyond1[miss]
            share = v0[miss]
            found = model.at[((at[miss] - passed + 1 << _BITS_0) - 1) // share].astype(np.int64)
            below = model.below[found] * share >> _BITS_0
            now[miss], start[miss] = found, below + passed
            size[miss] = (model.below[found + 1] * share >> _BITS_0) - below
        code -= span * start
        span *= size
        more = np.flatnonzero(span < _LEAST)
        if len(more):
            code[more] = code[more] << _WORD | rest[more, np.minimum(used[more], last)]
            used[more] += 1
            span[more] <<= _WORD
        columns[step] = now
        model.update(now, step)
    return columns.T.reshape(-1)[:n].astype(np.uint16)
