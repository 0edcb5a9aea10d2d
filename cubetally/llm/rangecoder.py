"""Adaptive context-mixing range coder for token ids, run for many blocks at once in numpy.

Each block of up to ``block`` ids is coded from a fresh model.  An id's slot is the order in which it first came
up in the block.  Three predictors speak for the next slot:

* order 2: the slot that last followed the two before, with a count of how often it was right in a row;
* order 1: the slot that last followed the one before, likewise;
* order 0: all slots of the block by how often they came up.

Their distributions are mixed with weights that adapt within the block: one weight for each count of order 2 (apart
where both name the same slot) and of order 1, and one for order 0 against a new id, whose bits follow.  The mixture
drives one range-coder step an id.  The counts of order 0 are brought up to date at fixed steps, an eighth of the ids
so far apart (16 at least); a slot that came up since counts as one.  Between them its cumulative counts and their
inverse are two tables, so that a step costs one look-up for any number of slots.

All blocks of a section advance in step ("lanes"), so each numpy call codes one id of every block.  The range
coder has a 48-bit window and 24-bit words; a word's carry stays in its upper bits until the end.

Cases: no ids give no blocks; blocks hold 3,800 ids at most; ids are unsigned 16-bit, or 32-bit where ``wide``.
"""

from __future__ import annotations

import numpy as np

BITS2 = 10  # context table of order 2
SCALE = 18
TOTAL = 1 << SCALE
WORD = 24
MASK = (1 << WORD) - 1
MASK32 = (1 << 32) - 1
A, B = 0x9E3779B1, 0x85EBCA6B
NONE = 4095  # no slot
REFRESHED = 64
ONE = np.int32(1 << 16)


def _next_refresh(step: int) -> int:
    return step + max(16, step >> 3)


class _Coder:
    """Model and range coder of all lanes; ``run`` is driven by slots and ids (encoding) or by words (decoding)."""

    def __init__(self, lanes: int, steps: int, wide: bool):
        self.lanes, self.steps, self.wide = lanes, steps, wide
        at = np.arange(lanes, dtype=np.int64)
        # the tables of both orders lie behind one another, so that one call serves both
        self.base2, self.base1 = at << BITS2, (lanes << BITS2) + at * steps
        self.table = np.full(lanes * ((1 << BITS2) + steps), NONE << 4, np.uint16)
        prior = np.array([0, 16, 32, 40, 48, 52, 56, 58] + [60] * 8, np.int32) << 10
        self.base_q = np.stack([at * 48, at * 48 + 32])
        self.chance = np.tile(np.concatenate([prior, np.minimum(prior + 4096, 63 << 10), prior]), lanes)
        self.chance0 = np.full(lanes, 1 << 14, np.int32)
        self.counts = np.zeros((lanes, steps), np.int32)
        self.span_room, self.inverse_room = np.empty(lanes * steps, np.int32), np.empty(lanes * steps, np.uint16)
        self.slots = np.zeros(lanes, np.int64)

    def _refresh(self, step: int, recent: np.ndarray, decode: bool) -> None:
        """Order 0 counts ``recent`` (slots, steps x lanes) and lays its tables out for the steps to the next time."""
        lanes, steps = self.lanes, self.steps
        most = int(self.slots.max())
        ahead = min(_next_refresh(step), steps) - step
        width, places = min(most + ahead, steps), step + ahead
        every = np.arange(lanes, dtype=np.int64)
        self.line, self.line_inverse = every * width, every * places
        self.spans = self.span_room[: lanes * width]  # start and weight by slot
        self.inverse = self.inverse_room[: lanes * places]  # slot by place in the cumulative counts
        for at in range(0, lanes, REFRESHED):  # few lanes at once stay in the cache
            to = min(at + REFRESHED, lanes)
            counts = self.counts[at:to, :width]
            if step:
                seen = every[: to - at] * most + recent[:, at:to]
                counts[:, :most] += np.bincount(seen.ravel(), minlength=(to - at) * most).reshape(to - at, most)
            weight = np.maximum(counts, 1)
            ends = np.cumsum(weight, axis=1, dtype=np.int32)
            self.spans[at * width : to * width] = (((ends - weight) << 12) | weight).ravel()
            if decode:
                inverse = self.inverse[at * places : to * places].reshape(to - at, places)
                if step:
                    names = np.tile(np.arange(most, dtype=np.uint16), to - at)
                    inverse[:, :step] = np.repeat(names, counts[:, :most].ravel()).reshape(to - at, step)
                inverse[:, step:] = self.slots[at:to, None] + np.arange(ahead)

    def run(self, slots: np.ndarray | None, ids: np.ndarray | None, words: np.ndarray | None):
        """(words, counts) of ``slots`` and ``ids`` (steps x lanes), or the ids of ``words`` (words x lanes)."""
        lanes, steps, encode = self.lanes, self.steps, ids is not None
        every = np.arange(lanes, dtype=np.int64)
        rng = np.full(lanes, 1 << 2 * WORD, np.int64)
        pos = every.copy()  # place of the next word in the flat grid
        if encode:
            out = np.zeros(((4 if self.wide else 3) * steps // 2 + 8) * lanes, np.int32)
            low = np.zeros(lanes, np.int64)
        else:
            flat, end = words.ravel(), len(words) * lanes - lanes
            low = (words[0].astype(np.int64) << WORD) | words[1]  # distance of the code from the interval's start
            pos += 2 * lanes
            slots = np.zeros((steps, lanes), np.uint16)
            added = np.full((steps, lanes), -1, np.int64)  # ids where they are new

        def shift(need: np.ndarray) -> None:
            at = pos[need]
            if encode:
                x = low[need]
                out[at] = x >> WORD
                low[need] = (x & MASK) << WORD
            else:
                low[need] = (low[need] << WORD) | flat[np.minimum(at, end + need)]
            pos[need] = at + lanes
            rng[need] <<= WORD

        def bits16(where: np.ndarray, value: np.ndarray | None) -> np.ndarray:
            r = rng[where] >> 16
            if encode:
                low[where] += r * value
            else:
                value = np.minimum(low[where] // r, (1 << 16) - 1)
                low[where] -= r * value
            rng[where] = r
            shift(where[r < 1 << WORD])
            return value

        place = np.empty((2, lanes), np.int64)
        table, chance, chance0 = self.table, self.chance, self.chance0
        p1 = p2 = np.zeros(lanes, np.int64)
        refresh, mass = 0, np.zeros(lanes, np.int32)
        for step in range(steps):
            if step == refresh:
                self._refresh(step, slots[since:step] if step else slots[:0], not encode)
                since, refresh = step, _next_refresh(step)
                mass[:] = step
            np.add(self.base2, ((p1 * A + p2 * B) & MASK32) >> (32 - BITS2), out=place[0])
            np.add(self.base1, p1, out=place[1])
            e = table.take(place)
            c, k = e >> 4, e & 15
            same = c[0] == c[1]
            q = self.base_q + k
            q[0] += same * 16
            a = chance.take(q)
            f2 = 64 + (((a[0] >> 3) * np.int32(TOTAL - 8192)) >> 13)
            f1 = 64 + (((a[1] >> 3) * (TOTAL - 4096 - f2)) >> 13)
            f1 *= ~same
            edge = f2 + f1
            # quotients of an 18-bit whole number are floored rightly from floats, which divide faster
            unit = ((((TOTAL - 1024 - edge) * (chance0 >> 3)) >> 13).astype(np.float32) / np.maximum(mass, 1).astype(np.float32)).astype(np.int32)
            np.maximum(unit, 1, out=unit)  # 3,800 slots of the least weight fit beside the other shares
            top = edge + mass * unit
            r = rng >> SCALE
            if encode:
                x = slots[step].astype(np.int64)
                hit = c == x
                new = x == self.slots
                by2, over1 = hit[0], ~(hit[0] | hit[1])
            else:
                v = np.minimum(low / r, TOTAL - 1).astype(np.int32)
                over1, new, by2 = v >= edge, v >= top, v < f2
                w = (np.maximum(v - edge, 0).astype(np.float32) / unit.astype(np.float32)).astype(np.int32)
                nth = self.inverse.take(self.line_inverse + np.minimum(w, mass))  # after all slots stands the new one
                x = np.where(over1, nth, np.where(by2, c[0], c[1]))
                x = np.minimum(x, self.slots)  # only a damaged block needs the bound; its checksum tells
                slots[step] = x
                hit = c == x
            span = self.spans.take(self.line + x)
            start = np.where(over1, edge + (span >> 12) * unit, ~by2 * f2)
            share = np.where(over1, np.where(new, TOTAL - top, (span & 4095) * unit), np.where(by2, f2, f1))
            if encode:
                low += r * start
            else:
                low -= r * start
            rng = r * share
            need = np.flatnonzero(rng < 1 << WORD)
            if len(need):
                shift(need)
            fresh = np.flatnonzero(new)
            if len(fresh):
                if encode:
                    y = ids[step][fresh].astype(np.int64)
                    if self.wide:
                        bits16(fresh, y >> 16)
                    bits16(fresh, y & 0xFFFF)
                else:
                    y = bits16(fresh, None)
                    if self.wide:
                        y = (y << 16) | bits16(fresh, None)
                    added[step][fresh] = y
                self.slots += new
                mass += new
            chance0 += ((~new * ONE - chance0) * over1) >> 5
            # order 1 learns where order 2 was wrong and they differ; all tables always learn the slot
            more = (hit * ONE - a) >> 5
            more[1] *= ~(hit[0] | same)
            chance[q] = a + more
            miss = ~hit
            kept = e + (hit & (k < 15)) - miss * (k - (k >> 1))
            named = (x << 4 | 1).astype(np.uint16)
            table[place] = kept ^ ((kept ^ named) & -(miss & (k < 2)).astype(np.uint16))
            p2, p1 = p1, x
        if not encode:
            by_lane = np.ascontiguousarray(added.T)
            known = by_lane >= 0
            names, counts = by_lane[known], known.sum(axis=1)  # in the order of lanes and their slots
            return names.take((np.cumsum(counts) - counts)[:, None] + slots.T, mode="clip")
        for part in (low >> WORD, low & MASK):
            out[pos] = part
            pos += lanes
        grid, count = out.reshape(-1, lanes), (pos - every) // lanes
        for j in range(int(count.max()) - 1, 0, -1):  # carries
            grid[j - 1] += grid[j] >> WORD
            grid[j] &= MASK
        return grid, count


def slots_of(ids: np.ndarray) -> np.ndarray:
    """Of each id (lanes x steps) the number of different ids that came up in its lane before its first time."""
    steps = ids.shape[1]
    at = np.arange(steps)
    if ids.max() >= 1 << 20:
        ids = np.unique(ids, return_inverse=True)[1].reshape(ids.shape)
    first = np.zeros(int(ids.max()) + 1, np.int64)
    out = np.empty(ids.shape, np.uint16)
    for lane, line in zip(ids, out, strict=True):
        first[lane[::-1]] = at[::-1]  # of repeated places the last value stays
        begin = first[lane]
        line[:] = (np.cumsum(begin == at, dtype=np.uint16) - np.uint16(1))[begin]
    return out


def encode_blocks(ids: np.ndarray, block: int, wide: bool) -> list[bytes]:
    """Code of each block of ``ids``: 24-bit little-endian words."""
    if not len(ids):
        return []
    lanes = -(-len(ids) // block)
    steps = min(block, len(ids))
    padded = np.zeros(lanes * steps, np.uint32)
    padded[: len(ids)] = ids
    by_lane = padded.reshape(lanes, steps)
    by_step, slots = np.ascontiguousarray(by_lane.T), np.ascontiguousarray(slots_of(by_lane).T)
    grid, count = _Coder(lanes, steps, wide).run(slots, by_step, None)
    lines = np.ascontiguousarray(grid[: int(count.max())].T.astype("<u4")).view(np.uint8).reshape(lanes, -1, 4)[:, :, :3]
    return [lines[i, : count[i]].tobytes() for i in range(lanes)]


def decode_blocks(codes: list[bytes], n: int, block: int, wide: bool) -> np.ndarray:
    """The ``n`` ids of a section whose blocks have these codes."""
    if not n:
        return np.zeros(0, np.int64)
    lanes, steps = len(codes), min(block, n)
    longest = max(len(c) // 3 for c in codes)
    grid = np.zeros((lanes, longest, 4), np.uint8)
    for i, c in enumerate(codes):
        grid[i, : len(c) // 3, :3] = np.frombuffer(c, np.uint8).reshape(-1, 3)
    words = np.ascontiguousarray(grid.view("<u4")[:, :, 0].T).astype(np.int64)
    return _Coder(lanes, steps, wide).run(None, None, words).ravel()[:n]
