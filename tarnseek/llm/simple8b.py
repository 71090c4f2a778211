"""Simple-8b: unsigned integers in 64-bit words, 4 bits of selector and 60 of values.

A selector says how many values of how many bits a word holds. Values are packed in blocks
of a fixed number, each starting at a word of its own, so that blocks are encoded and
decoded side by side. The last word of a block may hold fewer values than its selector says.
A value of more than 60 bits is an escape: selector 0, and the value in the next word.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: values per word and bits per value, by selector. Selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024


def _bits_of(values: np.ndarray) -> np.ndarray:
    need = np.zeros(len(values), np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step) > 0
        need += np.where(high, step, 0).astype(np.uint8)
        rest = np.where(high, rest >> np.uint64(step), rest)
    return need + (rest > 0).astype(np.uint8)


_SMALL = _bits_of(np.arange(1 << 16, dtype=np.uint64))


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words (unsigned 64 bits) and where each block starts among them."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    small = values.max() < len(_SMALL)
    need = _SMALL[values] if small else _bits_of(values)
    # The selector each place would take: the one with most values that fit, or that reach the block's end.
    ends = np.minimum((np.arange(n) // block + 1) * block, n)
    left = np.minimum(ends - np.arange(n), 255).astype(np.uint8)
    best = np.zeros(n, np.uint8)
    # Beyond a block's end nothing needs bits: look at each block with zeros behind it.
    rows = -(-n // block)
    grid = np.zeros((rows, block + 128), np.uint8)
    grid[:, :block].flat[:n] = need
    most, seen = grid[:, :block].copy(), 1
    for selector in range(15, 0, -1):
        count, bits = int(COUNTS[selector]), int(BITS[selector])
        while seen < count:
            np.maximum(most, grid[:, seen : seen + block], out=most)
            seen += 1
        fits = (most <= bits).reshape(-1)[:n]
        np.copyto(best, np.uint8(selector), where=fits)
        if not fits.any() and bits < 16:
            break
    # All blocks walk from word to word together.
    starts = np.arange(0, n, block)
    at, which = starts.copy(), np.arange(len(starts))
    places, owner = [], []
    while len(at):
        places.append(at), owner.append(which)
        at = at + COUNTS[best[at]]
        going = at < ends[starts[which]]
        at, which = at[going], which[going]
    place, owner = np.concatenate(places), np.concatenate(owner)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    chosen = best[place]
    width = 1 + (chosen == 0).astype(np.int64)
    slot = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    room = np.minimum(COUNTS[chosen], left[place])
    for selector in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == selector)
        if selector == 0:
            words[slot[rows] + 1] = values[place[rows]]
            continue
        for part, whole in ((rows[room[rows] == COUNTS[selector]], True), (rows[room[rows] < COUNTS[selector]], False)):
            word = np.full(len(part), selector << 60, np.uint64)
            for i in range(int(COUNTS[selector]) if BITS[selector] else 0):
                shift = np.uint64(i * int(BITS[selector]))
                if whole:
                    word |= values[place[part] + i] << shift
                else:
                    inside = room[part] > i
                    word[inside] |= values[place[part[inside]] + i] << shift
            words[slot[part]] = word
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    return words, slot[first]


def unpack(words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of blocks that begin at ``starts`` among ``words`` and hold ``counts`` values each."""
    words = np.ascontiguousarray(words, np.uint64)
    total = int(np.sum(counts))
    out = np.zeros(total + 128, np.uint64)
    if not len(words):
        return out[:total]
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0).tolist():
        if not raw[i]:
            raw[i + 1] = True
    held = np.where(raw, 0, COUNTS[selector])
    before = np.cumsum(held) - held
    block = np.zeros(len(words), np.int64)
    block[starts] = 1
    block = np.cumsum(block) - 1
    base = np.cumsum(counts) - counts
    place = before - before[starts][block] + base[block]
    end = (base + counts)[block]
    for s in np.unique(selector[~raw]).tolist():
        rows = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[place[rows]] = words[rows + 1]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for i in range(int(COUNTS[s]) if BITS[s] else 0):
            inside = rows[place[rows] + i < end[rows]]
            out[place[inside] + i] = (words[inside] >> np.uint64(i * int(BITS[s]))) & mask
    return out[:total]
