"""Ids of words, each worked out once and put together again for whole texts."""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import islice
from types import ModuleType

import numpy as np

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


#: Bytes that a store holds at most, about; and those of a word besides its letters: the object, its number, places in tables.
WORD_BYTES = 96 << 20
_WORD = 180


def _bytes_of(words: list[str]) -> int:
    return sum(map(len, words)) + _WORD * len(words)


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class WordStore:
    """Ids of the words seen so far. ``encode`` gives the ids of new words, one after another, and their counts.

    Once it holds more than ``limit`` bytes (about) it lets go of the words seen only once, or of all if those aren't half
    of its bytes, so its size is bounded whatever the lengths of the words.
    """

    def __init__(self, encode: Encoder, limit: int = WORD_BYTES):
        self.encode, self.limit = encode, limit
        self.number = _Numbers()
        self.bytes = 0
        self.start, self.size, self.seen = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.int32)

    def _ahead(self, at: np.ndarray) -> np.ndarray:
        """Where the ids of words number ``at`` lie, one word after another."""
        size = self.size[at]
        before = self.start[at] - (np.cumsum(size) - size)
        return np.repeat(before.astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32)

    def _let_go(self) -> None:
        stay = np.flatnonzero(self.seen > 1)
        names = np.array(list(self.number), object)[stay].tolist()
        self.bytes = _bytes_of(names) + 4 * int(self.size[stay].sum())
        if self.bytes > self.limit // 2:
            stay, names, self.bytes = stay[:0], [], 0
        self.flat, self.size = self.flat[self._ahead(stay)], self.size[stay]
        self.start, self.seen = np.cumsum(self.size) - self.size, np.zeros(len(stay), np.int64)
        self.number = _Numbers(zip(names, range(len(names))))

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the count of each word."""
        if self.bytes > self.limit:
            self._let_go()
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > known:
            new = list(islice(self.number, known, None))
            flat, size = self.encode(new)
            self.bytes += _bytes_of(new) + flat.nbytes
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, flat))
            self.seen = np.concatenate((self.seen, np.zeros(len(size), np.int64)))
        self.seen += np.bincount(at, minlength=len(self.seen))
        return self.flat[self._ahead(at)], self.size[at]


def worker_store(key: str, encode: Callable[[], Encoder], limit: int = WORD_BYTES) -> WordStore:
    """The store of this worker process under ``key``, which its tasks use one after another.

    Functions sent by value have no lasting globals, so it is kept in a module of its own.
    """
    stores = vars(sys.modules.setdefault("_tarnseek_word_stores", ModuleType("_tarnseek_word_stores")))
    if key not in stores:
        stores[key] = WordStore(encode(), limit)
    return stores[key]
