"""Runs of repeated words, found on a grammar of the texts.

The word numbers of many texts lie in one flat array, a mark of its own between two texts. Re-Pair replaces pairs
that occur again by nonterminals, in rounds: in each, of the pairs that overlap the most frequent is replaced, all at
once, and a pair keeps its nonterminal in later rounds. What is left of a text is halved into a balanced tree. Every run
lies in the expansion of some nonterminal or node so that it crosses the boundary between its two halves; it is
looked for there once, at one place where the nonterminal stands, and carried to all others. Runs cut by the ends of
an expansion lie within those found further up, so in the end only intervals that no other of the same period holds are kept.

At a boundary, a run of four periods or more has two of them on one side. So a period is a distance at which the word
beside the boundary occurs again, the square there is compared by hashes of prefixes, and the interval is widened
by bisection over the same hashes. What is found is checked word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MIN_WORDS = 6
MIN_PERIODS = 4
#: Bytes of texts looked at together, and candidates compared together.
_CHUNK_BYTES = 3 << 20
_CANDIDATES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

Interval = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Hashes:
    """Compares stretches of one array by polynomial hashes of its prefixes, modulo 2**64. Unequal ones may look equal."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.power = np.ones(n + 1, np.uint64)
        self.power[1:] = _BASE
        self.power = np.multiply.accumulate(self.power)
        mixed = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * self.power[:n], out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` at a and at b, which is further on, are equal."""
        return (self.sums[a + size] - self.sums[a]) * self.power[b - a] == self.sums[b + size] - self.sums[b]

    def _longest(self, fits, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = fits(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many elements from a and b on are equal, at most ``most``."""
        return self._longest(lambda k: self.equal(a, b, k), most)

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many elements before a and b are equal."""
        return self._longest(lambda k: self.equal(a - k, b - k, k), most)


class _Boundaries:
    """Finds runs that cross boundaries of stretches of one array."""

    def __init__(self, values: np.ndarray, min_words: int, min_periods: int):
        self.values, self.hashes = values, _Hashes(values)
        self.min_words, self.min_periods = min_words, min_periods
        n = len(values)
        self.order = np.argsort(values, kind="stable")
        self.sorted = values[self.order] * n + self.order

    def _same_word(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the query, place) for all places from first to last that hold the word at ``at``, some at a time."""
        n = len(self.values)
        low = np.searchsorted(self.sorted, self.values[at] * n + first)
        many = np.maximum(np.searchsorted(self.sorted, self.values[at] * n + last, "right") - low, 0)
        ends = np.cumsum(many)
        start = 0
        while start < len(at):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + _CANDIDATES, "right")))
            part = many[start:stop]
            if part.any():
                query = np.repeat(np.arange(start, stop), part)
                place = np.arange(part.sum()) + np.repeat(low[start:stop] - (np.cumsum(part) - part), part)
                yield query, self.order[place]
            start = stop

    def find(self, lo: np.ndarray, at: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, Interval]:
        """Runs within [lo, hi) across ``at``: (number of the boundary, (start, end, period)), of equal intervals the least period."""
        most = (hi - lo) // self.min_periods
        found: list[tuple[np.ndarray, ...]] = []

        def keep(query: np.ndarray, anchor: np.ndarray, period: np.ndarray) -> None:
            square = self.hashes.equal(anchor, anchor + period, period)
            query, anchor, period = query[square], anchor[square], period[square]
            if not len(query):
                return
            start = anchor - self.hashes.behind(anchor, anchor + period, anchor - lo[query])
            end = anchor + period + self.hashes.ahead(anchor, anchor + period, hi[query] - anchor - period)
            long = end - start >= np.maximum(self.min_words, self.min_periods * period)
            found.append((query[long], start[long], end[long], period[long]))

        left = np.flatnonzero((at - lo >= 2) & (hi - lo >= self.min_words))
        if len(left):
            b = at[left]
            reach = np.minimum(most[left], (b - lo[left]) // 2)
            for i, place in self._same_word(b - 1, b - 1 - reach, b - 2):
                period = b[i] - 1 - place
                keep(left[i], b[i] - 2 * period, period)
        right = np.flatnonzero((hi - at >= 2) & (hi - lo >= self.min_words))
        if len(right):
            b = at[right]
            reach = np.minimum(most[right], (hi[right] - b) // 2)
            for i, place in self._same_word(b, b + 1, b + reach):
                keep(right[i], b[i], place - b[i])
        if not found:
            none = np.zeros(0, np.int64)
            return none, (none, none, none)
        query, start, end, period = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((period, end, start, query))
        query, start, end, period = query[order], start[order], end[order], period[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        return query[new], (start[new], end[new], period[new])


def re_pair(values: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """A grammar of ``values`` (whole numbers below 2**30).

    Gives its rules (left size, size) by number, all places (rule, start) where they stand in the
    derivation, and the starts of the symbols left in the end.
    """
    n = len(values)
    symbol, start = values.copy(), np.arange(n)
    size = np.ones(n, np.int64)
    fresh = int(values.max(initial=0)) + 1
    base = fresh
    known, known_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
    left_size: list[np.ndarray] = []
    whole_size: list[np.ndarray] = []
    places: list[tuple[np.ndarray, np.ndarray]] = []
    active = np.arange(max(0, n - 1))
    while len(active):
        code = symbol[active] << 31 | symbol[active + 1]
        kinds, kind, count = np.unique(code, return_inverse=True, return_counts=True)
        again = count[kind] > 1
        active, kind = active[again], kind[again]
        if not len(active):
            break
        # The more frequent of two overlapping pairs goes first; of a row of one pair every other place, from the left.
        rank = np.full(len(symbol) + 1, -1)
        rank[active + 1] = count[kind] * len(kinds) + kind
        mine = rank[active + 1]
        best = (mine >= rank[active]) & (mine >= rank[active + 2])
        follows = rank[active] == mine
        index = np.arange(len(active))
        run = np.maximum.accumulate(np.where(follows, 0, index))
        take = best & ((index - run) % 2 == 0)
        at, kind = active[take], kind[take]
        used, rule = np.unique(kind, return_inverse=True)
        pair = kinds[used]
        slot = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
        old = known[slot] == pair if len(known) else np.zeros(len(pair), bool)
        name = np.where(old, known_id[slot] if len(known) else 0, 0)
        name[~old] = fresh + np.arange(np.count_nonzero(~old))
        first = np.zeros(len(used), np.int64)
        first[rule[::-1]] = at[::-1]
        new = first[~old]
        left_size.append(size[new])
        whole_size.append(size[new] + size[new + 1])
        fresh += len(new)
        known, known_id = np.concatenate((known, pair[~old])), np.concatenate((known_id, name[~old]))
        order = np.argsort(known, kind="stable")
        known, known_id = known[order], known_id[order]
        places.append((name[rule] - base, start[at]))
        symbol[at] = name[rule]
        size[at] += size[at + 1]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        # Pairs that stand once can't come again, so only the others and the new ones are looked at.
        look = np.zeros(len(symbol), bool)
        look[active] = True
        look[at] = True
        look[at[at > 0] - 1] = True
        symbol, size, start = symbol[keep], size[keep], start[keep]
        active = np.flatnonzero(look[keep][:-1])
    if places:
        place = tuple(np.concatenate(x) for x in zip(*places))
        rules = np.concatenate(left_size), np.concatenate(whole_size)
    else:
        place = rules = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return rules, place, start


def _halves(start: np.ndarray, end: np.ndarray, text: np.ndarray) -> Iterator[Interval]:
    """(lo, boundary, hi) of the nodes of balanced trees over the symbols of each text, a level at a time."""
    while len(start) > 1:
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        size = np.diff(np.append(first, len(text)))
        odd = (np.arange(len(text)) - np.repeat(first, size)) % 2 == 1
        if not odd.any():
            return
        right = np.flatnonzero(odd)
        yield start[right - 1], start[right], end[right]
        end = end.copy()
        end[right - 1] = end[right]
        start, end, text = start[~odd], end[~odd], text[~odd]


def _maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> Interval:
    """Without the intervals that lie within another of their period; of equal intervals that of least period. By start, then period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        far = (np.cumsum(np.concatenate(([0], period[1:] != period[:-1]))) * (int(end.max()) + 1)) + end
        keep = np.ones(len(start), bool)
        keep[1:] = far[1:] > np.maximum.accumulate(far)[:-1]
        start, end, period = start[keep], end[keep], period[keep]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        keep = np.ones(len(start), bool)
        keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[keep], end[keep], period[keep]
        order = np.lexsort((period, start))
        start, end, period = start[order], end[order], period[order]
    return start, end, period


def _holds(values: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each interval has its period, word by word."""
    good = np.ones(len(start), bool)
    for i, (s, e, p) in enumerate(zip(start.tolist(), end.tolist(), period.tolist())):
        good[i] = np.array_equal(values[s : e - p], values[s + p : e])
    return good


def _by_periods(values: np.ndarray, min_words: int, min_periods: int) -> Interval:
    """The same for one text by looking at every period: taken where hashes of unequal stretches were equal."""
    found = []
    for p in range(1, len(values) // min_periods + 1):
        same = np.concatenate(([False], values[:-p] == values[p:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        s, e = edge[::2], edge[1::2] + p
        long = e - s >= max(min_words, min_periods * p)
        found.append((s[long], e[long], np.full(np.count_nonzero(long), p)))
    return _maximal(*(np.concatenate(x) for x in zip(*found))) if found else _maximal(*[np.zeros(0, np.int64)] * 3)


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text, cut at ASCII white space. A null text has none."""
    cut = pc.ascii_split_whitespace(pc.coalesce(texts, ""))
    flat, offsets = cut.flatten(), cut.offsets.to_numpy()
    word = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return _picked(flat, offsets - offsets[0], word)


def _picked(flat: pa.Array, offsets: np.ndarray, keep: np.ndarray) -> pa.ListArray:
    """Lists of the kept elements of ``flat``, where list i had those from offsets[i] to offsets[i + 1]."""
    before = np.concatenate(([0], np.cumsum(keep)))
    return pa.ListArray.from_arrays(pa.array(before[offsets], pa.int32()), flat.filter(pa.array(keep)))


def runs_of(texts: pa.ListArray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, Interval]:
    """The runs of all texts (lists of words): (text of each, (start, end, period)), by text, start and period."""
    offsets = texts.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    coded = texts.flatten().dictionary_encode()
    kinds = len(coded.dictionary)
    # A mark after each text, of a number of its own, so that nothing goes on over it.
    marks = np.cumsum(sizes + 1) - 1
    first = marks - sizes
    values = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    words = np.ones(len(values), bool)
    words[marks] = False
    values[words] = coded.indices.to_numpy()
    values[marks] = kinds + np.arange(len(sizes))
    of_text = np.repeat(np.arange(len(sizes)), sizes + 1)

    (left, size), (rule, place), rest = re_pair(values)
    look = _Boundaries(values, min_words, min_periods)
    found: list[Interval] = []
    if len(left):
        sample = np.zeros(len(left), np.int64)
        sample[rule] = place
        query, (s, e, p) = look.find(sample, sample + left, sample + size)
        if len(query):
            # To every place where the rule stands.
            order = np.argsort(rule, kind="stable")
            low = np.searchsorted(rule[order], query)
            many = np.searchsorted(rule[order], query, "right") - low
            each = np.repeat(np.arange(len(query)), many)
            to = place[order[np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)]]
            shift = to - sample[query[each]]
            found.append((s[each] + shift, e[each] + shift, p[each]))
    end = np.append(rest[1:], len(values))
    real = words[rest]
    for lo, at, hi in _halves(rest[real], end[real], of_text[rest[real]]):
        found.append(look.find(lo, at, hi)[1])
    none = np.zeros(0, np.int64)
    start, end, period = _maximal(*(np.concatenate(x) for x in zip(*found, (none, none, none))))
    owner = of_text[start]
    bad = np.unique(owner[~_holds(values, start, end, period)])
    if len(bad):
        again = [(t, _by_periods(values[first[t] : first[t] + sizes[t]], min_words, min_periods)) for t in bad.tolist()]
        good = ~np.isin(owner, bad)
        owner = np.concatenate([owner[good], *(np.full(len(r[0]), t) for t, r in again)])
        moved = [(r[0] + first[t], r[1] + first[t], r[2]) for t, r in again]
        start, end, period = (np.concatenate(x) for x in zip((start[good], end[good], period[good]), *moved))
    order = np.lexsort((period, start))
    owner, start, end, period = owner[order], start[order], end[order], period[order]
    return owner, (start - first[owner], end - first[owner], period)


def collapsed(texts: pa.ListArray, owner: np.ndarray, runs: Interval) -> pa.Array:
    """The words that no run holds after its first period, between single spaces."""
    offsets = texts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    change = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(change, offsets[owner] + runs[0] + runs[2], 1)
    np.add.at(change, offsets[owner] + runs[1], -1)
    return pc.binary_join(_picked(texts.flatten(), offsets, np.cumsum(change[:-1]) == 0), " ")


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts some at a time, by their bytes; a longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + _CHUNK_BYTES, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def collapse(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of ``docs``.

    Words are cut at ASCII white space. runs is an array of (start, length, period), by start, then period: the
    stretches of at least ``min_words`` words and ``min_periods`` times their smallest period that no neighbouring word
    extends. ``min_periods`` is 4 or more. collapsed is the text of the words that no run holds after its first
    period, between single spaces; so a text without runs has its white space made even. Null and
    empty texts have no words and no runs, and are empty. Repeated rows and null ids stay; other columns aren't read. An empty
    table gives an empty one. No rows are brought together: each task works on the rows it reads.
    """
    if min_periods < 4:
        raise ValueError("a run of fewer than four periods may have less than two on each side of a boundary")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column("text")):
                words = words_of(texts)
                owner, runs = runs_of(words, min_words, min_periods)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                columns = [pa.array(runs[0]), pa.array(runs[1] - runs[0]), pa.array(runs[2])]
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(_RUN)))
                n_words = pa.array(np.diff(words.offsets.to_numpy()).astype(np.int64))
                ids = batch.column("doc_id").slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([ids, n_words, listed, collapsed(words, owner, runs)], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
