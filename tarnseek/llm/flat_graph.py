"""One shard of a flat proximity graph in numpy: built by inserting batches of points, searched for many queries at once.

Points are unit vectors; nearness is the dot product. Every step works on all queries of a batch together.
"""

from __future__ import annotations

import numpy as np

#: Neighbours of a point at most, and how much farther a neighbour's neighbour may be before the edge is kept besides (squared).
DEGREE = 24
ALPHA = 1.44
#: The best points a search holds on to, and those it looks around at in a step.
BEAM = 32
_STEP = 4
_INSERTED = 256
#: Nearest points of the same batch that are looked at when it is inserted.
_FELLOWS = 12
#: (query, point) pairs looked at together.
_PAIRS = 1 << 18


def _padded(row: np.ndarray, value: np.ndarray, rows: int, fill) -> np.ndarray:
    """A row for each number in ``row`` (ascending) with its values, filled up."""
    count = np.bincount(row, minlength=rows)
    out = np.full((rows, int(count.max(initial=0))), fill, value.dtype)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = value
    return out


def medoid(points: np.ndarray) -> int:
    """The point nearest to the mean of all."""
    return int((points @ points.mean(axis=0)).argmax())


def robust_prune(points: np.ndarray, dots: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours for points with the given candidates (a row each, -1 for none; ``dots`` with the point): the nearest first,
    and then only those that aren't much nearer to one already taken."""
    order = np.argsort(np.where(candidates >= 0, -dots, np.inf), axis=1, kind="stable")
    candidates, dots = np.take_along_axis(candidates, order, 1), np.take_along_axis(dots, order, 1)
    around = points[candidates]
    between = 2 - 2 * np.matmul(around, around.transpose(0, 2, 1))
    own = 2 - 2 * dots
    alive = candidates >= 0
    # One candidate given twice counts once.
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    out = np.full((len(candidates), degree), -1, candidates.dtype)
    rows = np.arange(len(candidates))
    for k in range(degree):
        has = alive.any(axis=1)
        if not has.any():
            break
        pick = alive.argmax(axis=1)
        out[has, k] = candidates[rows[has], pick[has]]
        alive &= ~(alpha * between[rows, pick] <= own)
        alive[rows, pick] = False
        alive[~has] = False
    return out


class FlatGraph:
    """Points with the neighbours of each (a row of numbers, -1 for none)."""

    def __init__(self, points: np.ndarray, edges: np.ndarray):
        self.points, self.edges, self.start = points, edges, medoid(points)

    @classmethod
    def build(cls, points: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> FlatGraph:
        """Points are inserted in batches of growing size: each is searched for from the medoid, what it met is pruned to its
        neighbours, and they get an edge back."""
        graph = cls(points, np.full((len(points), degree), -1, np.int32))
        order = np.random.default_rng(0).permutation(len(points)).astype(np.int32)
        order = np.concatenate(([graph.start], order[order != graph.start])).astype(np.int32)
        at, size = 1, 1
        while at < len(order):
            graph._insert(order[at : at + size], beam, degree)
            at, size = at + size, min(2 * size, _INSERTED)
        return graph

    def _insert(self, new: np.ndarray, beam: int, degree: int) -> None:
        best, dots = self.greedy(self.points[new], beam)
        among = self.points[new] @ self.points[new].T
        np.fill_diagonal(among, -np.inf)
        fellows = np.argsort(-among, axis=1, kind="stable")[:, :_FELLOWS]
        candidates = np.concatenate((best, new[fellows]), axis=1)
        near = np.concatenate((dots, np.take_along_axis(among, fellows, 1)), axis=1)
        candidates[np.isneginf(near)] = -1
        edges = robust_prune(self.points, near, candidates, degree)
        self.edges[new] = edges
        self._back(np.repeat(new, degree)[edges.ravel() >= 0], edges[edges >= 0], degree)

    def _back(self, source: np.ndarray, target: np.ndarray, degree: int) -> None:
        """Edges from the targets back to the sources; those that have too many are pruned anew."""
        nodes, row = np.unique(target, return_inverse=True)
        order = np.argsort(row, kind="stable")
        added = _padded(row[order], source[order], len(nodes), np.int32(-1))
        added[(added[:, :, None] == self.edges[nodes][:, None, :]).any(axis=2)] = -1
        lists = np.concatenate((self.edges[nodes], added), axis=1)
        few = (lists >= 0).sum(axis=1) <= degree
        if few.any():
            rows = lists[few]
            self.edges[nodes[few]] = np.take_along_axis(rows, np.argsort(rows < 0, axis=1, kind="stable"), 1)[:, :degree]
        many = np.flatnonzero(~few)
        step = max(1, _PAIRS // max(1, lists.shape[1] * lists.shape[1]) * 4)
        for at in range(0, len(many), step):
            part = many[at : at + step]
            rows = lists[part]
            dots = np.einsum("nd,ncd->nc", self.points[nodes[part]], self.points[rows])
            self.edges[nodes[part]] = robust_prune(self.points, dots, rows, degree)

    def greedy(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(points, dots) of the best ``beam`` met by each query on its way from the medoid, the nearest first."""
        n = len(self.points)
        q = len(queries)
        seen = np.zeros((q, n), bool)
        seen[:, self.start] = True
        ids = np.full((q, beam), -1, np.int32)
        dots = np.full((q, beam), -np.inf, self.points.dtype)
        ids[:, 0], dots[:, 0] = self.start, queries @ self.points[self.start]
        done = np.zeros((q, beam), bool)
        going = np.arange(q)
        while len(going):
            open_dots = np.where(done[going] | (ids[going] < 0), -np.inf, dots[going])
            place = np.argsort(-open_dots, axis=1, kind="stable")[:, :_STEP]
            is_open = ~np.isneginf(np.take_along_axis(open_dots, place, 1))
            still = is_open.any(axis=1)
            going, place, is_open = going[still], place[still], is_open[still]
            if not len(going):
                break
            done[going[:, None], place] |= is_open
            row, col = np.nonzero(is_open)
            near = self.edges[ids[going[row], place[row, col]]]
            row = np.repeat(going[row], near.shape[1])
            row, met = self._unseen(row, near.ravel(), seen)
            if not len(row):
                continue
            dot = np.einsum("nd,nd->n", queries[row], self.points[met])
            rows, slot = np.unique(row, return_inverse=True)
            new_ids, new_dots = _padded(slot, met.astype(np.int32), len(rows), np.int32(-1)), _padded(slot, dot, len(rows), dots.dtype.type(-np.inf))
            all_ids = np.concatenate((ids[rows], new_ids), axis=1)
            all_dots = np.concatenate((dots[rows], new_dots), axis=1)
            all_done = np.concatenate((done[rows], np.zeros(new_ids.shape, bool)), axis=1)
            top = np.argsort(-all_dots, axis=1, kind="stable")[:, :beam]
            ids[rows], dots[rows], done[rows] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_dots, all_done))
        return ids, dots

    def _unseen(self, row: np.ndarray, met: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs not seen before, each once, by query; they are now."""
        code = row.astype(np.int64) * len(self.points) + met
        code = np.unique(code[(met >= 0) & ~seen[row, met]])
        row, met = np.divmod(code, len(self.points))
        seen[row, met] = True
        return row, met

    def within(self, queries: np.ndarray, least: float, beam: int = BEAM, slack: float = 0.05) -> np.ndarray:
        """Which points each query reaches with a dot of at least ``least``: first greedily from the medoid, then around every
        point in range (and a little beyond), as far as the range goes."""
        found = np.zeros((len(queries), len(self.points)), bool)
        ids, dots = self.greedy(queries, beam)
        row, col = np.nonzero((ids >= 0) & (dots >= least - slack))
        met, dot = ids[row, col], dots[row, col]
        found[row, met] = dot >= least
        # What the beam had no room for is met again.
        seen = np.zeros(found.shape, bool)
        seen[row, met] = True
        waiting = [(row, met)]
        while waiting:
            row, met = waiting.pop()
            if len(row) * self.edges.shape[1] > _PAIRS and len(row) > 1:
                half = len(row) // 2
                waiting += [(row[half:], met[half:]), (row[:half], met[:half])]
                continue
            if not len(row):
                continue
            near = self.edges[met]
            row, met = self._unseen(np.repeat(row, near.shape[1]), near.ravel(), seen)
            dot = np.einsum("nd,nd->n", queries[row], self.points[met])
            found[row, met] = dot >= least
            go = dot >= least - slack
            waiting.append((row[go], met[go]))
        return found
