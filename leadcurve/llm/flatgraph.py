"""A robust-pruned flat graph over unit vectors, in numpy, for one bounded shard.

``edges[i]`` are up to ``degree`` neighbours of vector i, -1 where there are fewer. Searches
of many points run side by side as flat rows of (point, vector) pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEGREE, BEAM = 24, 40
STEPS = ((1.0, 40), (1.2, 40))  # passes of building: alpha of pruning, beam
BATCH = 256
WIDTH = 4  # vectors of a beam that are expanded at once
STEP_EDGES = 1 << 18  # edges that one step of a search follows; what is left waits for the next
CANDIDATES = 96  # nearest visited vectors that pruning chooses from


@dataclass
class Graph:
    vectors: np.ndarray
    edges: np.ndarray

    def medoid(self) -> int:
        return int(np.argmax(self.vectors @ self.vectors.sum(axis=0)))

    def degrees(self, vectors: np.ndarray) -> np.ndarray:
        return (self.edges[vectors] >= 0).sum(axis=1)

    def ends(self, vectors: np.ndarray) -> np.ndarray:
        """The ends of the vectors' edges, one vector after the other."""
        ends = self.edges[vectors].ravel()
        return ends[ends >= 0]


class United:
    """The same for lists of any length: vector i's edges are ``to[first[i] : first[i + 1]]``."""

    def __init__(self, vectors: np.ndarray, of: np.ndarray, to: np.ndarray):
        self.vectors, self.to = vectors, to
        self.first = np.searchsorted(of, np.arange(len(vectors) + 1))

    medoid = Graph.medoid

    def degrees(self, vectors: np.ndarray) -> np.ndarray:
        return self.first[vectors + 1] - self.first[vectors]

    def ends(self, vectors: np.ndarray) -> np.ndarray:
        count = self.degrees(vectors)
        return self.to[np.repeat(self.first[vectors] - np.cumsum(count) + count, count) + np.arange(count.sum())]


@dataclass
class Pool:
    """Vectors met by each point, by point and falling similarity; ``done``: expanded."""

    point: np.ndarray
    vector: np.ndarray
    sim: np.ndarray
    done: np.ndarray

    def __getitem__(self, chosen: np.ndarray) -> Pool:
        return Pool(self.point[chosen], self.vector[chosen], self.sim[chosen], self.done[chosen])


def _rank(groups: np.ndarray) -> np.ndarray:
    """The place of each member in its group; groups stand together."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups)


def _sorted(pool: Pool) -> Pool:
    """By one key, since what stands in order already then costs little; equal keys stay as they come."""
    return pool[np.argsort(pool.point * 4.0 - pool.sim, kind="stable")]


def search(graph: Graph | United, points: np.ndarray, point: np.ndarray, vector: np.ndarray, beam: int = BEAM, reach: float = np.inf) -> Pool:
    """Greedy search from the entries (point, vector), range-expanding.

    A point's open vectors are expanded best first while they are among its ``beam`` best;
    every vector at least ``reach`` similar is expanded in any case, however many there are.
    """
    n = len(graph.vectors)
    seen = np.zeros((len(points), n), dtype=bool)
    none = np.zeros(0, dtype=np.int64)
    pool = Pool(none, none, np.zeros(0), np.zeros(0, dtype=bool))
    while True:
        fresh = np.unique(point * n + vector)
        point, vector = fresh // n, fresh % n
        fresh = ~seen[point, vector]
        point, vector = point[fresh], vector[fresh]
        seen[point, vector] = True
        sim = np.einsum("ij,ij->i", points[point], graph.vectors[vector])
        pool = _sorted(
            Pool(
                np.append(pool.point, point), np.append(pool.vector, vector), np.append(pool.sim, sim),
                np.append(pool.done, np.zeros(len(point), dtype=bool)),
            )
        )
        best = _rank(pool.point) < beam
        near = pool.sim >= reach
        keep = best | near | pool.done
        pool, near = pool[keep], near[keep]
        open_ = np.flatnonzero(~pool.done & (best[keep] | near))
        chosen = open_[(_rank(pool.point[open_]) < WIDTH) | near[open_]]
        if not len(chosen):
            return pool
        count = graph.degrees(pool.vector[chosen])
        some = max(1, int(np.searchsorted(np.cumsum(count), STEP_EDGES, side="right")))
        chosen, count = chosen[:some], count[:some]
        pool.done[chosen] = True
        point, vector = np.repeat(pool.point[chosen], count), graph.ends(pool.vector[chosen])


def _padded(row: np.ndarray, value: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Values of each row (together), the first ``width`` of them, in a matrix filled up with -1."""
    out = np.full((rows, width), -1, dtype=np.int64)
    rank = _rank(row)
    out[row[rank < width], rank[rank < width]] = value[rank < width]
    return out


def pruned(vectors: np.ndarray, of: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Robust pruning. ``candidates``: per vector of ``of`` the nearest first, -1 filled.

    The nearest candidate left becomes a neighbour, and candidates that are ``alpha`` times
    nearer to it than to the vector go.
    """
    own = vectors[candidates]
    alive = candidates >= 0
    far = 2 - 2 * np.einsum("bcd,bd->bc", own, vectors[of])
    between = np.maximum(2 - 2 * own @ own.transpose(0, 2, 1), 0) * alpha**2
    out = np.full((len(of), degree), -1, dtype=np.int64)
    rows = np.arange(len(of))
    for slot in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, slot] = candidates[rows, first][some]
        alive &= between[rows, first] > far - 1e-12  # vectors that all coincide stay neighbours
        alive[rows, first] = False
    return out


def _relinked(graph: Graph, of: np.ndarray, to: np.ndarray, alpha: float, always: bool) -> None:
    """Candidates ``to`` beside the present neighbours; lists that would be too long are pruned."""
    n, degree = graph.edges.shape
    ends = np.unique(of)
    now = graph.edges[ends].ravel()
    pairs = np.append(np.repeat(ends, degree)[now >= 0] * n + now[now >= 0], of * n + to)
    pairs = np.unique(pairs)
    of, to = pairs // n, pairs % n
    of, to = of[of != to], to[of != to]
    sim = np.einsum("ij,ij->i", graph.vectors[of], graph.vectors[to])
    order = np.lexsort((to, -sim, of))
    of, to = of[order], to[order]
    ends = np.unique(of)
    size = np.bincount(np.searchsorted(ends, of), minlength=len(ends))
    lists = _padded(np.searchsorted(ends, of), to, len(ends), CANDIDATES)
    cut = (size > degree) | always
    graph.edges[ends[~cut]] = lists[~cut, :degree]
    for lo in range(0, int(cut.sum()), BATCH):
        some = np.flatnonzero(cut)[lo : lo + BATCH]
        graph.edges[ends[some]] = pruned(graph.vectors, ends[some], lists[some], alpha, degree)


def built(vectors: np.ndarray, degree: int = DEGREE, seed: int = 3) -> Graph:
    """Vectors enter in batches that double; each is linked with what a search for it visits, and back."""
    n = len(vectors)
    graph = Graph(vectors, np.full((n, degree), -1, dtype=np.int64))
    start = graph.medoid()
    order = np.random.default_rng(seed).permutation(n)
    order = np.append(start, order[order != start])
    for turn, (alpha, beam) in enumerate(STEPS):
        lo = 1 if turn == 0 else 0
        while lo < n:
            hi = min(n, lo + (min(lo, BATCH) if turn == 0 else BATCH))
            some = order[lo:hi]
            rows = np.arange(len(some))
            met = search(graph, vectors[some], rows, np.full(len(some), start), beam)
            of, to = some[met.point], met.vector
            _relinked(graph, of[of != to], to[of != to], alpha, always=True)
            ends = graph.edges[some]
            _relinked(graph, ends[ends >= 0], np.repeat(some, degree)[ends.ravel() >= 0], alpha, always=False)
            lo = hi
    return graph
