"""A robust-pruned flat graph over the vectors of one shard, and range-expanding greedy search in it, for many queries at once.

All vectors have length 1, so distance is |x - y| and a cosine is 1 - distance^2 / 2. Single precision does here: what is found is
verified elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Near neighbours a vector keeps, far ones it keeps besides, and how much a nearer neighbour may lie in the way of one.
NEAR, FAR, ALPHA = 20, 6, 1.2
#: Of so many nearest and so many others a vector's neighbours are chosen.
POOL, OTHERS = 64, 24
BEAM, MEDOIDS = 16, 8
#: Vectors that are compared or that search at once, and found ones whose neighbours are looked at.
AT_ONCE, FOUND_AT_ONCE = 512, 50_000


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def prune(own: np.ndarray, pool: np.ndarray, x: np.ndarray, keep: int, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning for many vectors at once: own (their numbers), pool (candidates of each, -1 for none) -> `keep` columns, -1 filled.

    The nearest candidate left is taken, and those go that are alpha times nearer to it than to the vector; again and again.
    """
    there = (pool >= 0) & (pool != own[:, None])
    safe = np.where(there, pool, 0)
    some = x[safe]
    far = np.where(there, np.sqrt(np.maximum(2 - 2 * (some @ x[own][:, :, None])[:, :, 0], 0)), np.inf)
    apart = np.sqrt(np.maximum(2 - 2 * (some @ some.transpose(0, 2, 1)), 0))
    out, rows = np.full((len(own), keep), -1, np.int64), np.arange(len(own))
    left = far.copy()
    for k in range(keep):
        best = left.argmin(1)
        goes = np.isfinite(left[rows, best])
        if not goes.any():
            break
        chosen = safe[rows, best]
        out[goes, k] = chosen[goes]
        left[goes[:, None] & ((alpha * apart[rows, best] <= far) | (safe == chosen[:, None]))] = np.inf
    return out


def medoids(x: np.ndarray, count: int = MEDOIDS) -> np.ndarray:
    """Vectors nearest to the middle of groups, which form around seeds that lie far apart; the shard's own medoid is the first."""
    seeds = [int((x @ x.mean(0)).argmax())]
    far = distances(x, x[seeds[:1]])[:, 0]
    while len(seeds) < min(count, len(x)):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[seeds[-1:]])[:, 0])
    group = (x @ x[seeds].T).argmax(1)
    found = seeds[:1]
    for g in range(len(seeds)):
        own = np.flatnonzero(group == g)
        if len(own):
            found.append(int(own[(x[own] @ x[own].mean(0)).argmax()]))
    return np.unique(found)


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency with -1 for none, medoids): each vector's neighbours, pruned; the ways back, pruned again; and a way to every vector."""
    n, x = len(x), x.astype(np.float32)
    starts = medoids(x)
    rng = np.random.default_rng(n)
    near = np.full((n, NEAR), -1, np.int64)
    far = np.full((n, FAR), -1, np.int64)
    for a in range(0, n, AT_ONCE):
        own = np.arange(a, min(n, a + AT_ONCE))
        like = x[own] @ x.T
        like[np.arange(len(own)), own] = -np.inf
        width = min(POOL, n - 1)
        if width < 1:
            continue
        near[own] = prune(own, np.argpartition(-like, width - 1, axis=1)[:, :width], x, NEAR)
        others = np.concatenate([rng.integers(0, n, (len(own), OTHERS)), np.broadcast_to(starts, (len(own), len(starts)))], axis=1)
        far[own] = prune(own, others, x, FAR)
    ahead = np.concatenate([near, far], axis=1)
    back = _ways_back(ahead, n)
    out = np.full((n, 2 * NEAR + FAR), -1, np.int64)
    out[:, : NEAR + FAR] = ahead
    for a in range(0, n, AT_ONCE):
        own = np.arange(a, min(n, a + AT_ONCE))
        out[own, NEAR + FAR :] = prune(own, back[own], x, NEAR)
    return _reachable(out, x, starts), starts


def _ways_back(ahead: np.ndarray, n: int, most: int = POOL) -> np.ndarray:
    """For each vector those that point at it, the nearest-listed `most` first; pruning chooses among these."""
    to, place = ahead.ravel(), np.tile(np.arange(ahead.shape[1]), n)
    came = np.repeat(np.arange(n), ahead.shape[1])
    some = np.flatnonzero(to >= 0)
    some = some[np.lexsort((place[some], to[some]))]
    to, came = to[some], came[some]
    nth = np.arange(len(to)) - np.searchsorted(to, to, side="left")
    out = np.full((n, most), -1, np.int64)
    fits = nth < most
    out[to[fits], nth[fits]] = came[fits]
    return out


def _reachable(graph: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Adds an edge from the nearest vector that is reached to each tree that is not, so a search can come to every vector."""
    seen = np.zeros(len(x), bool)

    def spread(front: np.ndarray) -> None:
        seen[front] = True
        while len(front):
            front = np.unique(graph[front])
            front = front[front >= 0]
            front = front[~seen[front]]
            seen[front] = True

    spread(starts)
    while not seen.all():
        lost = int(np.flatnonzero(~seen)[0])
        reached = np.flatnonzero(seen)
        near = int(reached[(x[reached] @ x[lost]).argmax()])
        free = np.flatnonzero(graph[near] < 0)
        if not len(free):
            graph = np.concatenate([graph, np.full((len(graph), 1), -1, np.int64)], axis=1)
            free = [graph.shape[1] - 1]
        graph[near, free[0]] = lost
        spread(np.array([lost]))
    return graph


def range_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, asked: np.ndarray, reach: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, distance) of what is found within `reach` of each query, for blocks of queries; the query itself is left out.

    A beam goes from the medoids towards the query until its `beam` best are all expanded. Then the range is expanded: neighbours of
    what lies within reach are looked at, and theirs, until nothing new is within reach.
    """
    x = x.astype(np.float32)
    for a in range(0, len(asked), AT_ONCE):
        yield _search(x, graph, starts, asked[a : a + AT_ONCE], reach, beam)


def _search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, own: np.ndarray, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = len(x), len(own)
    q = x[own]
    far = np.full((m, n), np.inf, np.float32)  # what is inf has not been looked at
    done = np.zeros((m, n), bool)
    rows = np.arange(m)
    front = np.full((m, beam), -1, np.int64)
    front[:, : min(beam, len(starts))] = starts[:beam]
    there = front >= 0
    r, c = np.nonzero(there)
    far[r, front[r, c]] = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nd->n", q[r], x[front[r, c]]), 0))
    active = rows
    while len(active):
        open_ = np.where((front[active] >= 0) & ~done[active[:, None], np.maximum(front[active], 0)], far[active[:, None], np.maximum(front[active], 0)], np.inf)
        best = open_.argmin(1)
        goes = np.isfinite(open_[np.arange(len(active)), best])
        active, best = active[goes], best[goes]
        if not len(active):
            break
        at = front[active, best]
        done[active, at] = True  # of each query one at a time
        near = graph[at]
        fresh = (near >= 0) & ~np.isfinite(far[active[:, None], np.maximum(near, 0)])
        r, c = np.nonzero(fresh)
        to, who = near[r, c], active[r]
        gap = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nd->n", q[who], x[to]), 0))
        far[who, to] = gap
        new = np.full(near.shape, np.inf)
        new[r, c] = gap
        both = np.concatenate([front[active], np.where(fresh, near, -1)], axis=1)
        gaps = np.concatenate([np.where(front[active] >= 0, far[active[:, None], np.maximum(front[active], 0)], np.inf), new], axis=1)
        order = np.argsort(gaps, axis=1, kind="stable")[:, :beam]
        front[active] = np.where(np.isfinite(np.take_along_axis(gaps, order, 1)), np.take_along_axis(both, order, 1), -1)
    who, at = np.nonzero((far <= reach) & ~done)
    while len(who):  # the range; of what the beam has expanded all neighbours have been looked at
        fresh_who, fresh_at = [], []
        for i in range(0, len(who), FOUND_AT_ONCE):
            near = graph[at[i : i + FOUND_AT_ONCE]]
            w, to = np.broadcast_to(who[i : i + FOUND_AT_ONCE, None], near.shape)[near >= 0], near[near >= 0]
            fresh = ~np.isfinite(far[w, to])
            pairs = np.unique(w[fresh] * n + to[fresh])
            w, to = pairs // n, pairs % n
            gap = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nd->n", q[w], x[to]), 0))
            far[w, to] = gap
            fresh_who.append(w[gap <= reach])
            fresh_at.append(to[gap <= reach])
        who, at = np.concatenate(fresh_who), np.concatenate(fresh_at)
    r, c = np.nonzero(far <= reach)
    other = own[r] != c
    return own[r[other]], c[other], far[r[other], c[other]].astype(np.float64)
