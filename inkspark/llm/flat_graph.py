"""A robust-pruned proximity graph over unit vectors, built and searched for many points at once in numpy.

Nodes are rows of a matrix; edges are an integer matrix with -1 for none. Points are inserted in batches of doubling size: each searches the graph
from its medoid, keeps a pruned choice of the nodes that it expanded, and its neighbours get it back as a neighbour.
"""

from __future__ import annotations

import numpy as np

DEGREE = 24
BEAM = 40
ALPHA = 1.2
BATCH = 128
CANDIDATES = 64


def medoid(unit: np.ndarray) -> int:
    """The row nearest to the mean."""
    return int(np.argmax(unit @ unit.mean(0)))


def search(unit: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(similarity of each query with each node that it met, else -inf; whether it expanded the node).

    Greedy: the best node not yet expanded is expanded while it is among the ``beam`` best. ``reach`` (queries x nodes) is the
    similarity from which a node is in range; nodes in range are expanded whatever the beam, so that the search grows with its range.
    """
    n, total = len(unit), len(queries)
    met = np.full((total, n), -np.inf, np.float32)
    done = np.zeros((total, n), bool)
    met[:, start] = queries @ unit[start]
    left = np.arange(total)
    while len(left):
        best = np.where(done[left], -np.inf, met[left])
        node = best.argmax(1)
        value = best[np.arange(len(left)), node]
        go = np.isfinite(value) & ((met[left] > value[:, None]).sum(1) < beam)
        if reach is not None:
            go |= np.isfinite(value) & (value >= reach[left, node])
            # the best open node may be out of range while another one with a wider range isn't
            late = np.flatnonzero(~go & np.isfinite(value))
            if len(late):
                inside = (best[late] >= reach[left[late]]) & np.isfinite(best[late])
                some = inside.any(1)
                node[late[some]] = inside[some].argmax(1)
                go[late[some]] = True
        left, node = left[go], node[go]
        if not len(left):
            break
        done[left, node] = True
        near = edges[node]
        fresh = (near >= 0) & np.isneginf(met[left[:, None], np.maximum(near, 0)])
        row, col = np.nonzero(fresh)
        target = near[row, col]
        met[left[row], target] = np.einsum("ij,ij->i", unit[target], queries[left[row]])
    return met, done


def prune(unit: np.ndarray, points: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(points, degree) robust choice among candidates: the nearest, then those not much nearer to a chosen one than to the point."""
    out = np.full((len(points), degree), -1, np.int32)
    alive = (ids >= 0) & (ids != points[:, None])
    vectors = unit[np.maximum(ids, 0)]
    rows, filled = np.arange(len(points)), np.zeros(len(points), np.int64)
    for _ in range(degree):
        value = np.where(alive, sims, -np.inf)
        pick = value.argmax(1)
        live = np.isfinite(value[rows, pick])
        if not live.any():
            break
        r, p = rows[live], pick[live]
        chosen = ids[r, p]
        out[r, filled[r]] = chosen
        filled[r] += 1
        to_chosen = np.einsum("bmd,bd->bm", vectors[r], unit[chosen])
        alive[r] &= alpha * alpha * (1 - to_chosen) > 1 - sims[r]
        alive[r, p] = False
    return out


def _back(unit: np.ndarray, edges: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    """Adds each point to its neighbours' edges; neighbours with too many are pruned."""
    source, slot = np.nonzero(edges[points] >= 0)
    if not len(source):
        return
    target, own = edges[points][source, slot], points[source]
    order = np.argsort(target, kind="stable")
    target, own = target[order], own[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    extra = np.full((len(nodes), counts.max()), -1, np.int32)
    which = np.repeat(np.arange(len(nodes)), counts)
    extra[which, np.arange(len(target)) - np.repeat(first, counts)] = own
    both = np.concatenate([edges[nodes], extra], 1)
    both.sort(1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    many = (both >= 0).sum(1) > degree
    few = -np.sort(-both[~many], 1)
    width = min(degree, few.shape[1])
    edges[nodes[~many], :width] = few[:, :width]
    if many.any():
        ids, at = both[many], nodes[many]
        sims = np.einsum("bmd,bd->bm", unit[np.maximum(ids, 0)], unit[at])
        edges[at] = prune(unit, at, ids, sims, degree, alpha)


def build(unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> np.ndarray:
    """(rows, degree) edges of the graph over the rows."""
    n = len(unit)
    edges = np.full((n, degree), -1, np.int32)
    start = medoid(unit) if n else 0
    order = np.random.default_rng(11).permutation(n)
    order = np.r_[start, order[order != start]] if n else order
    at, size = 1, 1
    while at < n:
        points = order[at : at + size]
        met, done = search(unit, edges, start, unit[points], beam)
        value = np.where(done, met, -np.inf)
        width = min(CANDIDATES, n)
        ids = np.argpartition(-value, width - 1, 1)[:, :width] if width < n else np.broadcast_to(np.arange(n), value.shape).copy()
        sims = np.take_along_axis(value, ids, 1)
        ids = np.where(np.isfinite(sims), ids, -1)
        edges[points] = prune(unit, points, ids, sims, degree, alpha)
        _back(unit, edges, points, degree, alpha)
        at, size = at + len(points), min(2 * size, BATCH)
    return edges
