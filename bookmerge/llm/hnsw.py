"""A navigable small-world graph over the unit vectors of one shard, in numpy: many vectors are inserted or looked up at once.

Nodes are numbered by level, highest first, so layer l is the first ``sizes[l]`` nodes. A layer is built in batches: a batch looks for its
neighbours in the layer so far, and among itself; links are chosen so that a node is kept only if it is nearer to the
new one than to those already kept, and spare places go to the nearest. Beams of a batch advance in step.
"""

from __future__ import annotations

import numpy as np

#: Links of a node in the upper layers and in the lowest; beam while building; vectors inserted at once.
LINKS, LOW_LINKS, BUILD_BEAM, BATCH = 16, 32, 48, 512
#: Cells of the table of seen nodes, which bounds how many beams run at once.
SEEN = 1 << 26


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the ``width`` best that each query's beam meets from its entries, best first; -1 where there are fewer."""
    q, e = entry.shape
    seen = np.zeros((q, len(links)), bool)
    ids, sims = np.full((q, width), -1, np.int32), np.full((q, width), -np.inf, np.float32)
    done = np.ones((q, width), bool)
    ids[:, :e], done[:, :e] = entry, False
    sims[:, :e] = np.einsum("qed,qd->qe", vectors[entry], queries)
    np.put_along_axis(seen, entry.astype(np.int64), True, 1)
    live = np.arange(q)
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        at = open_.argmax(1)
        more = open_[np.arange(len(live)), at] > -np.inf
        live, at = live[more], at[more]
        if not len(live):
            break
        near = links[ids[live, at]]
        done[live, at] = True
        r, c = np.nonzero(near >= 0)
        rows, to = live[r], near[r, c]
        fresh = ~seen[rows, to]
        r, c, rows, to = r[fresh], c[fresh], rows[fresh], to[fresh]
        seen[rows, to] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("ij,ij->i", vectors[to], queries[rows])
        all_sims = np.concatenate([sims[live], found], 1)
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], found == -np.inf], 1), best, 1)
        sims[live] = np.take_along_axis(all_sims, best, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = np.take_along_axis(sims, order, 1)
    return np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), -1), sims


def _chosen(vectors: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """(rows, most): of each row's candidates those nearer to it than to one kept before; then the nearest others; -1 behind them."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    v = vectors[cand]
    between = v @ v.transpose(0, 2, 1)
    kept, nearest, n = np.zeros(cand.shape, bool), np.full(cand.shape, -np.inf, np.float32), np.zeros(len(cand), int)
    valid = sims > -np.inf
    for j in range(cand.shape[1]):
        ok = valid[:, j] & (sims[:, j] > nearest[:, j]) & (n < most)
        kept[:, j] = ok
        n += ok
        nearest[ok] = np.maximum(nearest[ok], between[ok, j])
    first = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(valid, first, 1), np.take_along_axis(cand, first, 1), -1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(vectors: np.ndarray, links: np.ndarray, batch: np.ndarray) -> None:
    """The nodes that the batch links to link back; where there is no place, the links are chosen anew."""
    most = links.shape[1]
    to = links[batch].ravel()
    source = np.repeat(batch, most)
    source, to = source[to >= 0], to[to >= 0]
    sims = np.einsum("ij,ij->i", vectors[source], vectors[to])
    order = np.lexsort((-sims, to))
    source, to = source[order], to[order]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, counts)
    keep = place < most // 2
    new = np.full((len(nodes), most // 2), -1, np.int32)
    new[np.repeat(np.arange(len(nodes)), counts)[keep], place[keep]] = source[keep]
    for at in range(0, len(nodes), 2048):
        some, fresh = nodes[at : at + 2048], new[at : at + 2048]
        cand = np.concatenate([links[some], fresh], 1)
        cand[:, most:][(fresh[:, :, None] == links[some][:, None, :]).any(2)] = -1  # batch nodes may link to each other both ways
        near = np.where(cand >= 0, np.einsum("ncd,nd->nc", vectors[cand], vectors[some]), -np.inf).astype(np.float32)
        links[some] = _chosen(vectors, cand, near, most)


class Graph:
    """vectors (unit, float32, by level) with a link table for each layer, lowest first."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @staticmethod
    def levels(n: int) -> np.ndarray:
        """The level of each of n vectors, in their order."""
        u = np.random.default_rng(n).random(n)
        return np.floor(-np.log(1 - u) / np.log(LINKS)).astype(int)

    @classmethod
    def built(cls, vectors: np.ndarray, levels: np.ndarray) -> Graph:
        """levels: descending."""
        sizes = [int((levels >= x).sum()) for x in range(int(levels[0]) + 1)]
        graph = cls(vectors, [np.full((n, LINKS if x else LOW_LINKS), -1, np.int32) for x, n in enumerate(sizes)])
        for x in reversed(range(len(sizes))):
            graph._fill(x)
        return graph

    def _fill(self, layer: int) -> None:
        links, n = self.layers[layer], len(self.layers[layer])
        have = 0
        while have < n:
            batch = np.arange(have, min(n, have + min(BATCH, max(have, 64))))
            v = self.vectors[batch]
            inside = v @ v.T
            np.fill_diagonal(inside, -np.inf)
            width = min(LINKS, len(batch))
            cand = np.argpartition(-inside, width - 1, axis=1)[:, :width]
            sims = np.take_along_axis(inside, cand, 1)
            cand = batch[cand]
            if have:
                found, near = beam(self.vectors, links[:have], v, np.minimum(self.enter(v, layer), have - 1), BUILD_BEAM)
                cand, sims = np.concatenate([found, cand], 1), np.concatenate([near, sims], 1)
            links[batch] = _chosen(self.vectors, cand, sims, links.shape[1])
            _link_back(self.vectors, links, batch)
            have += len(batch)

    def enter(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """(queries, 1): where each query enters the layer, by way of those above."""
        at = np.zeros((len(queries), 1), np.int32)
        for links in reversed(self.layers[layer + 1 :]):
            at = beam(self.vectors, links, queries, at, 4)[0][:, :1]
        return at

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the best ``width`` that each query finds, best first."""
        step = int(np.clip(SEEN // max(1, len(self.vectors)), 32, 1024))
        parts = []
        for at in range(0, len(queries), step):
            q = queries[at : at + step]
            parts.append(beam(self.vectors, self.layers[0], q, self.enter(q, 0), width))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
