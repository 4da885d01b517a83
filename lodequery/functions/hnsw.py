"""Hierarchical navigable small-world graph over the vectors of one shard, after Malkov and Yashunin.

The graph is a few flat arrays: for each layer the nodes in it and a matrix of neighbour numbers, padded with the
number of vectors. Everything works on many nodes or queries at once: their beams advance in step, as matrices, so the
interpreter's cost is shared by a whole block. Layers are built from the top down; within a layer nodes are inserted in
growing batches, each of which sees the graph so far and its own batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

_CELLS = 1_000_000  # of the matrix of visited nodes of one block of queries


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, as float32; a zero row stays zero."""
    x = np.asarray(vectors, np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).astype(np.float32)


#: A place of a beam that holds nothing.
_NONE = np.int64(np.iinfo(np.int64).max)


def _keys(similarity: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Similarity, node and an open mark in one number; smaller is nearer. The bits of a positive float rise with it."""
    far = np.maximum(np.float32(2) - similarity.astype(np.float32), np.float32(0))
    return far.view(np.int32).astype(np.int64) << 32 | ids.astype(np.int64) << 1 | 1


def _ids(keys: np.ndarray, n: int) -> np.ndarray:
    return np.where(keys == _NONE, n, (keys & 0xFFFFFFFF) >> 1)


def _similarities(keys: np.ndarray) -> np.ndarray:
    far = (keys >> 32).astype(np.int32).view(np.float32)
    return np.where(keys == _NONE, np.float32(-np.inf), np.float32(2) - far)


def _dots(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """[b, c]: products of each row of q with the c vectors named for it."""
    return np.matmul(x.take(ids, axis=0), q[:, :, None])[:, :, 0]


def draw_levels(n: int, m: int, seed: int) -> np.ndarray:
    """Each node's top layer: floor(-ln(U) / ln(m)), U uniform in (0, 1]."""
    u = 1.0 - np.random.default_rng(seed).random(n)
    return np.floor(-np.log(u) / math.log(m)).astype(np.int64)


def select_diverse(to_node: np.ndarray, among: np.ndarray, m: int, sure: int = 1) -> np.ndarray:
    """Which candidates to link to, as a mask: the nearest first, each only if it is nearer to the node than to every one kept.

    The ``sure`` nearest are kept in any case: more than one holds groups of near copies together. to_node [b, c]: similarity of candidates, in descending order, -inf for none; among [b, c, c]: between candidates.
    """
    b, c = to_node.shape
    kept = np.zeros((b, c), bool)
    count = np.zeros(b, np.int64)
    for j in range(c):
        near = (kept[:, :j] & (among[:, j, :j] > to_node[:, j, None])).any(axis=1)
        good = (~near | (j < sure)) & (count < m) & np.isfinite(to_node[:, j])
        kept[:, j] = good
        count += good
    return kept


def select_closest(to_node: np.ndarray, m: int) -> np.ndarray:
    """The m nearest candidates, as a mask."""
    return np.isfinite(to_node) & (np.arange(to_node.shape[1])[None, :] < m)


@dataclass
class HNSW:
    m: int = 8
    ef_construction: int = 32
    diverse: bool = True
    sure: int = 1
    seed: int = 0
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))  # last row: padding
    nodes: list[np.ndarray] = field(default_factory=list)  # by layer
    links: list[np.ndarray] = field(default_factory=list)  # by layer: [vectors, m or 2 m]; rows of nodes elsewhere are empty
    entry: int = -1

    @property
    def size(self) -> int:
        return self.vectors.shape[0] - 1

    def build(self, vectors: np.ndarray) -> HNSW:
        x = unit(vectors)
        n = x.shape[0]
        self.vectors = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
        if not n:
            return self
        level = draw_levels(n, self.m, self.seed)
        order = np.argsort(-level, kind="stable")
        self.entry = int(order[0])
        top = int(level.max())
        self.nodes = [order[level[order] >= lay] for lay in range(top + 1)]
        self.links = [np.full((n + 1, 2 * self.m if lay == 0 else self.m), n, np.int32) for lay in range(top + 1)]
        for lay in range(top, -1, -1):
            self._fill(lay)
        return self

    def _fill(self, lay: int) -> None:
        nodes = self.nodes[lay]
        done = 1
        while done < nodes.size:
            batch = nodes[done : done + min(max(8, done), 512)]
            q = self.vectors[batch]
            ids, sims = self._beam(lay, q, self._descend(q, lay), self.ef_construction)
            mates = q @ q.T
            np.fill_diagonal(mates, -np.inf)
            most = min(self.ef_construction, batch.size)
            best = np.argpartition(-mates, most - 1, axis=1)[:, :most]
            ids = np.hstack([ids, batch[best]])
            sims = np.hstack([sims, np.take_along_axis(mates, best, 1)])
            self._link(lay, batch, ids, sims)
            done += batch.size

    def _pick(self, ids: np.ndarray, sims: np.ndarray, width: int, m: int) -> np.ndarray:
        """Up to m neighbours out of candidates, padded, nearest first."""
        order = np.argsort(-sims, axis=1)[:, :width]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        if self.diverse:
            v = self.vectors.take(ids, axis=0)
            kept = select_diverse(sims, v @ v.transpose(0, 2, 1), m, self.sure)
        else:
            kept = select_closest(sims, m)
        place = np.argsort(~kept, axis=1, kind="stable")[:, :m]
        ids, kept = np.take_along_axis(ids, place, 1), np.take_along_axis(kept, place, 1)
        ids[~kept] = self.size
        if ids.shape[1] < m:
            ids = np.pad(ids, ((0, 0), (0, m - ids.shape[1])), constant_values=self.size)
        return ids

    def _link(self, lay: int, batch: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        links, n, width = self.links[lay], self.size, max(self.ef_construction, 4 * self.m)
        chosen = self._pick(ids, sims, width, self.m)
        links[batch, : self.m] = chosen
        source, place = np.nonzero(chosen < n)
        target, source = chosen[source, place], batch[source]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        near = np.einsum("ij,ij->i", self.vectors[target], self.vectors[source])
        order = np.lexsort((-near, target))
        target, source = target[order], source[order]
        own, begin, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(target.size) - np.repeat(begin, count)
        room = links.shape[1]
        few = rank < width  # the nearest of very many that want to link to one node
        back = np.full((own.size, min(width, int(count.max()) if count.size else 1)), n, np.int64)
        row = np.repeat(np.arange(own.size), count)
        back[row[few], rank[few]] = source[few]
        every = np.hstack([links[own].astype(np.int64), back])
        every.sort(axis=1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = n
        used = (every < n).sum(axis=1)
        every.sort(axis=1)
        fits = used <= room
        wide = every[:, :room]
        if wide.shape[1] < room:
            wide = np.pad(wide, ((0, 0), (0, room - wide.shape[1])), constant_values=n)
        links[own[fits]] = wide[fits]
        if not fits.all():
            full, cands = own[~fits], every[~fits][:, : int(used.max())]
            near = _dots(self.vectors, cands, self.vectors[full])
            near[cands == n] = -np.inf
            links[full] = self._pick(cands, near, cands.shape[1], room)

    def _descend(self, q: np.ndarray, above: int) -> np.ndarray:
        """Each query's nearest node by hill climbing on every layer above the given one."""
        at = np.full(q.shape[0], self.entry, np.int64)
        best = np.einsum("ij,ij->i", self.vectors[at], q)
        for lay in range(len(self.links) - 1, above, -1):
            moving = np.arange(q.shape[0])
            while moving.size:
                near = self.links[lay][at[moving]]
                sims = _dots(self.vectors, near, q[moving])
                sims[near == self.size] = -np.inf
                j = sims.argmax(axis=1)
                sim = sims[np.arange(moving.size), j]
                up = sim > best[moving]
                at[moving[up]] = near[up, j[up]]
                best[moving[up]] = sim[up]
                moving = moving[up]
        return at

    def _beam(self, lay: int, q: np.ndarray, entry: np.ndarray, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) [queries, ef] of each query's best nodes on a layer, nearest first; padding has -inf.

        The ``step`` best open nodes of a beam are expanded at once. A place of a beam is one number, see ``_keys``, so a
        beam is kept by sorting.
        """
        n, links, x = self.size, self.links[lay], self.vectors
        out = np.full((q.shape[0], ef), _NONE)
        block = max(64, _CELLS // (n + 1))
        for lo in range(0, q.shape[0], block):
            qs = q[lo : lo + block]
            slot = np.arange(qs.shape[0])  # of each beam that is still open: its row in the block
            visited = np.zeros(slot.size * (n + 1), bool)
            visited[n :: n + 1] = True
            row = slot * (n + 1)
            at = entry[lo : lo + block].astype(np.int64)
            visited[row + at] = True
            beam = np.full((slot.size, ef), _NONE)
            beam[:, 0] = _keys(np.einsum("ij,ij->i", x[at], qs), at)
            while slot.size:
                open_ = (beam & 1).astype(bool) & (beam != _NONE)
                going = open_.any(axis=1)
                if going.sum() < 0.8 * slot.size or not going.any():  # closed beams leave together, now and then
                    out[lo + slot[~going]] = beam[~going]
                    slot, qs, row, beam, open_ = slot[going], qs[going], row[going], beam[going], open_[going]
                    if not slot.size:
                        break
                # beams are sorted, so the first open places are the best ones
                nth = np.cumsum(open_, axis=1, dtype=np.int16)
                r, c = np.nonzero(open_ & (nth <= step))
                front = np.full((slot.size, step), n, np.int64)
                front[r, nth[r, c] - 1] = _ids(beam[r, c], n)
                beam[r, c] -= 1
                cand = links.take(front.ravel(), axis=0).reshape(slot.size, -1)
                seen = visited.take(cand + row[:, None])
                cand[seen] = n
                cand.sort(axis=1)
                width = cand.shape[1] - int(seen.sum(axis=1).min())
                if not width:
                    continue
                cand = cand[:, :width]
                cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
                visited[cand + row[:, None]] = True
                new = _keys(_dots(x, cand, qs), cand)
                new[cand == n] = _NONE
                every = np.concatenate([beam, new], axis=1)
                every.sort(axis=1)
                beam = every[:, :ef].copy()
        return _ids(out, n), _similarities(out)

    def search(
        self, queries: np.ndarray, ef: int = 50, allowed: np.ndarray | None = None, entry: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, cosine similarities) [queries, ef], nearest first. Padding: the number of vectors, and -inf.

        ``allowed`` marks the vectors that a result may hold. The walk passes all nodes, with a beam so much wider that
        ``ef`` of its places are allowed ones on average; the fewer are allowed, the more it costs. ``entry`` gives a node to
        begin at instead of the descent.
        """
        q, n = unit(queries), self.size
        some = n if allowed is None else int(np.count_nonzero(allowed))
        if not some:
            return np.full((q.shape[0], ef), n, np.int64), np.full((q.shape[0], ef), -np.inf, np.float32)
        width = ef if allowed is None else max(ef, min(n, -(-ef * n // some)))
        ids, sims = self._beam(0, q, self._descend(q, 0) if entry is None else entry, width)
        if allowed is not None:
            good = np.append(allowed, False)[ids]
            first = np.argsort(~good, axis=1, kind="stable")[:, :ef]
            good, ids, sims = (np.take_along_axis(v, first, 1) for v in (good, ids, sims))
            ids, sims = np.where(good, ids, n), np.where(good, sims, np.float32(-np.inf))
        return ids, sims
