"""Hierarchical navigable small-world graphs in numpy: built and searched for many vectors at once."""

from __future__ import annotations

import numpy as np

DEGREE = 12  # links of a vector in the upper layers; twice as many in the lowest
BUILD_BEAM = 48
EXPAND = 4  # beam members expanded at once
AT_ONCE = 256
SCAN = 8  # a beam wider than this part of the graph costs more than a plain scan
TOP = 32  # the highest layer has at most so many vectors and is searched whole


def _chosen(own: np.ndarray, cand: np.ndarray, sim: np.ndarray, vectors: np.ndarray, degree: int) -> np.ndarray:
    """Links per row among `cand` (-1: none): spread ones first, then the nearest of the rest.

    A candidate is spread if it is nearer to the row's vector than to every candidate chosen before.
    """
    order = np.argsort(-np.where(cand >= 0, sim, -np.inf), axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    there = cand >= 0
    near = vectors[np.maximum(cand, 0)]
    among = near @ near.transpose(0, 2, 1)
    taken, number = np.zeros(cand.shape, bool), np.zeros(len(cand), int)
    for c in range(cand.shape[1]):
        blocked = (taken & (among[:, c, :] > sim[:, c, None])).any(axis=1)
        ok = there[:, c] & ~blocked & (number < degree)
        taken[:, c] = ok
        number += ok
    rank = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :degree]
    picked = np.where(np.take_along_axis(there, rank, 1), np.take_along_axis(cand, rank, 1), -1)
    if picked.shape[1] < degree:
        picked = np.pad(picked, ((0, 0), (0, degree - picked.shape[1])), constant_values=-1)
    return picked


class Layer:
    """One small-world graph over `vectors`; rows enter in their order."""

    def __init__(self, vectors: np.ndarray, degree: int):
        self.vectors, self.degree, self.size = vectors, degree, 0
        self.links = np.full((len(vectors), degree), -1, np.int32)

    def beam(self, q: np.ndarray, entry: np.ndarray, ef: int, at_least: float | None = None):
        """The `ef` best rows found per query (ids, similarities), and all met (query, row) of `at_least` or more."""
        n, b = self.size, len(q)
        seen = np.zeros((b, n), bool)
        ids, sims = np.full((b, ef), -1, np.int64), np.full((b, ef), -np.inf, np.float32)
        done = np.ones((b, ef), bool)
        who = np.arange(b)
        ids[:, 0], sims[:, 0] = entry, np.einsum("bd,bd->b", self.vectors[entry], q)
        done[:, 0] = False
        seen[who, entry] = True
        hits = []
        if at_least is not None:
            first = np.nonzero(sims[:, 0] >= at_least)[0]
            hits.append(np.stack([first, entry[first]], axis=1))
        live = who
        while len(live):
            waiting = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-waiting, min(EXPAND, ef) - 1, axis=1)[:, :EXPAND]
            open_ = np.take_along_axis(waiting, pick, 1) > -np.inf
            some = open_.any(axis=1)
            live, pick, open_ = live[some], pick[some], open_[some]
            if not len(live):
                break
            at = np.where(open_, ids[live[:, None], pick], -1)
            flags = done[live]
            np.put_along_axis(flags, pick, np.take_along_axis(flags, pick, 1) | open_, 1)
            done[live] = flags
            new = np.where(at[:, :, None] >= 0, self.links[np.maximum(at, 0)], -1).reshape(len(live), -1)
            fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
            order = np.argsort(new, axis=1, kind="stable")  # the same row may be met twice in one step
            ranked = np.take_along_axis(new, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
            fresh &= ~twice
            row, col = np.nonzero(fresh)
            node = new[row, col]
            seen[live[row], node] = True
            value = np.full(new.shape, -np.inf, np.float32)
            value[row, col] = np.einsum("bd,bd->b", self.vectors[node], q[live[row]])
            if at_least is not None:
                good = value[row, col] >= at_least
                hits.append(np.stack([live[row[good]], node[good]], axis=1))
            all_sims = np.concatenate([sims[live], value], axis=1)
            all_ids = np.concatenate([ids[live], np.where(fresh, new, -1)], axis=1)
            all_done = np.concatenate([done[live], ~fresh], axis=1)
            best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)
        return ids, sims, (np.concatenate(hits) if hits else np.zeros((0, 2), np.int64))

    def insert(self, n: int, entry: np.ndarray) -> None:
        """Add the next `n` rows together: links to what a beam finds, to the best of the batch, and back."""
        lo, hi = self.size, self.size + n
        q = self.vectors[lo:hi]
        parts, part_sims = [], []
        if lo:
            ids, sims, _ = self.beam(q, np.minimum(entry, lo - 1), min(BUILD_BEAM, lo))
            parts.append(ids)
            part_sims.append(sims)
        if n > 1:
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            k = min(self.degree, n - 1)
            best = np.argpartition(-own, k - 1, axis=1)[:, :k]
            parts.append(best + lo)
            part_sims.append(np.take_along_axis(own, best, 1))
        self.size = hi
        if not parts:
            return
        cand, sim = np.concatenate(parts, axis=1), np.concatenate(part_sims, axis=1)
        out = _chosen(q, cand, sim, self.vectors, self.degree)
        self.links[lo:hi] = out
        src, col = np.nonzero(out >= 0)
        to, src = out[src, col], src + lo
        order = np.lexsort((-np.einsum("bd,bd->b", self.vectors[to], self.vectors[src]), to))
        to, src = to[order], src[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        nth = np.arange(len(to)) - np.repeat(first, count)
        width = min(int(count.max()), self.degree)
        back = np.full((len(nodes), width), -1, np.int64)
        ok = nth < width  # the nearest; more than a vector's links can't be kept
        back[np.repeat(np.arange(len(nodes)), count)[ok], nth[ok]] = src[ok]
        back[(back[:, :, None] == self.links[nodes][:, None, :]).any(axis=2)] = -1
        for k in range(0, len(nodes), AT_ONCE):
            at = nodes[k:k + AT_ONCE]
            cand = np.concatenate([self.links[at].astype(np.int64), back[k:k + AT_ONCE]], axis=1)
            sim = np.einsum("bcd,bd->bc", self.vectors[np.maximum(cand, 0)], self.vectors[at])
            self.links[at] = _chosen(self.vectors[at], cand, sim, self.vectors, self.degree)


class Hnsw:
    """Layers over unit vectors; rows are reordered so that each layer is a prefix of the one below."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-300)) / np.log(DEGREE)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.vectors = np.ascontiguousarray(vectors[self.order], dtype=np.float32)
        sizes = [n]
        for k in range(1, int(level.max(initial=0)) + 1):
            if sizes[-1] <= TOP:
                break
            sizes.append(int((level >= k).sum()))
        if sizes[-1] > TOP:
            sizes.append(TOP)
        self.layers: list[Layer] = []  # highest first; the very top is searched whole
        self.top = sizes[-1]
        for k in range(len(sizes) - 1, -1, -1):
            layer = Layer(self.vectors[: sizes[k]], 2 * DEGREE if k == 0 else DEGREE)
            while layer.size < sizes[k]:
                step = min(sizes[k] - layer.size, max(32, min(AT_ONCE, layer.size // 8)))
                layer.insert(step, self._entry(self.vectors[layer.size:layer.size + step], self.layers))
            self.layers.append(layer)

    def _entry(self, q: np.ndarray, layers: list[Layer]) -> np.ndarray:
        """Nearest row of each query that a descent through `layers` finds."""
        if not layers:
            return np.zeros(len(q), np.int64)
        at = np.argmax(q @ self.vectors[: self.top].T, axis=1)
        for layer in layers[1:]:
            ids, sims, _ = layer.beam(q, at, min(8, layer.size))
            at = ids[np.arange(len(q)), np.argmax(sims, axis=1)]
        return at

    def within(self, q: np.ndarray, at_least: float, ef: int) -> np.ndarray:
        """(query, row of the original order) met at similarity `at_least` or more by a beam of `ef`.

        For a query with hits in half of its beam, and for a beam of an eighth of all rows, all rows are scanned.
        """
        out = []
        for start in range(0, len(q), AT_ONCE):
            todo, own = np.arange(start, min(start + AT_ONCE, len(q))), q[start:start + AT_ONCE]
            if ef * SCAN < len(self.vectors):
                hits = self.layers[-1].beam(own, self._entry(own, self.layers[:-1]), ef, at_least)[2]
                many = np.bincount(hits[:, 0], minlength=len(todo)) * 2 > ef
                hits = hits[~many[hits[:, 0]]]
                out.append(np.stack([todo[hits[:, 0]], self.order[hits[:, 1]]], axis=1))
                todo, own = todo[many], own[many]
            if len(todo):
                hits = np.argwhere(own @ self.vectors.T >= at_least)
                out.append(np.stack([todo[hits[:, 0]], self.order[hits[:, 1]]], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)
