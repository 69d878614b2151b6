"""A hierarchical navigable small-world graph over unit vectors, built and searched in batches."""

from __future__ import annotations

import numpy as np


def pick_diverse(sims: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """Per row, which of its candidates (best first, -inf where none) become neighbours.

    A candidate is taken if it is closer to the row than to any one taken before; places left
    over go to the best of the others.
    """
    b, c = sims.shape
    taken = np.zeros((b, c), bool)
    near = np.full((b, c), -np.inf, np.float32)
    for j in range(c):
        ok = np.isfinite(sims[:, j]) & (sims[:, j] > near[:, j]) & (taken.sum(1) < most)
        taken[:, j] = ok
        near[ok] = np.maximum(near[ok], between[ok, :, j])
    room = most - taken.sum(1, keepdims=True)
    spare = ~taken & np.isfinite(sims)
    return taken | (spare & (np.cumsum(spare, axis=1) <= room))


def dots(v: np.ndarray, at: np.ndarray, q: np.ndarray, row: np.ndarray, block: int = 1024) -> np.ndarray:
    """v[at[i]] times q[row[i]], in blocks whose vectors stay in the cache."""
    out = np.empty(len(at), v.dtype)
    left, right = np.empty((2, block, v.shape[1]), v.dtype)
    for a in range(0, len(at), block):
        k = len(at[a : a + block])
        np.take(v, at[a : a + k], axis=0, out=left[:k], mode="clip")
        np.take(q, row[a : a + k], axis=0, out=right[:k], mode="clip")
        np.einsum("kd,kd->k", left[:k], right[:k], out=out[a : a + k])
    return out


class Graph:
    def __init__(self, vectors: np.ndarray, m: int = 12, seed: int = 1):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1.0 - rng.random(n)) / np.log(m)).astype(int) if n else np.zeros(0, int)
        self.m, self.seen = m, np.zeros(0, bool)
        self.members: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        for layer in range((level.max() if n else 0) + 1):
            self.members.append(np.flatnonzero(level >= layer).astype(np.int32))
            self.links.append(np.full((n, 2 * m if layer == 0 else m), -1, np.int32))

    def build(self, beam: int = 40, batch: int = 512) -> Graph:
        for layer in range(len(self.members) - 1, -1, -1):
            nodes = self.members[layer]
            done = 0
            while done < len(nodes):
                new = nodes[done : done + min(max(32, done), batch)]
                self._insert(layer, nodes[:done], new, beam)
                done += len(new)
        return self

    def entry(self, layer: int, q: np.ndarray, top: int | None = None) -> np.ndarray:
        """Greedy descent from the top to a start for each query in `layer`."""
        top = len(self.members) - 1 if top is None else top
        at = np.full(len(q), self.members[top][0], np.int64)
        for k in range(top, layer, -1):
            at = self.search(k, q, at[:, None], 1)[0][:, 0]
        return at

    def search(self, layer: int, q: np.ndarray, start: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search from start (rows x s); ids and similarities, best first, -1 and -inf where none."""
        b, n = len(q), len(self.v)
        links = self.links[layer]
        if len(self.seen) < b * n:
            self.seen = np.zeros(b * n, bool)
        rows = np.arange(b)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        s = min(start.shape[1], beam)
        ids[:, :s] = start[:, :s]
        first = self.v[np.maximum(ids[:, :s], 0)]
        sims[:, :s] = np.where(ids[:, :s] >= 0, np.einsum("bkd,bd->bk", first, q), -np.inf)
        open_ = ids >= 0
        marked = [(rows[:, None] * n + ids)[open_]]
        self.seen[marked[0]] = True
        e = min(expand, beam)
        while len(rows):
            cand = np.where(open_[rows], sims[rows], -np.inf)
            pick = np.argpartition(-cand, e - 1, axis=1)[:, :e]
            good = np.isfinite(np.take_along_axis(cand, pick, 1))
            live = good.any(1)
            rows, pick, good = rows[live], pick[live], good[live]
            if not len(rows):
                break
            open_[rows[:, None], pick] &= ~good
            at = ids[rows[:, None], pick]
            nb = np.where(good[:, :, None], links[np.where(good, at, 0)], -1).reshape(len(rows), -1)
            # the places in `seen` of what is met for the first time; one id may come from several of the expanded nodes
            key = (rows[:, None] * n + nb)[nb >= 0]
            key = np.sort(key[~self.seen[key]])
            key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
            self.seen[key] = True
            marked.append(key)
            row = key // n
            node = key - row * n
            got = dots(self.v, node, q, row)
            # only those that are better than a beam's last go on, packed to the left
            better = got > sims.min(1)[row]
            row, node, got = row[better], node[better], got[better]
            if not len(row):
                continue
            count = np.bincount(row, minlength=b)
            new, count = np.flatnonzero(count), count[count > 0]
            where = np.repeat(np.arange(len(new)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            width = beam + int(count.max())
            all_i, all_s, all_o = np.full((len(new), width), -1, np.int64), np.full((len(new), width), -np.inf, np.float32), np.zeros((len(new), width), bool)
            all_i[:, :beam], all_s[:, :beam], all_o[:, :beam] = ids[new], sims[new], open_[new]
            all_i[where, beam + place], all_s[where, beam + place], all_o[where, beam + place] = node, got, True
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[new], ids[new], open_[new] = (np.take_along_axis(x, best, 1) for x in (all_s, all_i, all_o))
        for key in marked:
            self.seen[key] = False
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.where(np.isfinite(np.take_along_axis(sims, order, 1)), np.take_along_axis(ids, order, 1), -1), np.take_along_axis(sims, order, 1)

    def _insert(self, layer: int, old: np.ndarray, new: np.ndarray, beam: int) -> None:
        q = self.v[new]
        mutual = q @ q.T
        np.fill_diagonal(mutual, -np.inf)
        c = min(len(new) - 1, 16)
        ids = np.zeros((len(new), 0), np.int64)
        sims = np.zeros((len(new), 0), np.float32)
        if c:
            part = np.argpartition(-mutual, c - 1, axis=1)[:, :c]
            ids, sims = new[part].astype(np.int64), np.take_along_axis(mutual, part, 1)
        if len(old):
            start = np.full(len(new), old[0], np.int64) if layer == len(self.members) - 1 else self.entry(layer, q)
            # an upper layer's node is in this layer too, but perhaps not yet inserted
            start = np.where(np.isin(start, old), start, old[0])
            got, s = self.search(layer, q, start[:, None], beam)
            ids, sims = np.concatenate([ids, got], 1), np.concatenate([sims, s], 1)
        if not ids.shape[1]:
            return
        self._choose(layer, new, ids, sims, self.m)
        # the way back, for each neighbour all at once; of more than 64 newcomers it sees the first,
        # which changes what the graph looks like and not what may be found
        links = self.links[layer]
        src = np.repeat(new, links.shape[1])
        dst = links[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        at, start, count = np.unique(dst, return_index=True, return_counts=True)
        most = 64
        back = np.full((len(at), most), -1, np.int64)
        place = np.arange(len(dst)) - np.repeat(start, count)
        fit = place < most
        back[np.repeat(np.arange(len(at)), count)[fit], place[fit]] = src[fit]
        # nodes with about as many newcomers go together: most have one or two
        by = np.argsort(count, kind="stable")
        for a in range(0, len(at), 256):
            some = by[a : a + 256]
            i = np.concatenate([links[at[some]].astype(np.int64), back[some, : min(most, int(count[some[-1]]))]], 1)
            s = np.einsum("bkd,bd->bk", self.v[np.maximum(i, 0)], self.v[at[some]])
            self._choose(layer, at[some], i, np.where(i >= 0, s, -np.inf).astype(np.float32), links.shape[1])

    def _choose(self, layer: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> None:
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most + 16]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        same = np.zeros(ids.shape, bool)
        by = np.argsort(ids, axis=1, kind="stable")
        ordered = np.take_along_axis(ids, by, 1)
        np.put_along_axis(same, by[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        sims = np.where((ids < 0) | same | (ids == nodes[:, None]), -np.inf, sims)
        vec = self.v[np.maximum(ids, 0)]
        taken = pick_diverse(sims, np.matmul(vec, vec.transpose(0, 2, 1)), most)
        left = np.argsort(~taken, axis=1, kind="stable")[:, :most]
        out = np.full((len(nodes), self.links[layer].shape[1]), -1, np.int32)
        out[:, : left.shape[1]] = np.where(np.take_along_axis(taken, left, 1), np.take_along_axis(ids, left, 1), -1)
        self.links[layer][nodes] = out

    def dump(self) -> tuple[bytes, list[int]]:
        parts, sizes = [], []
        for layer, nodes in enumerate(self.members):
            rows = self.links[layer] if layer == 0 else self.links[layer][nodes]
            parts += [nodes.tobytes(), rows.tobytes()]
            sizes.append(len(nodes))
        return b"".join(parts), sizes

    @classmethod
    def load(cls, vectors: np.ndarray, blob: bytes, sizes: list[int], m: int) -> Graph:
        g = cls.__new__(cls)
        g.v, g.m, g.seen, g.members, g.links = np.ascontiguousarray(vectors, np.float32), m, np.zeros(0, bool), [], []
        at = 0
        for layer, k in enumerate(sizes):
            nodes = np.frombuffer(blob, np.int32, k, at)
            at += 4 * k
            width = 2 * m if layer == 0 else m
            rows = np.frombuffer(blob, np.int32, k * width, at).reshape(k, width)
            at += 4 * k * width
            full = np.full((len(vectors), width), -1, np.int32)
            full[nodes] = rows
            g.members.append(nodes)
            g.links.append(full)
        return g

    def within(self, q: np.ndarray, least: float, beam: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) pairs of similarity >= least that the beam holds, and which queries have it full of them.

        Queries with a full beam may have more such nodes, and none of theirs are returned.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.v) or not len(q):
            return *none, np.zeros(len(q), bool)
        out, full = [none], np.zeros(len(q), bool)
        size = max(16, min(512, (32 << 20) // (len(self.v) + 1)))
        for a in range(0, len(q), size):
            part = q[a : a + size]
            first = self.entry(0, part)[:, None] if start is None else start[a : a + size, None]
            ids, sims = self.search(0, part, first, min(beam, len(self.v)))
            hit = sims >= least
            full[a : a + size] = hit.all(1)
            r, c = np.nonzero(hit & ~hit.all(1)[:, None])
            out.append((r + a, ids[r, c]))
        return *(np.concatenate(x) for x in zip(*out, strict=True)), full
