"""A sort-tile-recursive packed R-tree over boxes, probed for whole arrays at once."""

from __future__ import annotations

import numpy as np


class PackedRTree:
    """Boxes (lat_lo, lat_hi, lon_lo, lon_hi) packed bottom-up, ``fanout`` to a node."""

    def __init__(self, lat_lo, lat_hi, lon_lo, lon_hi, fanout: int = 16):
        n = len(lat_lo)
        order = np.arange(n)
        if n > fanout:
            leaves = -(-n // fanout)
            slabs = max(1, int(np.ceil(np.sqrt(leaves))))
            by_lon = np.argsort(lon_lo + lon_hi, kind="stable")
            slab = np.empty(n, dtype=np.int64)
            slab[by_lon] = np.arange(n) // (-(-n // slabs))
            order = np.lexsort((lat_lo + lat_hi, slab))
        self.order, self.fanout = order, fanout
        self.levels = [tuple(np.asarray(x, dtype=float)[order] for x in (lat_lo, lat_hi, lon_lo, lon_hi))]
        while len(self.levels[-1][0]) > fanout:
            low = self.levels[-1]
            cuts = np.arange(0, len(low[0]), fanout)
            self.levels.append(
                (np.minimum.reduceat(low[0], cuts), np.maximum.reduceat(low[1], cuts), np.minimum.reduceat(low[2], cuts), np.maximum.reduceat(low[3], cuts))
            )

    def probe(self, lat_lo, lat_hi, lon_lo, lon_hi, batch: int = 4096):
        """All (probe index, box index) whose boxes touch; probes go in batches so that frontiers stay small."""
        found_q, found_b = [], []
        if not len(self.order):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        for a in range(0, len(lat_lo), batch):
            z = slice(a, a + batch)
            p, r, s, t = lat_lo[z], lat_hi[z], lon_lo[z], lon_hi[z]
            top = len(self.levels[-1][0])
            q = np.repeat(np.arange(len(p)), top)
            node = np.tile(np.arange(top), len(p))
            for depth in range(len(self.levels) - 1, -1, -1):
                box = self.levels[depth]
                hit = (box[0][node] <= r[q]) & (box[1][node] >= p[q]) & (box[2][node] <= t[q]) & (box[3][node] >= s[q])
                q, node = q[hit], node[hit]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    child = (node[:, None] * self.fanout + np.arange(self.fanout)[None, :]).ravel()
                    q = np.repeat(q, self.fanout)
                    real = child < below
                    q, node = q[real], child[real]
            found_q.append(q + a)
            found_b.append(self.order[node])
        return np.concatenate(found_q) if found_q else np.empty(0, np.int64), np.concatenate(found_b) if found_b else np.empty(0, np.int64)
