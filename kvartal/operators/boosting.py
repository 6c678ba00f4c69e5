"""Gradient boosted trees over binned features, for tables that fit one task.

Trees grow level by level: one histogram pass over all rows gives the gains of
all splits of a level.  Features whose bins occur together in few combinations
(those of a cell, say) are summed once, by combination.  Missing values have a bin of their own and
go to whichever side gains more.  Losses are squares, or the pinball loss of a
quantile, whose leaves take that quantile of their residuals.
"""

from __future__ import annotations

import numpy as np

BINS = 64
#: Most combinations of the features of a bundle, and rows of a slice; both keep a pass in the processor's cache.
COMBINATIONS = 1024
SLICE = 1 << 16
FEW = 4096
TREES = {"maxIter": 600, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}


def bundled(codes: list[np.ndarray], first: int, most: int) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Bundles (features, combination of each row, bins of each combination and feature) with up to ``most`` combinations, or one feature; they are numbered from ``first``."""
    bundles: list[tuple[list[int], np.ndarray, np.ndarray]] = []
    for j, code in enumerate(codes):
        for k, (features, joint, parts) in enumerate(bundles):
            both = joint * (BINS + 1) + code
            there = np.flatnonzero(np.bincount(both, minlength=1))
            if len(there) <= most:
                break
        else:
            k, features, both, parts = len(bundles), [], code, np.zeros((1, 0), dtype=np.uint8)
            there = np.flatnonzero(np.bincount(both, minlength=1))
            bundles.append(None)
        number = np.zeros(there.max(initial=0) + 1, dtype=np.int32)
        number[there] = np.arange(len(there))
        bundles[k] = ([*features, first + j], number[both], np.column_stack([parts[there // (BINS + 1)], there % (BINS + 1)]).astype(np.uint8))
    return bundles


def _by_bin(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combinations in the order of their bins, the bins, and where each starts."""
    there, starts = np.unique(np.sort(code), return_index=True)
    return np.argsort(code, kind="stable"), there.astype(np.int64), starts


class Booster:
    """``n`` trees of ``depth``; each sees shares ``rows`` of the rows and ``columns`` of the features; ``quantile`` chooses the pinball loss."""

    def __init__(self, n: int = 600, depth: int = 6, rate: float = 0.05, rows: float = 0.8, columns: float = 0.8, quantile: float | None = None, penalty: float = 1.0, least: int = 1, seed: int = 0):
        self.n, self.depth, self.rate, self.rows, self.columns = n, depth, rate, rows, columns
        self.quantile, self.penalty, self.least, self.seed = quantile, penalty, least, seed

    @classmethod
    def of(cls, seed: int = 0, quantile: float | None = None, **trees) -> "Booster":
        """With the parameter names of Spark's boosted trees."""
        t = {**TREES, **trees}
        share = t["featureSubsetStrategy"]
        return cls(int(t["maxIter"]), int(t["maxDepth"]), float(t["stepSize"]), float(t["subsamplingRate"]), 1.0 if share in ("auto", "all") else float(share), quantile, seed=seed)

    def _coded(self, v: np.ndarray, j: int) -> np.ndarray:
        """Bins of values of feature ``j``; BINS where there is none."""
        out = np.searchsorted(self.edges[j], v, side="left").astype(np.uint8)
        out[~np.isfinite(v)] = BINS
        return out

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self._coded(x[:, j], j) for j in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros(x.shape, dtype=np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, shared: np.ndarray | None = None, at: np.ndarray | None = None) -> "Booster":
        """Features are the columns of ``x`` and after them those of ``shared``, of which row i has row ``at[i]``."""
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        shared = np.zeros((1, 0)) if shared is None else np.asarray(shared, dtype=float)
        rng, n, own = np.random.default_rng(self.seed), len(y), x.shape[1]
        features = own + shared.shape[1]
        seen = np.unique(at) if shared.shape[1] else np.zeros(0, dtype=np.int64)
        self.edges = []
        for j in range(features):
            few = x[:, j] if j < own else shared[seen, j - own]
            v = np.unique(few[np.isfinite(few)])
            cuts = (v[1:] + v[:-1]) / 2
            if len(cuts) >= BINS:
                every = few if j < own else shared[at, j - own]
                cuts = np.unique(np.quantile(every[np.isfinite(every)], np.arange(1, BINS) / BINS))
            self.edges.append(cuts)
        most = min(COMBINATIONS, max(BINS + 1, n // 16))
        coded = [self._coded(x[:, j], j) for j in range(own)]
        x = few = every = None  # they may be most of a task's memory
        bundles = bundled(coded, 0, most)
        del coded
        if shared.shape[1]:
            bundles += [(f, code.astype(np.uint16)[at], parts) for f, code, parts in bundled([self._coded(shared[:, j], own + j) for j in range(shared.shape[1])], own, most)]
        codes = np.empty((n, len(bundles)), dtype=np.uint16)
        for b, (_, code, _) in enumerate(bundles):
            codes[:, b] = code
        bundles = [(f, parts, [_by_bin(parts[:, c]) for c in range(len(f))]) for f, _, parts in bundles]
        self.start = float(np.mean(y) if self.quantile is None else np.quantile(y, self.quantile)) if n else 0.0
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.cut, self.left_missing = (np.full((self.n, size), v, dtype=d) for v, d in ((-1, np.int16), (0, np.int16), (False, bool)))
        self.value = np.zeros((self.n, size))
        now = np.full(n, self.start)
        for t in range(self.n):
            rest = y - now
            gradient = rest if self.quantile is None else np.where(rest > 0, self.quantile, self.quantile - 1)
            taken = rng.random(n) < self.rows if self.rows < 1 else np.ones(n, dtype=bool)
            use = np.sort(rng.choice(features, max(1, round(self.columns * features)), replace=False)) if self.columns < 1 else np.arange(features)
            if taken.any():
                now += self.value[t].take(self._grow(t, codes, bundles, use, gradient, rest, taken))
        return self

    def _grow(self, t: int, codes: np.ndarray, bundles: list, use: np.ndarray, gradient: np.ndarray, rest: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """Grow a tree of the ``taken`` rows; the leaf of every row.

        A level is one pass over all rows in slices that stay in the cache: each
        row goes to its child, and those of the smaller of two sisters are
        summed by combination of their codes.  The larger has the rest of their
        mother.
        """
        n, width = len(gradient), BINS + 1
        place = {f: (b, i) for b, (fs, *_) in enumerate(bundles) for i, f in enumerate(fs)}
        used = sorted({place[f][0] for f in use})
        sizes = [len(parts) for _, parts, _ in bundles]
        starts = np.cumsum([0, *[sizes[b] for b in used]])
        # Combinations of all features in the order of their bins, where each bin starts among them, and the bin.
        orders, begins, filled, n_orders = [], [], [], 0
        for i, f in enumerate(use):
            b, c = place[f]
            order, there, first = bundles[b][2][c]
            orders.append(order + starts[used.index(b)])
            begins.append(first + n_orders)
            filled.append(there + i * width)
            n_orders += len(order)
        bins = np.concatenate(orders), np.concatenate(begins), np.concatenate(filled)
        columns = codes.shape[1]
        node = np.zeros(n, dtype=np.min_scalar_type(len(self.value[t])))
        small = np.zeros(1, dtype=np.int64)  # nodes whose rows are summed
        child, leaves = None, []
        slot = np.full(len(self.value[t]), -1)
        for level in range(self.depth + 1):
            last = level == self.depth
            slot[:] = -1
            slot[small] = np.arange(len(small))
            sums = np.zeros((2, len(small), starts[-1]))  # of gradients and rows, by node and combination
            for a in range(0, n, SLICE):
                z = min(n, a + SLICE)
                here = node[a:z]
                flat = codes[a:z].reshape(-1)
                if child is not None:
                    by, start, target = child
                    mine = flat.take(np.arange(0, len(flat), columns) + by.take(here))
                    here = node[a:z] = target.take(start.take(here) + mine)
                if last or not len(small):
                    continue
                if level:
                    s = slot.take(here)
                    rows = np.flatnonzero((s >= 0) & taken[a:z])
                    s = s.take(rows)
                else:
                    rows = np.flatnonzero(taken[a:z])
                    s = np.zeros(len(rows), dtype=np.int64)
                weights = gradient[a:z].take(rows)
                if len(rows) < FEW:  # one call for all bundles
                    index = (codes[a:z][rows][:, used] + starts[:-1] + (s * starts[-1])[:, None]).ravel()
                    sums[0] += np.bincount(index, np.repeat(weights, len(used)), sums[0].size).reshape(len(small), -1)
                    sums[1] += np.bincount(index, minlength=sums[0].size).reshape(len(small), -1)
                    continue
                for b, low, high in zip(used, starts, starts[1:]):
                    index = flat.take(rows * columns + b) + s * sizes[b]
                    sums[0, :, low:high] += np.bincount(index, weights, len(small) * sizes[b]).reshape(len(small), -1)
                    sums[1, :, low:high] += np.bincount(index, minlength=len(small) * sizes[b]).reshape(len(small), -1)
            if last:
                break
            if level == 0:
                nodes, found = small, sums
                total, count = found[:, :, : starts[1]].sum(axis=2)
                self.value[t, 0] = self.rate * total[0] / (count[0] + self.penalty)
            else:
                # Nodes come as sisters, left and right; the larger one is the mother's less the smaller one's.
                each, right = np.arange(len(small)), (count[1::2] < count[::2]).astype(int)
                pair = np.empty((2, len(small), 2, starts[-1]))
                pair[:, each, right] = sums
                pair[:, each, 1 - right] = found - sums
                keep = count >= 2 * self.least
                found = pair.reshape(2, -1, starts[-1])[:, keep]
                leaves.append(nodes[~keep])
                nodes, total, count = nodes[keep], total[keep], count[keep]
            best, choice, left = self._best(found, bins, total, count, len(use))
            split = best > 1e-9
            if not split.any():
                break
            leaves.append(nodes[~split])
            mothers, choice, left = nodes[split], choice[split], left[split]
            self.feature[t, mothers], self.cut[t, mothers], self.left_missing[t, mothers] = use[choice[:, 0]], choice[:, 1], choice[:, 2] == 1
            child = self._ways(t, mothers, np.concatenate(leaves), node.dtype, bundles, place)
            found = found[:, split]
            total, count = (np.stack([of_left, of_all[split] - of_left], axis=1).ravel() for of_left, of_all in ((left[:, 0], total), (left[:, 1], count)))
            nodes = (2 * mothers[:, None] + np.array([1, 2])).ravel()
            self.value[t, nodes] = self.rate * total / (count + self.penalty)
            small = np.where(count[1::2] < count[::2], nodes[1::2], nodes[::2])
        if self.quantile is not None:
            take = np.flatnonzero(taken)
            leaf, rest = node[take], rest[take]
            order = np.lexsort((rest, leaf))
            ids, start, number = np.unique(leaf[order], return_index=True, return_counts=True)
            sorted_rest = rest[order]
            rank = (number - 1) * self.quantile
            low = start + np.floor(rank).astype(int)
            high = start + np.ceil(rank).astype(int)
            self.value[t, ids] = self.rate * (sorted_rest[low] + (sorted_rest[high] - sorted_rest[low]) * (rank - np.floor(rank)))
        return node

    def _best(self, found: np.ndarray, bins: tuple, total: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each node the gain of its best split, its (feature's place, bin, missing ones left), and the left side's sum and count."""
        m = len(total)
        order, begins, filled = bins
        both = np.zeros((2, m, k * (BINS + 1)))
        both[:, :, filled] = np.add.reduceat(found.take(order, axis=2), begins, axis=2)
        both = both.reshape(2, m, k, -1)
        g, h = both
        left_g, left_h = np.cumsum(g[:, :, :BINS], axis=2), np.cumsum(h[:, :, :BINS], axis=2)
        best, choice, left = np.full(m, 1e-9), np.zeros((m, 3), dtype=np.int64), np.zeros((m, 2))
        parent = total * total / (count + self.penalty)
        for missing in (0, 1) if h[:, :, BINS].any() else (0,):
            lg, lh = (left_g + g[:, :, BINS:], left_h + h[:, :, BINS:]) if missing else (left_g, left_h)
            rg, rh = total[:, None, None] - lg, count[:, None, None] - lh
            gain = lg * lg / (lh + self.penalty) + rg * rg / (rh + self.penalty) - parent[:, None, None]
            gain[(lh < self.least) | (rh < self.least)] = -np.inf
            gain = gain.reshape(m, -1)
            # Splits that part the rows alike gain alike but for rounding: the first feature and bin wins, whatever the order of the sums.
            most = np.maximum(gain.max(axis=1), 0.0)
            rounding = 1e-10 * (most + parent)
            top = (gain >= (most - rounding)[:, None]).argmax(axis=1)
            each = np.arange(m)
            value = gain[each, top]
            better = value > best + (rounding if missing else 0)
            best[better] = value[better]
            choice[better] = np.stack([top // BINS, top % BINS, np.full(m, missing)], axis=1)[better]
            left[better] = np.stack([lg.reshape(m, -1)[each, top], lh.reshape(m, -1)[each, top]], axis=1)[better]
        return best, choice, left

    def _ways(self, t: int, mothers: np.ndarray, leaves: np.ndarray, kind: np.dtype, bundles: list, place: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bundle by node, start by node, node to go to at start plus combination)."""
        size = len(self.value[t])
        by, start = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        # A row of a leaf looks into a stretch that leads back to the leaf.
        stretch = len(bundles[0][1])
        start[leaves] = np.arange(len(leaves)) * stretch
        targets, at = [np.repeat(leaves, stretch).astype(kind)], len(leaves) * stretch
        for i in mothers:
            b, c = place[int(self.feature[t, i])]
            code = bundles[b][1][:, c]
            goes_left = code <= self.cut[t, i]
            if self.left_missing[t, i]:
                goes_left |= code == BINS
            by[i], start[i] = b, at
            targets.append((2 * i + 2 - goes_left).astype(kind))
            at += len(targets[-1])
        return by, start, np.concatenate(targets)

    def _leaves(self, t: int, codes: np.ndarray, paths: np.ndarray | None = None) -> np.ndarray:
        node, flat, base = np.zeros(len(codes), dtype=np.int64), codes.reshape(-1), np.arange(0, codes.size, codes.shape[1])
        for _ in range(self.depth):
            f = self.feature[t].take(node)
            go = f >= 0
            if not go.any():
                break
            code = flat.take(base + np.maximum(f, 0))
            left = np.where(code == BINS, self.left_missing[t].take(node), code <= self.cut[t].take(node))
            down = np.where(go, 2 * node + 2 - left, node)
            if paths is not None:
                rows = np.flatnonzero(go)
                paths[rows, f[rows]] += self.value[t, down[rows]] - self.value[t, node[rows]]
            node = down
        return self.value[t].take(node)

    def predict(self, x: np.ndarray, shared: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
        codes = self._codes(np.asarray(x, dtype=float))
        few = None if shared is None else np.stack([self._coded(np.asarray(v, dtype=float), x.shape[1] + j) for j, v in enumerate(shared.T)], axis=1)
        out = np.full(len(codes), self.start)
        for a in range(0, len(codes), SLICE):
            part = codes[a : a + SLICE] if few is None else np.concatenate([codes[a : a + SLICE], few[at[a : a + SLICE]]], axis=1)
            for t in range(self.n):
                out[a : a + SLICE] += self._leaves(t, part)
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """What each feature adds to each prediction: the changes of value along the paths, by the feature that each step splits on."""
        codes = self._codes(np.asarray(x, dtype=float))
        paths = np.zeros(codes.shape)
        for t in range(self.n):
            self._leaves(t, codes, paths)
        return paths
