"""Capacitated assignment and clustering, one numpy task for each project.

The steps are sequential by nature: points choose centres in order of regret, and each choice uses up room.
Nothing here holds points times centres at once, or looks at all of these pairs: points lie in the leaves of a
tree of boxes (``Leaves``), and a leaf meets only the centres that can be among the nearest of its points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..storage import apart, dealt

#: Distances held at once: few enough for a processor's cache.
BLOCK = 1_000_000
#: Nearest centres that a point looks at before all that have room.
FEW = 12


class ClusterError(ValueError):
    """An assignment that the capacities or inputs rule out."""


def _checked(points, capacity: int) -> np.ndarray:
    p = np.asarray(points, float).reshape(-1, 2) if len(points) else np.empty((0, 2))
    if not np.isfinite(p).all():
        raise ClusterError("coordinates must be finite")
    if isinstance(capacity, bool) or not isinstance(capacity, (int, np.integer)) or capacity <= 0:
        raise ClusterError("capacity must be a positive whole number")
    return p


def scaled(points: np.ndarray, latitude: float) -> np.ndarray:
    """Degrees with longitude scaled by the cosine of a latitude (at least 1e-9)."""
    return points * np.array([max(abs(np.cos(np.radians(latitude))), 1e-9), 1.0])


class Leaves:
    """Points in leaves of some ``SIZE``, cut by medians in turn, with the boxes of all levels of that tree.

    Answers are exact and those of a search through all centres: ties go to the lowest centre.
    """

    SIZE, FAN, STEP, UP = 24, 4, 2, 6

    def __init__(self, p: np.ndarray):
        n, depth = len(p), 0
        while n >> depth > self.SIZE:
            depth += 1
        order, cuts = np.arange(n), np.array([0, n])
        for _ in range(depth):
            # One sort of all nodes at once: by node, then along the longer side of the node's box.
            node = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            q = p[order]
            side = np.maximum.reduceat(q, cuts[:-1], axis=0) - np.minimum.reduceat(q, cuts[:-1], axis=0)
            order = order[np.lexsort((np.where((side[:, 0] >= side[:, 1])[node], q[:, 0], q[:, 1]), node))]
            cuts = np.sort(np.concatenate((cuts, (cuts[:-1] + cuts[1:]) // 2)))
        self.n, self.depth = n, depth
        self.few, self.centres = None, 0  # the last answer of ``nearest_few`` in ``assign``, and for how many centres
        most = int(np.diff(cuts).max())
        slot = np.arange(most)
        self.real = slot < np.diff(cuts)[:, None]
        self.at = order[np.minimum(cuts[:-1, None] + slot, cuts[1:, None] - 1)]  # a short leaf repeats its last point
        self.x, self.y = p[self.at, 0], p[self.at, 1]
        self.boxes = {depth: (self.x.min(axis=1), self.y.min(axis=1), self.x.max(axis=1), self.y.max(axis=1))}
        for d in range(depth - 1, -1, -1):
            lo, hi = self.boxes[d + 1][:2], self.boxes[d + 1][2:]
            self.boxes[d] = (*(np.minimum(x[::2], x[1::2]) for x in lo), *(np.maximum(x[::2], x[1::2]) for x in hi))

    def flat(self, x: np.ndarray) -> np.ndarray:
        """Values of the leaves' points in the order of the points."""
        out = np.empty(self.n, x.dtype)
        out[self.at] = x  # a repeated point has the same value twice
        return out

    def _candidates(self, c: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a leaf and a centre, by leaf and centre: all that may be among the m nearest of some point."""
        d, node, centre = 0, np.zeros(len(c), np.int64), np.arange(len(c))
        cx, cy = np.ascontiguousarray(c[:, 0]), np.ascontiguousarray(c[:, 1])
        while True:
            start = np.nonzero(np.concatenate(([True], node[1:] != node[:-1])))[0]
            size = np.diff(np.concatenate((start, [len(node)])))
            x, y, (x1, y1, x2, y2) = cx[centre], cy[centre], (np.repeat(v[node[start]], size) for v in self.boxes[d])
            west, east, south, north = x1 - x, x - x2, y1 - y, y - y2
            near = np.maximum(np.maximum(west, east), 0.0) ** 2 + np.maximum(np.maximum(south, north), 0.0) ** 2
            far = np.minimum(west, east) ** 2 + np.minimum(south, north) ** 2
            if m == 1:
                most = np.minimum.reduceat(far, start)
            else:
                most = far[np.lexsort((far, node))][start + np.minimum(m, size) - 1]
            keep = near <= np.repeat(most, size)
            node, centre = node[keep], centre[keep]
            if d == self.depth:
                return node, centre
            step = min(self.FAN, self.depth - d)
            d += step
            start = np.nonzero(np.concatenate(([True], node[1:] != node[:-1])))[0]
            size = np.diff(np.concatenate((start, [len(node)])))
            # A node's centres once for each of its children.
            child = np.repeat((node[start][:, None] << step) + np.arange(1 << step), size[:, None].repeat(1 << step, 1).ravel())
            first = np.repeat(np.repeat(start, 1 << step), size.repeat(1 << step))
            begin = np.concatenate(([0], np.cumsum(size.repeat(1 << step))[:-1]))
            centre = centre[first + np.arange(len(child)) - np.repeat(begin, size.repeat(1 << step))]
            node = child

    def _reach(self, c: np.ndarray, bound: np.ndarray, who: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a leaf and a centre, by leaf and centre: centres within a leaf's squared ``bound`` of its box.

        A leaf that isn't ``whole`` meets only the centres of ``who``.
        """
        up = {self.depth: (bound, whole)}
        for d in range(self.depth - 1, -1, -1):
            b, w = up[d + 1]
            up[d] = (np.maximum(b[::2], b[1::2]), w[::2] | w[1::2])
        d, centre = 0, np.arange(len(c))
        node, x, y = np.zeros(len(c), np.int64), c[:, 0], c[:, 1]
        while True:
            (x1, y1, x2, y2), (b, w) = self.boxes[d], up[d]
            wide = np.maximum(np.maximum(x1[node] - x, x - x2[node]), 0.0)
            high = np.maximum(np.maximum(y1[node] - y, y - y2[node]), 0.0)
            keep = np.nonzero((wide * wide + high * high <= b[node]) & (w[node] | who[centre]))[0]
            node, centre = node[keep], centre[keep]
            if d == self.depth:
                order = np.lexsort((centre, node))
                return node[order], centre[order]
            step = min(self.STEP, self.depth - d)
            d += step
            node = ((node << step)[:, None] + np.arange(1 << step)).ravel()
            centre = centre.repeat(1 << step)
            x, y = c[centre, 0], c[centre, 1]

    def nearest(self, c: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each point its nearest centre and the squared distance, as leaves.

        ``most``: for each leaf a squared distance within which all its points have a centre; ``known``: this answer for centres of which some have moved since, and which these are.  A leaf then looks
        again at all centres only if one of its points has lost its own, and else at those that moved to within reach.
        """
        if known is None:
            node, centre = self._candidates(c, 1) if most is None else self._reach(c, most, np.ones(len(c), bool), np.ones(len(most), bool))
            label, best = np.full(self.at.shape, len(c)), np.full(self.at.shape, np.inf)
        else:
            (label, best), moved = (x.copy() for x in known[:2]), known[2]
            lost = moved[label].any(axis=1)
            own, x, y = label[lost], self.x[lost], self.y[lost]
            bound = best.max(axis=1)
            bound[lost] = ((x - c[own, 0]) ** 2 + (y - c[own, 1]) ** 2).max(axis=1)
            node, centre = self._reach(c, bound, moved, lost)
            label[lost], best[lost] = len(c), np.inf
        if not len(node):
            return label, best
        start = np.concatenate((np.nonzero(np.concatenate(([True], node[1:] != node[:-1])))[0], [len(node)]))
        i, n, room = 0, len(start) - 1, max(1, BLOCK // self.at.shape[1])
        while i < n:
            j = max(i + 1, int(np.searchsorted(start, start[i] + room, side="right")) - 1)
            mine, cut, at = slice(start[i], start[j]), start[i:j] - start[i], node[start[i:j]]
            q, here = c[centre[mine]], node[mine]
            d = (self.x[here] - q[:, :1]) ** 2 + (self.y[here] - q[:, 1:]) ** 2
            least = np.minimum(np.minimum.reduceat(d, cut, axis=0), best[at])
            first = np.where(d == least.repeat(np.diff(start[i : j + 1]), axis=0), centre[mine][:, None], len(c))
            label[at] = np.minimum(np.minimum.reduceat(first, cut, axis=0), np.where(best[at] == least, label[at], len(c)))
            best[at] = least
            i = j
        return label, best

    def nearest_few(self, c: np.ndarray, m: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each point its ``m`` nearest centres (all, if there are fewer) and the squared distances, nearest first.

        ``known``: ``m`` different centres for each point that are likely to be near.
        """
        m = min(m, len(c))
        if known is None:
            node, centre = self._candidates(c, m)
        else:
            bound = np.zeros(len(self.at))
            for k in known.T:
                k = k[self.at]
                np.maximum(bound, ((self.x - c[k, 0]) ** 2 + (self.y - c[k, 1]) ** 2).max(axis=1), out=bound)
            node, centre = self._reach(c, bound, np.ones(len(c), bool), np.ones(len(bound), bool))
        start = np.concatenate((np.nonzero(np.concatenate(([True], node[1:] != node[:-1])))[0], [len(node)]))
        label, best = np.empty((self.n, m), np.int64), np.empty((self.n, m))
        i, size, room = 0, np.diff(start), max(1, BLOCK // 4 // self.at.shape[1])
        by = np.argsort(size, kind="stable")  # leaves with as many candidates go together
        while i < len(by):
            widest = size[by[min(i + room // size[by[i]], len(by) - 1)]]
            some = by[i : i + max(1, room // widest)]
            i, widest = i + len(some), size[some[-1]]
            slot = np.minimum(np.arange(widest), size[some, None] - 1)
            k = centre[start[some, None] + slot]
            d = (self.x[some, :, None] - c[k, 0][:, None, :]) ** 2 + (self.y[some, :, None] - c[k, 1][:, None, :]) ** 2
            d = np.where((np.arange(widest) < size[some, None])[:, None, :], d, np.inf)
            few = np.argsort(d, axis=2)[:, :, : m + 1]
            near = np.take_along_axis(d, few, axis=2)
            tied = (near[:, :, 1:] == near[:, :, :-1]).any(axis=2)
            few = few[:, :, :m]
            if tied.any():  # equal distances by centre
                few[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :m]
            label[self.at[some]] = np.take_along_axis(np.broadcast_to(k[:, None, :], d.shape), few, axis=2)
            best[self.at[some]] = np.take_along_axis(d, few, axis=2)
        return label, best


def _regret_order(near: np.ndarray, pending: np.ndarray) -> np.ndarray:
    """Pending points by falling regret (second nearest less nearest), then nearest, then index; by index with one centre."""
    if near.shape[1] < 2:
        return np.sort(pending)
    one, two = near[pending, 0], near[pending, 1]
    return pending[np.lexsort((pending, one, -(two - one)))]


def assign(points, centres, capacity: int, seeds=None, leaves: Leaves | None = None) -> np.ndarray:
    """Centre of each point under ``capacity``; ``seeds`` are labels whose clusters each keep their nearest member.

    ``leaves``: the tree of these points, scaled, if there is one already.
    """
    raw, ctr = _checked(points, capacity), _checked(centres, capacity)
    n, k = len(raw), len(ctr)
    if n == 0:
        return np.empty(0, int)
    if k == 0:
        raise ClusterError("there are no centres")
    if k * capacity < n:
        raise ClusterError(f"{k} centres of capacity {capacity} can't hold {n} points")
    lat = float(np.mean(raw[:, 1]))
    p, c = scaled(raw, lat), scaled(ctr, lat)
    labels, room = np.full(n, -1), np.full(k, capacity)
    if seeds is not None:
        seeds = np.asarray(seeds)
        if len(seeds) != n:
            raise ClusterError("seeds must name a cluster for each point")
        own = ((p - c[np.clip(seeds, 0, k - 1)]) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(n), own, seeds))
        first = order[np.concatenate(([True], seeds[order][1:] != seeds[order][:-1]))]
        if len(set(seeds[first].tolist()) & set(range(k))) < k:
            raise ClusterError("a cluster has no member to keep")
        labels[first] = seeds[first]
        room[seeds[first]] -= 1
    leaves = leaves or Leaves(p)
    few, near = leaves.nearest_few(c, FEW, leaves.few if leaves.few is not None and leaves.few.shape[1] == min(FEW, k) and leaves.centres == k else None)
    leaves.few, leaves.centres = few, k
    order, left, out = _regret_order(near, np.nonzero(labels < 0)[0]), room.tolist(), labels.tolist()
    open_, full, shut = np.arange(k), 0, len(c) // 8 + 8
    for i, js in zip(order.tolist(), few[order].tolist(), strict=True):
        for j in js:
            if left[j]:
                break
        else:  # its few nearest are full: among all that had room at the last look
            while True:
                d = (c[open_, 0] - p[i, 0]) ** 2 + (c[open_, 1] - p[i, 1]) ** 2
                at = int(np.argmin(d))
                if full < shut and left[int(open_[at])]:
                    j = int(open_[at])
                    break
                open_, full = np.array([x for x in open_.tolist() if left[x]]), 0
        left[j] -= 1
        full += not left[j]
        out[i] = j
    return np.array(out)


def _seeds(leaves: Leaves, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres by k-means++, and for each leaf the largest squared distance of a point to its nearest.

    Each next centre is a point drawn by its squared distance to the nearest chosen.
    """
    x1, y1, x2, y2 = leaves.boxes[leaves.depth]
    leaf, slot = (int(x[0]) for x in np.nonzero(leaves.real & (leaves.at == int(rng.integers(leaves.n)))))
    chosen, d = [(leaf, slot)], np.where(leaves.real, np.inf, 0.0)
    most, mass = np.full(len(d), np.inf), np.zeros(len(d))
    px, py, zero = leaves.x, leaves.y, np.zeros(len(d))
    for _ in range(k):
        x, y = px[leaf, slot], py[leaf, slot]
        wide, high = np.maximum(x1 - x, x - x2), np.maximum(y1 - y, y - y2)
        np.maximum(wide, zero, out=wide)
        np.maximum(high, zero, out=high)
        wide *= wide
        high *= high
        wide += high
        hit = (wide < most).nonzero()[0]
        if len(hit):
            dx, dy = px[hit] - x, py[hit] - y
            d[hit] = less = np.minimum(d[hit], dx * dx + dy * dy)
            most[hit], mass[hit] = less.max(axis=1), less.sum(axis=1)
        upto = mass.cumsum()
        if upto[-1] > 0:
            spot = rng.random() * upto[-1]
            leaf = int(upto.searchsorted(spot, side="right"))
            leaf = leaf if leaf < len(d) and mass[leaf] > 0 else int(np.argmax(mass))
            inside = d[leaf].cumsum()
            slot = int(inside.searchsorted(spot - (upto[leaf] - mass[leaf]), side="right"))
            slot = slot if slot < len(inside) and d[leaf, slot] > 0 else int(np.argmax(d[leaf]))
        else:  # fewer places than clusters: the first points not chosen yet
            free = leaves.real.copy()
            free[tuple(np.array(chosen).T)] = False
            leaf, slot = divmod(int(np.argmax(free)), free.shape[1])
        chosen.append((leaf, slot))
    at = tuple(np.array(chosen[:k]).T)
    return np.stack([px[at], py[at]], axis=1), most


def _seed_sets(leaves: Leaves, k: int, rng: np.random.Generator, starts: int):
    """What ``_seeds`` gives in so many calls (but for the rounding of sums), from a loop over all starts at once."""
    some = max(1, 8 * BLOCK // leaves.n)  # one distance a point and start
    for i in range(0, starts, some):
        many, state = min(some, starts - i), rng.bit_generator.state
        sets = _seeds_at_once(leaves, k, rng, many)
        if sets is None:  # fewer places than clusters: other draws
            rng.bit_generator.state = state
            sets = [_seeds(leaves, k, rng) for _ in range(many)]
        yield from sets


def _seeds_at_once(leaves: Leaves, k: int, rng: np.random.Generator, starts: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """The steps of ``_seeds`` for ``starts`` of them side by side; None if all places are chosen before the end.

    A step looks at the nodes some levels up, then at the leaves of those that a new centre reaches.
    """
    draws = [(int(rng.integers(leaves.n)), rng.random(k)) for _ in range(starts)]
    top = max(0, leaves.depth - leaves.UP)
    n, fan, width = 1 << top, 1 << (leaves.depth - top), leaves.at.shape[1]
    upper, lower = leaves.boxes[top], [v.reshape(n, fan) for v in leaves.boxes[leaves.depth]]
    px, py, row = leaves.x, leaves.y, np.arange(starts)
    leaf, slot = np.array([[int(x[0]) for x in np.nonzero(leaves.real & (leaves.at == first))] for first, _ in draws]).T
    share = np.stack([x for _, x in draws], axis=1)
    d = np.repeat(np.where(leaves.real, np.inf, 0.0).reshape(1, n, fan, width), starts, axis=0)
    most, mass = np.full((starts, n, fan), np.inf), np.zeros((starts, n, fan))
    node_most, node_mass = most[:, :, 0].copy(), mass[:, :, 0].copy()
    chosen = np.empty((k, 2, starts), np.int64)

    def gap(box, x, y):
        wide, high = np.maximum(np.maximum(box[0] - x, x - box[2]), 0.0), np.maximum(np.maximum(box[1] - y, y - box[3]), 0.0)
        wide *= wide
        high *= high
        wide += high
        return wide

    def drawn(weight, spot):
        """For each row the place where its sums pass ``spot``, and how far into that place."""
        upto = weight.cumsum(axis=1)
        at = np.count_nonzero(upto <= spot[:, None], axis=1)
        for j in np.nonzero((at == weight.shape[1]) | (weight[row, np.minimum(at, weight.shape[1] - 1)] <= 0))[0].tolist():
            at[j] = int(np.argmax(weight[j]))
        return at, spot - (upto[row, at] - weight[row, at])

    for i in range(k):
        chosen[i] = leaf, slot
        x, y = px[leaf, slot], py[leaf, slot]
        s, node = np.nonzero(gap(upper, x[:, None], y[:, None]) < node_most)
        near = gap([v[node] for v in lower], x[s, None], y[s, None]) < most[s, node]
        hit, j = np.nonzero(near)
        s_, node_ = s[hit], node[hit]
        at = node_ * fan + j
        dx, dy = px[at] - x[s_, None], py[at] - y[s_, None]
        less = np.minimum(d[s_, node_, j], dx * dx + dy * dy)
        d[s_, node_, j], most[s_, node_, j], mass[s_, node_, j] = less, less.max(axis=1), less.sum(axis=1)
        node_most[s, node], node_mass[s, node] = most[s, node].max(axis=1), mass[s, node].sum(axis=1)
        total = node_mass.sum(axis=1)
        if not (total > 0).all():
            return None
        node, rest = drawn(node_mass, share[i] * total)
        j, rest = drawn(mass[row, node], rest)
        leaf = node * fan + j
        slot, _ = drawn(d[row, node, j], rest)
    most = most.reshape(starts, -1)
    return [(np.stack([px[tuple(chosen[:, :, j].T)], py[tuple(chosen[:, :, j].T)]], axis=1), most[j]) for j in range(starts)]


def _seeded(leaves: Leaves, k: int, rng: np.random.Generator) -> np.ndarray:
    return _seeds(leaves, k, rng)[0]


def _lloyd(p: np.ndarray, k: int, rng: np.random.Generator, leaves: Leaves | None = None, seeds: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Labels and cost of one run from careful seeds (k-means++); ``seeds``: what ``_seeds`` gave, if it was asked."""
    leaves = leaves or Leaves(p)
    (c, most), labels, known = seeds or _seeds(leaves, k, rng), np.full(len(p), -1), None
    for _ in range(rounds):
        answer = leaves.nearest(c, known, most)
        fresh, near = (leaves.flat(x) for x in answer)
        count = np.bincount(fresh, minlength=k)
        for j in np.nonzero(count == 0)[0].tolist():  # an empty cluster takes the farthest point
            far = int(np.argmax(np.where(count[fresh] > 1, near, -1)))
            count[fresh[far]] -= 1
            fresh[far], near[far], count[j] = j, 0.0, 1
        if (fresh == labels).all():
            break
        labels, before = fresh, c
        c = np.stack([np.bincount(labels, weights=p[:, a], minlength=k) / np.bincount(labels, minlength=k) for a in (0, 1)], axis=1)
        known = (*answer, (c != before).any(axis=1))
    return labels, float(((p - c[labels]) ** 2).sum())


def cluster(points, k: int, capacity: int, seed: int = 42, max_iter: int = 20, starts: int = 20) -> np.ndarray:
    """Labels of ``k`` clusters within ``capacity``: k-means gives seeds, then assignment and means alternate."""
    raw = _checked(points, capacity)
    n = len(raw)
    if isinstance(k, bool) or not isinstance(k, (int, np.integer)):
        raise ClusterError("the number of clusters must be a whole number")
    if k < 0 or (n == 0) != (k == 0):
        raise ClusterError("clusters need points, and points need a cluster")
    if n == 0:
        return np.empty(0, int)
    if k > n:
        raise ClusterError(f"{k} clusters of {n} points")
    if k * capacity < n:
        raise ClusterError(f"{k} clusters of capacity {capacity} can't hold {n} points")
    if k == 1:
        return np.zeros(n, int)
    rng = np.random.default_rng(seed)
    p = scaled(raw, float(raw[:, 1].mean()))
    leaves = Leaves(p)
    labels = min((_lloyd(p, k, rng, leaves, x) for x in _seed_sets(leaves, k, rng, starts)), key=lambda x: x[1])[0]
    means = lambda lab: np.stack([np.bincount(lab, weights=raw[:, a], minlength=k) / np.bincount(lab, minlength=k) for a in (0, 1)], axis=1)
    centres = means(labels)
    for _ in range(max_iter):
        fresh = assign(raw, centres, capacity, seeds=labels, leaves=leaves)
        centres = means(fresh)
        if (fresh == labels).all():
            break
        labels = fresh
    return labels


def group_by_capacity(points, capacity: int) -> np.ndarray:
    """Labels of the fewest clusters within ``capacity``."""
    _checked(points, capacity)
    return cluster(points, -(-len(points) // capacity), capacity)


# ---- on DataFrames ----

def assigned(points: DataFrame, centres: DataFrame, capacity: int) -> DataFrame:
    """Points (project_id, hp_id, lon, lat) with the index of their centre (project_id, centre_id, lon, lat)."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("hp_id"), right.sort_values("centre_id")
        labels = assign(left[["lon", "lat"]].to_numpy(), right[["lon", "lat"]].to_numpy(), capacity)
        ids = right["centre_id"].to_numpy()
        return pd.DataFrame({"project_id": left["project_id"], "hp_id": left["hp_id"], "centre_id": ids[labels] if len(labels) else []})

    return points.groupBy("project_id").cogroup(centres.groupBy("project_id")).applyInPandas(run, "project_id long, hp_id long, centre_id long")


def hierarchy(hps: DataFrame, config: dict, centres: DataFrame | None = None) -> DataFrame:
    """One row per HP: project_id, hp_id, lon, lat, cto, pon, ceo (numbers from 1), with the boxes' raw places.

    With manual ``centres`` the boxes are these, some perhaps empty (those have a row with a null hp_id);
    otherwise the fewest boxes that hold all HPs.  PONs and CEOs are the fewest that hold their members.
    """
    e = config["engenharia"]
    cap, per_pon, per_ceo = int(e["capacidade_hp_por_cto"]), int(e["ctos_por_pon"]), int(e["pons_por_ceo"])
    reserve = float(e.get("reserva_capacidade_percentual", 0.0))

    def mean(p, labels, k):
        return np.stack([np.bincount(labels, weights=p[:, a], minlength=k) / np.maximum(np.bincount(labels, minlength=k), 1) for a in (0, 1)], axis=1)

    def build(hp: pd.DataFrame, manual: pd.DataFrame | None) -> pd.DataFrame:
        hp = hp.sort_values("hp_id").reset_index(drop=True)
        p = hp[["lon", "lat"]].to_numpy(float)
        if not len(p):
            return pd.DataFrame(columns=COLUMNS)
        if manual is not None and len(manual):
            box = manual.sort_values("centre_id")[["lon", "lat"]].to_numpy(float)
            cto = assign(p, box, cap)
        else:
            k = min(len(p), -(-int(np.ceil(len(p) * (1 + reserve))) // cap))
            cto = cluster(p, k, cap)
            box = mean(p, cto, k)
        pon = group_by_capacity(box, per_pon)
        pon_at = mean(box, pon, int(pon.max()) + 1)
        ceo = group_by_capacity(pon_at, per_ceo)
        ceo_at = mean(pon_at, ceo, int(ceo.max()) + 1)
        out = hp[["project_id", "hp_id", "lon", "lat"]].copy()
        out["cto"] = cto + 1
        gone = np.setdiff1d(np.arange(len(box)), cto) + 1
        if len(gone):
            out = pd.concat([out, pd.DataFrame({"project_id": hp["project_id"].iloc[0], "cto": gone})], ignore_index=True)
        c = out["cto"].to_numpy(int) - 1
        out["hp_id"] = out["hp_id"].astype("Int64")
        out["cto_lon"], out["cto_lat"], out["pon"] = box[c, 0], box[c, 1], pon[c] + 1
        out["pon_lon"], out["pon_lat"] = pon_at[pon[c], 0], pon_at[pon[c], 1]
        out["ceo"] = ceo[pon[c]] + 1
        out["ceo_lon"], out["ceo_lat"] = ceo_at[ceo[pon[c]], 0], ceo_at[ceo[pon[c]], 1]
        return out[COLUMNS]

    if centres is None:
        return apart(hps.select("project_id", "hp_id", "lon", "lat"), "project_id").groupBy("project_id").applyInPandas(lambda hp: build(hp, None), HIERARCHY)
    left, right = (dealt(x, "project_id").groupBy("project_id") for x in (hps.select("project_id", "hp_id", "lon", "lat"), centres.select("project_id", "centre_id", "lon", "lat")))
    return left.cogroup(right).applyInPandas(lambda hp, m: build(hp, m), HIERARCHY)


COLUMNS = ["project_id", "hp_id", "lon", "lat", "cto", "cto_lon", "cto_lat", "pon", "pon_lon", "pon_lat", "ceo", "ceo_lon", "ceo_lat"]
HIERARCHY = "project_id long, hp_id long, lon double, lat double, cto int, cto_lon double, cto_lat double, pon int, pon_lon double, pon_lat double, ceo int, ceo_lon double, ceo_lat double"
