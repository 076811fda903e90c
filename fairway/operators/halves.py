"""Figures over all simple paths of requests without listing them: their number, extreme values, best scores, skyline.

A path of more than half of the allowed edges is put together from a first half of fixed length and a second half that meet
in a middle node and share no other node. The halves of each middle are few enough to be held; the pairs are not, so
they are counted by inclusion and exclusion over shared nodes, and searched by bounds. Nothing is left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # edges looked at at once when paths grow
PAIRS = 1 << 18  # pairs of halves compared at once
NONE = -1  # fills rows of inner nodes; no node


class Graph:
    """Directed edges with values, held both ways. Nodes are numbered from 0 in the order of their ids."""

    def __init__(self, u: np.ndarray, v: np.ndarray, values: np.ndarray):
        self.ids = np.unique(np.concatenate([u, v]))
        a, b = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v)
        self.n, self.values = len(self.ids), values
        self.out, self.back = self._side(a, b), self._side(b, a)

    def _side(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each node the place of its first edge, then the other ends and the edges' numbers."""
        order = np.lexsort((b, a))
        return np.searchsorted(a[order], np.arange(self.n + 1)), b[order].astype(np.int32), order

    def at(self, node: int) -> int | None:
        i = int(np.searchsorted(self.ids, node))
        return i if i < self.n and self.ids[i] == node else None

    def hops(self, side: tuple, end: int) -> np.ndarray:
        """Fewest edges from ``end`` along the side to each node."""
        first, other, _ = side
        near = np.full(self.n, 1 << 20)
        near[end], front, step = 0, np.array([end]), 0
        while len(front):
            step += 1
            to = np.unique(np.concatenate([other[first[x] : first[x + 1]] for x in front]))
            front = to[near[to] > step]
            near[front] = step
        return near

    def sums(self, path: np.ndarray) -> np.ndarray:
        """Values of a path, added up from its start."""
        first, other, number = self.out
        total = np.zeros(self.values.shape[1])
        for a, b in itertools.pairwise(path):
            total = total + self.values[number[first[a] + np.searchsorted(other[first[a] : first[a + 1]], b)]]
        return total


def spread(first: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and edge of every edge that leaves the rows' nodes, in blocks of about BLOCK edges."""
    count = first[at + 1] - first[at]
    done = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + BLOCK, side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        yield i, np.arange(done[lo], done[hi]) - done[i] + first[at[i]]
        lo = hi


def grown(graph: Graph, side: tuple, start: int, end: int, least: int, most: int, near: np.ndarray, shut: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of edges: (inner nodes, values) of all simple paths from start to end along the side that avoid ``shut``."""
    first, other, number = side
    rows, sums = np.empty((1, 0), np.int32), np.zeros((1, graph.values.shape[1]))
    at, found = np.array([start]), {}
    for hops in range(1, most + 1):
        ready, more = [], []
        for i, e in spread(first, at):
            to = other[e]
            if hops >= least:
                k = to == end
                ready.append((rows[i[k]], sums[i[k]] + graph.values[number[e[k]]]))
            k = (near[to] <= most - hops) & (to != end) & (to != shut) & (to != start)
            i, e, to = i[k], e[k], to[k]
            k = (rows[i] != to[:, None]).all(axis=1)
            i, e, to = i[k], e[k], to[k]
            more.append((np.column_stack([rows[i], to]), sums[i] + graph.values[number[e]]))
        if ready:
            found[hops] = tuple(np.concatenate(x) for x in zip(*ready, strict=True))
        if not more or hops == most:
            break
        rows, sums = (np.concatenate(x) for x in zip(*more, strict=True))
        at = rows[:, -1]
    return found


def disjoint(first: np.ndarray, second: list[np.ndarray], n: int) -> int:
    """Number of pairs of a row of ``first`` and one of ``second`` without a common node: for each set of nodes the pairs that both hold it, in turn taken off and added."""
    first, second = np.sort(first, axis=1).astype(np.int64), [np.sort(x, axis=1).astype(np.int64) for x in second]

    def sets(t: np.ndarray, size: int) -> list[np.ndarray]:
        return [t[:, list(c)] @ (n ** np.arange(size)) for c in itertools.combinations(range(t.shape[1]), size)]

    total = len(first) * sum(len(x) for x in second)
    for size in range(1, first.shape[1] + 1):
        there = [k for t in second for k in sets(t, size)]
        if not len(first) or not sum(map(len, there)):
            break
        a, na = np.unique(np.concatenate(sets(first, size)), return_counts=True)
        b, nb = np.unique(np.concatenate(there), return_counts=True)
        p = np.minimum(np.searchsorted(b, a), len(b) - 1)
        total += (-1) ** size * int(np.where(b[p] == a, na * nb[p], 0).sum())
    return total


class Most:
    """The greatest value of a request and what reaches it; with ``slack`` everything that comes so near."""

    def __init__(self, slack: float = 0.0):
        self.slack, self.value, self.found = slack, -np.inf, []

    def may(self, x):
        """Whether values are still of interest."""
        return x >= self.value - self.slack if self.slack else x > self.value

    def add(self, values: np.ndarray, path) -> None:
        """Take the values that count; ``path(i)`` is only made for those."""
        if not len(values):
            return
        self.value = max(self.value, float(values.max()))
        if self.slack:
            self.found = [x for x in self.found if x[0] >= self.value - self.slack] + [(float(values[i]), path(i)) for i in np.flatnonzero(values >= self.value - self.slack)]
        else:
            i = int(values.argmax())
            self.found = [(float(values[i]), path(i))]

    def pairs(self, f: np.ndarray, fv: np.ndarray, g: np.ndarray, gv: np.ndarray, path) -> None:
        """Look through the pairs of halves without a common node, by branching on a node that the best two share."""
        if not len(fv) or not len(gv):
            return
        a, b = np.flatnonzero(self.may(fv + gv.max())), np.flatnonzero(self.may(gv + fv.max()))
        todo = [(a[np.argsort(-fv[a])], b[np.argsort(-gv[b])])]
        while todo:
            a, b = todo.pop()
            if not len(a) or not len(b):
                continue
            a, b = a[self.may(fv[a] + gv[b[0]])], b[self.may(gv[b] + fv[a[0]])]
            if not len(a) or not len(b):
                continue
            both = np.intersect1d(f[a[0]], g[b[0]])
            if len(a) * len(b) <= PAIRS:
                self._compare(a, b, f, fv, g, gv, path)
            elif len(both):
                x = both[0]
                ina, inb = (f[a] == x).any(axis=1), (g[b] == x).any(axis=1)
                todo += [(a[ina], b[~inb]), (a[~ina], b)]
            elif fv[a[0]] + gv[b[0]] > self.value:
                if self.slack:  # only what is near it remains to be compared
                    self.value = float(fv[a[0]] + gv[b[0]])
                    todo.append((a, b))
                else:
                    self._compare(a[:1], b[:1], f, fv, g, gv, path)
            else:
                step = max(1, PAIRS // len(b))
                for lo in range(0, len(a), step):
                    self._compare(a[lo : lo + step], b, f, fv, g, gv, path)

    def _compare(self, a, b, f, fv, g, gv, path) -> None:
        i, j = np.nonzero(self.may(fv[a][:, None] + gv[b][None, :]))
        i, j = a[i], b[j]
        apart = np.ones(len(i), bool)
        for x, y in itertools.product(range(f.shape[1]), range(g.shape[1])):
            apart &= f[i, x] != g[j, y]
        i, j = i[apart], j[apart]
        self.add(fv[i] + gv[j], lambda k: path(i[k], j[k]))


class Halves:
    """All simple paths of up to ``cutoff`` edges from start to goal, by their middle node."""

    def __init__(self, graph: Graph, start: int, goal: int, cutoff: int):
        self.graph, self.start, self.goal, self.cutoff = graph, start, goal, cutoff
        self.half = cutoff - cutoff // 2
        self.from_start, self.to_goal = graph.hops(graph.out, start), graph.hops(graph.back, goal)

    def middles(self) -> list[int]:
        """Nodes that can be in the middle; NONE stands for the paths of no more than ``half`` edges."""
        far = np.flatnonzero((self.from_start <= self.half) & (self.to_goal <= self.cutoff - self.half))
        return [NONE, *(int(x) for x in far if x not in (self.start, self.goal))]

    def parts(self, middle: int):
        """(first halves, their values, second halves by number of edges, whole path of two halves). Whole paths come as second halves."""
        g, s, t = self.graph, self.start, self.goal
        if middle == NONE:
            whole = grown(g, g.out, s, t, 1, self.half, self.to_goal, NONE)
            return np.empty((1, 0), np.int32), np.zeros((1, g.values.shape[1])), whole, 0, lambda f, x: np.concatenate([[s], x, [t]])
        first = grown(g, g.back, middle, s, self.half, self.half, self.from_start, t).get(self.half)
        second = grown(g, g.out, middle, t, 1, self.cutoff - self.half, self.to_goal, s) if first is not None and len(first[0]) else {}
        if not second:
            return None
        return *first, second, self.half, lambda f, x: np.concatenate([[s], f[::-1], [middle], x, [t]])


def count(parts, n: int) -> int:
    first, _, second, _, _ = parts
    return disjoint(first, [x for x, _ in second.values()], n)


def look(parts, most: Most, value, kinds=lambda sums: np.zeros(len(sums), int)) -> None:
    """Search the pairs for the greatest ``value(sums, edges, kinds)``, which has to be linear in the sums for each number of edges and pair of kinds."""
    first, fsums, second, before, path = parts
    fk = kinds(fsums)
    for edges, (inner, sums) in second.items():
        gk = kinds(sums)
        for p, q in itertools.product(np.unique(fk), np.unique(gk)):
            a, b = np.flatnonzero(fk == p), np.flatnonzero(gk == q)
            base = value(np.zeros((1, fsums.shape[1])), edges + before, (p, q))
            most.pairs(first[a], value(fsums[a], edges + before, (p, q)), inner[b], value(sums[b], edges + before, (p, q)) - base, lambda i, j, a=a, b=b, inner=inner: path(first[a[i]], inner[b[j]]))


def skyline(graph: Graph, start: int, goal: int, cutoff: int, costs: list[int], margin: float) -> list[np.ndarray]:
    """Paths whose two costs (never negative) no other path reaches with one of them less by more than ``margin``; a few beaten ones may be among them.

    A beginning is given up if another one to the same node with no more edges beats it: what follows it can follow the other, and a
    node met twice only adds to the costs.
    """
    near = graph.hops(graph.back, goal)
    first, other, number = graph.out
    w = graph.values[:, costs]
    paths, sums = np.array([[start]]), np.zeros((1, len(costs)))
    known: dict[int, np.ndarray] = {}
    ready: list[np.ndarray] = []
    for hops in range(1, cutoff + 1):
        more = []
        for i, e in spread(first, paths[:, -1]):
            to = other[e]
            k = (near[to] <= cutoff - hops) & (paths[i] != to[:, None]).all(axis=1)
            more.append((np.column_stack([paths[i[k]], to[k]]), sums[i[k]] + w[number[e[k]]]))
        if not more:
            break
        paths, sums = (np.concatenate(x) for x in zip(*more, strict=True))
        kept = []
        order = np.argsort(paths[:, -1], kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(paths[order, -1])) + 1) if len(order) else []:
            node = int(paths[rows[0], -1])
            old = known.get(node, np.empty((0, len(costs))))
            both = np.concatenate([old, sums[rows]])
            good = _unbeaten(both, margin)
            known[node] = both[good]
            kept.append(rows[good[len(old) :]])
        k = np.concatenate(kept) if kept else np.empty(0, int)
        at_goal = paths[k, -1] == goal
        ready += list(paths[k[at_goal]])
        k = k[~at_goal]
        paths, sums = paths[k], sums[k]
        if not len(k):
            break
    return ready


def _unbeaten(c: np.ndarray, margin: float) -> np.ndarray:
    """Rows that no other reaches in both columns with one of them less by more than the margin."""
    order = np.lexsort((c[:, 1], c[:, 0]))
    x, y = c[order, 0], c[order, 1]
    least = np.concatenate([[np.inf], np.minimum.accumulate(y)])
    same = least[np.searchsorted(x, x, side="right")]  # least second cost where the first is no greater
    less = least[np.searchsorted(x, x - margin, side="left")]  # and where it is less by more than the margin
    good = np.empty(len(c), bool)
    good[order] = ~((same < y - margin) | (less <= y))
    return good
