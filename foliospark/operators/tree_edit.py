"""Edit distance between two schemas as unordered trees, with the mapping that attains it.

The distance is the constrained one: disjoint subtrees map to disjoint subtrees.
It is polynomial where the unconstrained distance of unordered trees is not,
and covers what schemas do: fields and objects are added, deleted, renamed,
wrapped in a new object or taken out of one. Children are matched by minimum-cost
assignment. What moves from one subtree to another breaks the constraint; `moves`
matches such leaves in a second pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np

Cost = Callable[["Node", "Node"], float]


class Node:
    """A field (a leaf) or an object of a schema; path is dotted from the root."""

    __slots__ = ("path", "leaf", "kids")

    def __init__(self, path: str, leaf: bool):
        self.path, self.leaf, self.kids = path, leaf, []


def tree(paths: Iterable[str]) -> Node:
    """The tree of dotted paths of leaves; a path that is both a value and an object is two nodes."""
    root, objects = Node("", False), {}

    def at(path: str) -> Node:
        if not path:
            return root
        if path not in objects:
            objects[path] = Node(path, False)
            at(path.rpartition(".")[0]).kids.append(objects[path])
        return objects[path]

    for p in sorted(paths):
        at(p.rpartition(".")[0]).kids.append(Node(p, True))
    return root


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns (shortest augmenting paths); pairs (row, column)."""
    n, m = cost.shape
    if n > m:
        return sorted((r, c) for c, r in assign(cost.T))
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], col = i, 0
        least, back, used = np.full(m + 1, math.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[col]:
            used[col] = True
            row = match[col]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], col
            nxt = int(np.argmin(np.where(used[1:], math.inf, least[1:]))) + 1
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            col = nxt
        while col:
            match[col] = match[back[col]]
            col = back[col]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


class Distance:
    """The constrained edit distance of two trees; `change` is the cost of mapping one node to another, `drop` of deleting or adding one."""

    def __init__(self, change: Cost, drop: Callable[[Node], float]):
        self.change, self.drop = change, drop
        self.whole: dict[int, float] = {}
        self.known: dict[tuple[int, int, bool], tuple[float, list]] = {}

    def alone(self, n: Node) -> float:
        """Cost of deleting or adding a whole tree."""
        if id(n) not in self.whole:
            self.whole[id(n)] = self.drop(n) + self.kids_alone(n)
        return self.whole[id(n)]

    def kids_alone(self, n: Node) -> float:
        return sum(self.alone(k) for k in n.kids)

    def trees(self, a: Node, b: Node) -> tuple[float, list[tuple[Node, Node]]]:
        """Distance of two trees and the pairs of nodes mapped to each other."""
        key = id(a), id(b), True
        if key not in self.known:
            cost, pairs = self.forests(a, b)
            # mapped to each other, or both left out where that is cheaper
            same, apart = self.change(a, b), self.drop(a) + self.drop(b)
            best = (cost + same, [(a, b), *pairs]) if same <= apart else (cost + apart, pairs)
            self.known[key] = self._through(a, b, self.trees, self.alone, best)
        return self.known[key]

    def forests(self, a: Node, b: Node) -> tuple[float, list[tuple[Node, Node]]]:
        """The same of the children of two nodes."""
        key = id(a), id(b), False
        if key not in self.known:
            best = (self.kids_alone(a) + self.kids_alone(b), [])
            if a.kids and b.kids:
                # rows and columns beyond the children stand for deleting and adding
                n, m = len(a.kids), len(b.kids)
                both = [[self.trees(x, y) for y in b.kids] for x in a.kids]
                gone, come = [self.alone(x) for x in a.kids], [self.alone(y) for y in b.kids]
                cost = np.zeros((n + m, n + m))
                cost[:n, :m] = [[c for c, _ in row] for row in both]
                cost[:n, m:], cost[n:, :m] = np.array(gone)[:, None], np.array(come)[None, :]
                chosen = assign(cost)
                pairs = [p for i, j in chosen if i < n and j < m for p in both[i][j][1]]
                best = min(best, (float(sum(cost[i, j] for i, j in chosen)), pairs), key=lambda x: x[0])
            self.known[key] = self._through(a, b, self.forests, self.kids_alone, best)
        return self.known[key]

    def _through(self, a: Node, b: Node, solve: Callable, alone: Callable[[Node], float], best: tuple) -> tuple:
        """Also map all of one side into one child of the other, whose remainder is deleted or added."""
        for kid in b.kids:
            cost, pairs = solve(a, kid)
            cost += alone(b) - alone(kid)
            best = min(best, (cost, pairs), key=lambda x: x[0])
        for kid in a.kids:
            cost, pairs = solve(kid, b)
            cost += alone(a) - alone(kid)
            best = min(best, (cost, pairs), key=lambda x: x[0])
        return best


def moves(gone: list[str], come: list[str], cost: Callable[[str, str], float], limit: float) -> list[tuple[str, str]]:
    """Pairs of deleted and added leaves that are cheaper as a move than apart, at least cost in all."""
    if not gone or not come:
        return []
    table = np.array([[min(limit, cost(o, n)) for n in come] for o in gone])
    return [(gone[i], come[j]) for i, j in assign(table) if table[i, j] < limit]
