"""Pairing of rows with the largest total weight: exact per connected component, or best-first.

Weights are positive integers; pairs that aren't listed are worth nothing and are never made, so
components of listed pairs can be solved apart without a loss. A component that lists a good part
of its cells is solved as a matrix, a thin one over its lists.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np

# The limits within which a block is solved exactly.
MAX_EXACT_SIDE, MAX_CELLS, MAX_CELLS_DENSE, BYTES_PER_CELL, BYTES_PER_PAIR = 20_000, 250_000_000, 500_000_000, 8, 72

#: A component with more cells for each pair than this is thin.
THIN = 64

Edges = dict[tuple[int, int], int]


def solvable(n: int, m: int, positive: int | None = None) -> bool:
    """Whether a block of n by m rows with so many pairs worth anything is solved exactly."""
    cells = n * m
    if min(n, m) > MAX_EXACT_SIDE:
        return False
    return cells <= MAX_CELLS or (positive is not None and cells <= MAX_CELLS_DENSE and cells * BYTES_PER_CELL <= positive * BYTES_PER_PAIR)


def parts(edges: Edges) -> list[Edges]:
    """Edges by connected component, in the order of their smallest left node."""
    head: dict[tuple[str, int], tuple[str, int]] = {}

    def top(x):
        while head.setdefault(x, x) != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for p, g in edges:
        a, b = top(("p", p)), top(("g", g))
        if a != b:
            head[a] = b
    groups: dict[tuple[str, int], Edges] = defaultdict(dict)
    for (p, g), w in edges.items():
        groups[top(("p", p))][p, g] = w
    return sorted(groups.values(), key=min)


def dense(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the heaviest matching of a matrix with no more rows than columns. A matrix of doubles is used up.

    Rows enter one by one; each finds the shortest augmenting path under prices that keep all
    reduced costs at zero or above (Jonker and Volgenant 1987).
    """
    n, m = weight.shape
    # In place where it can be: a cell takes 8 bytes.
    cost = np.asarray(weight, dtype=np.float64)
    cost = np.subtract(cost.max(), cost, out=cost)
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        distance, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        at, base, column = row, 0.0, -1
        while True:
            reach = base + cost[at] - row_price[at] - column_price
            better = ~done & (reach < distance)
            distance[better] = reach[better]
            before[better] = column
            column = int(np.where(done, np.inf, distance).argmin())
            base = distance[column]
            done[column] = True
            if owner[column] < 0:
                break
            at = owner[column]
        settled = done.copy()
        settled[column] = False
        row_price[owner[settled]] += base - distance[settled]
        column_price[settled] -= base - distance[settled]
        row_price[row] += base
        while column >= 0:
            previous = before[column]
            owner[column] = row if previous < 0 else owner[previous]
            column = previous
    return [(int(owner[c]), int(c)) for c in range(m) if owner[c] >= 0]


def thin(edges: Edges) -> list[tuple[int, int]]:
    """Pairs of the heaviest matching, over lists of pairs: rows enter one by one, as in dense().

    Each looks for the cheapest way to a free partner, or to a row that rather stays without one, by
    Dijkstra's algorithm under prices that keep all reduced costs at zero or above.
    """
    partners: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (p, g), w in sorted(edges.items()):  # the outcome doesn't depend on the order of pairs
        partners[p].append((g, w))
    top = max(edges.values())
    row_price = {p: min(top - w for _, w in each) for p, each in partners.items()}
    column_price: dict[int, int] = defaultdict(int)
    owner: dict[int, int] = {}
    partner: dict[int, int] = {}
    for start in partners:
        distance, before, done = {start: 0}, {}, {}
        reach: dict[int, int] = {}
        heap = [(0, 0, start)]  # (distance, 0 for a row and 1 for a column, number)
        best, stay, last = None, None, None
        while heap:
            d, kind, x = heapq.heappop(heap)
            if best is not None and d >= best:
                break
            if kind == 0:
                if d > distance[x]:
                    continue
                done[x] = d
                alone = d + top - row_price[x]  # without a partner
                if best is None or alone < best:
                    best, stay, last = alone, x, None
                for g, w in partners[x]:
                    if partner.get(x) == g:
                        continue
                    to = d + top - w - row_price[x] - column_price[g]
                    if to < reach.get(g, to + 1) and to < best:
                        reach[g], before[g] = to, x
                        heapq.heappush(heap, (to, 1, g))
            elif d == reach[x]:
                if x not in owner:
                    best, stay, last = d, None, x
                    break
                row = owner[x]
                if d < distance.get(row, d + 1):
                    distance[row] = d
                    heapq.heappush(heap, (d, 0, row))
        for x, d in done.items():
            if d < best:
                row_price[x] += best - d
        for g, d in reach.items():
            if d < best and g in owner:
                column_price[g] -= best - d
        if last is None:
            last = partner.pop(stay, None)
            if last is not None:
                del owner[last]
                if stay == start:
                    continue
        while last is not None:
            row = before[last]
            previous = partner.get(row)
            owner[last], partner[row] = row, last
            last = previous
    return list(partner.items())


def greedy(edges: Edges) -> list[tuple[int, int]]:
    """Heaviest first, then by position; a pair is made if both rows are free."""
    left, right, out = set(), set(), []
    for (p, g), _ in sorted(edges.items(), key=lambda x: (-x[1], x[0])):
        if p not in left and g not in right:
            left.add(p)
            right.add(g)
            out.append((p, g))
    return out


def assign(edges: Edges, limit=solvable) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs (left, right), and the larger side of every component that was too large to solve exactly."""
    pairs, inexact = [], []
    for part in parts({k: w for k, w in edges.items() if w > 0}):
        if len(part) == 1:
            pairs += part
            continue
        left, right = sorted({p for p, _ in part}), sorted({g for _, g in part})
        if not limit(len(left), len(right), len(part)):
            inexact.append(max(len(left), len(right)))
            pairs += greedy(part)
            continue
        if len(left) * len(right) > THIN * len(part):
            pairs += thin(part)
            continue
        wide = len(left) <= len(right)
        row, column = {p: i for i, p in enumerate(left)}, {g: i for i, g in enumerate(right)}
        weight = np.zeros((len(left), len(right)) if wide else (len(right), len(left)))
        for (p, g), w in part.items():
            weight[(row[p], column[g]) if wide else (column[g], row[p])] = w
        found = ((left[i], right[j]) if wide else (left[j], right[i]) for i, j in dense(weight))
        pairs += [x for x in found if x in part]
    return sorted(pairs), inexact
