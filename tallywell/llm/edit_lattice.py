"""Cheapest repair of a conversation's turn order: bidirectional Dijkstra over the edit lattice.

A conversation is a text of symbols, one per row: ``s u a x`` for a sound row whose role
begins with s, u, a or anything else, ``S U A X`` for the same with a truncated text, and ``D``
for a row that has to go. A node of the lattice is (rows consumed, what the last kept role
was); an edge is one edit. Two heaps grow from both ends. When the sum of their least costs
exceeds the best total, every cheapest path runs over an edge between the two settled
sets; the least audit of all such crossings is the result.

Two audits of equal cost that end in one node consume the same rows, so neither is a
proper prefix of the other (an audit's letters fix its cost). The least audit therefore
consists of least halves, in a node as in a chain of chunks.
"""

from __future__ import annotations

import heapq
from functools import reduce
from itertools import product

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Last kept role: none yet, system, user, assistant. The first and the last may end a conversation.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
#: Role that an inserted or rerolled row takes after each state.
TURN = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
#: Rows solved at once; longer conversations are chained from chunks.
CHUNK = 256

Solution = tuple[int, str]
Edge = tuple[int, str, int]


def row_edits(symbol: str) -> list[tuple[int, int, str, int]]:
    """(state before, state after, letter, cost) of every edit of one row."""
    edits = [(q, q, "D", DELETE) for q in range(4)]
    if symbol != "D":
        extra = TRUNCATED if symbol.isupper() else 0
        edits += [(q, p, "K", KEEP + extra) for q, p in KEPT[symbol.lower()].items()]
        edits += [(q, p, "R", REROLE + extra) for q, p in TURN.items()]
    return edits


INSERTS = [(q, p, "I", INSERT) for q, p in TURN.items()]


class _Lattice:
    """Edges out of and into the nodes ``4 * rows consumed + state``."""

    def __init__(self, symbols: str) -> None:
        self.size = len(symbols)
        self.after: list[list[Edge]] = [[] for _ in range(4 * self.size + 4)]
        self.before: list[list[Edge]] = [[] for _ in range(4 * self.size + 4)]
        for i in range(self.size + 1):
            for q, p, letter, cost in INSERTS:
                self._edge(4 * i + q, 4 * i + p, letter, cost)
        for i, symbol in enumerate(symbols):
            for q, p, letter, cost in row_edits(symbol):
                self._edge(4 * i + q, 4 * i + 4 + p, letter, cost)

    def _edge(self, tail: int, head: int, letter: str, cost: int) -> None:
        self.after[tail].append((head, letter, cost))
        self.before[head].append((tail, letter, cost))


class _Front:
    """One of the two searches. Nodes leave its heap by cost and then by distance from its end, so that
    all steps that cost nothing into a node are taken before the node is settled."""

    def __init__(self, ends: list[int], edges: list[list[Edge]], forward: bool) -> None:
        self.ends, self.edges, self.forward = ends, edges, forward
        self.found: dict[int, Solution] = {node: (0, "") for node in ends}
        self.settled: dict[int, Solution] = {}
        self.heap = [(0, self._rank(node), node) for node in ends]
        heapq.heapify(self.heap)

    def _rank(self, node: int) -> int:
        return node // 4 if self.forward else -(node // 4)

    def least(self) -> int | None:
        while self.heap and self.heap[0][2] in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def certain(self) -> dict[int, Solution]:
        """The settled nodes and the ends, settled or not."""
        return self.settled | {node: (0, "") for node in self.ends}

    def settle(self, other: _Front, best: float) -> float:
        """Settles the next node; the best total of a path through one of its edges, or ``best``."""
        cost, _, node = heapq.heappop(self.heap)
        self.settled[node] = (cost, audit) = self.found[node]
        if node in other.found:
            best = min(best, cost + other.found[node][0])
        for head, letter, step in self.edges[node]:
            if head in self.settled:
                continue
            reached = (cost + step, audit + letter if self.forward else letter + audit)
            known = self.found.get(head)
            if known is None or reached < known:
                self.found[head] = reached
                if known is None or reached[0] < known[0]:
                    heapq.heappush(self.heap, (reached[0], self._rank(head), head))
            if head in other.found:
                best = min(best, reached[0] + other.found[head][0])
        return best


def cheapest(symbols: str, starts: tuple[int, ...] = (NONE,), ends: tuple[int, ...] = ENDS) -> Solution | None:
    """Least cost and, of that cost, the ASCII-least audit from one of ``starts`` to one of ``ends``."""
    lattice = _Lattice(symbols)
    forward = _Front(list(starts), lattice.after, True)
    backward = _Front([4 * lattice.size + q for q in ends], lattice.before, False)
    best = float("inf")
    while (a := forward.least()) is not None and (b := backward.least()) is not None and a + b <= best:
        best = forward.settle(backward, best) if a <= b else backward.settle(forward, best)
    left, right = forward.certain(), backward.certain()
    audits = []
    for node, (cost, audit) in left.items():
        if node in right and cost + right[node][0] == best:
            audits.append(audit + right[node][1])
        for head, letter, step in lattice.after[node]:
            if head in right and cost + step + right[head][0] == best:
                audits.append(audit + letter + right[head][1])
    return (int(best), min(audits)) if audits else None


Table = dict[tuple[int, int], Solution]


def _table(symbols: str) -> Table:
    """Cheapest repairs of a chunk between every two states."""
    found = {(q, p): cheapest(symbols, (q,), (p,)) for q, p in product(range(4), repeat=2)}
    return {pair: way for pair, way in found.items() if way is not None}


def _chained(left: Table, right: Table) -> Table:
    joined: Table = {}
    for (q, m), (cost, audit) in left.items():
        for p in range(4):
            if (m, p) in right:
                way = (cost + right[m, p][0], audit + right[m, p][1])
                joined[q, p] = min(joined.get((q, p), way), way)
    return joined


def repair(symbols: str, chunk: int = CHUNK) -> Solution:
    """Cost and audit of a whole conversation. Chunks are joined in pairs, so the work
    on audits grows with length times the logarithm of the number of chunks."""
    if len(symbols) <= chunk:
        return cheapest(symbols)
    known: dict[str, Table] = {}
    parts = [symbols[k : k + chunk] for k in range(0, len(symbols), chunk)]
    tables = [known[p] if p in known else known.setdefault(p, _table(p)) for p in parts]
    while len(tables) > 1:
        tables = [reduce(_chained, tables[k : k + 2]) for k in range(0, len(tables), 2)]
    return min(tables[0][NONE, q] for q in ENDS if (NONE, q) in tables[0])
