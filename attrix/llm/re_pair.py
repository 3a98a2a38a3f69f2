"""Re-Pair: a grammar for a set of symbol sequences, made by replacing the most frequent pair of neighbours."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence


def re_pair(sequences: Sequence[Sequence[int]], first_rule: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(rules, compressed sequences): rule k stands for the symbol ``first_rule + k`` and has two older symbols.

    Pairs never reach over the end of a sequence. Of equally frequent pairs the least is taken, so the result depends on
    the sequences alone. Rules are made while a pair occurs twice.
    """
    symbol: list[int | None] = [None]
    for s in sequences:
        symbol += [*s, None]
    after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    count: dict[tuple[int, int], int] = defaultdict(int)

    def note(p: int) -> tuple[int, int] | None:
        pair = symbol[p], symbol[after[p]]
        if None in pair:
            return None
        places[pair].append(p)
        count[pair] += 1
        return pair

    for p in range(len(symbol) - 1):
        note(p)
    heap = [(-n, pair) for pair, n in count.items() if n > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        n, pair = heapq.heappop(heap)
        if count[pair] != -n:
            if count[pair] > 1:
                heapq.heappush(heap, (-count[pair], pair))
            continue
        new, touched = first_rule + len(rules), set()
        rules.append(pair)
        for p in sorted(set(places.pop(pair))):
            q = after[p]
            if symbol[p] != pair[0] or q >= len(symbol) or symbol[q] != pair[1]:
                continue  # gone with an earlier replacement
            left, right = before[p], after[q]
            for edge in ((symbol[left], pair[0]), (pair[1], symbol[right])):
                if None not in edge and edge in count:
                    count[edge] -= 1
            symbol[p], symbol[q] = new, None
            after[p], before[right] = right, p
            touched |= {note(left), note(p)}
        count.pop(pair, None)
        for pair in touched - {None}:
            if count[pair] > 1:
                heapq.heappush(heap, (-count[pair], pair))
    out, p = [], 1
    for _ in sequences:
        s = []
        while symbol[p] is not None:
            s.append(symbol[p])
            p = after[p]
        out.append(s)
        p = after[p]
    return rules, out
