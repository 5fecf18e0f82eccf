"""Pair merges: the definition, and a quick test of whether two tokens may stand side by side."""

from __future__ import annotations

import heapq
import math
from collections.abc import Hashable, Sequence
from typing import TypeVar

Text = TypeVar("Text", str, bytes)


def merge(text: Text, ranks: dict[Text, float], stop: float = math.inf) -> list[Text]:
    """The merges as defined: join the neighbours whose union has the lowest rank, leftmost first, until none is left.

    Starts from single characters or bytes. Unions of rank ``stop`` and above are not made.
    """
    parts: list[Text | None] = [text[i : i + 1] for i in range(len(text))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue: list[tuple[float, int, Text]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts):
            union = parts[i] + parts[after[i]]
            if ranks.get(union, math.inf) < stop:
                heapq.heappush(queue, (ranks[union], i, union))

    for i in range(len(parts)):
        offer(i)
    while queue:
        _, i, union = heapq.heappop(queue)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != union:
            continue  # one of the two has been joined with another meanwhile
        parts[i], parts[j], after[i] = union, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


class Neighbours:
    """Answers, with a memo, whether the merges of ``left + right`` give exactly these two tokens.

    While the merges of ``left`` run, the part at its right edge grows from one character to the whole; so does the
    part at the left edge of ``right``. Both grow in order of rank. The two tokens stay apart unless, at some moment,
    the union of the two edge parts ranks before the next growth of either.
    """

    def __init__(self, ranks: dict[Text, float], memo: int = 1_000_000) -> None:
        self.ranks, self.memo = ranks, memo
        self._edges: dict[tuple[Hashable, bool], list] = {}
        self._known: dict[tuple[Text, Text], bool] = {}

    def _growth(self, token: Text, at_right: bool) -> list[tuple[Text, float]]:
        """(part at the edge, rank of the merge that replaces it), from a single character to the token itself."""
        found = self._edges.get((token, at_right))
        if found is None:
            if len(token) == 1:
                found = [(token, math.inf)]
            else:
                rank = self.ranks[token]
                halves = merge(token, self.ranks, rank)
                if len(halves) != 2:
                    found = []  # not made by a last merge of two parts
                else:
                    inner = self._growth(halves[-1 if at_right else 0], at_right)
                    grows = inner and (len(inner) < 2 or inner[-2][1] < rank)
                    found = [*inner[:-1], (inner[-1][0], rank), (token, math.inf)] if grows else []
            self._edges[token, at_right] = found
        return found

    def _apart(self, left: Text, right: Text) -> bool:
        ours, theirs = self._growth(left, True), self._growth(right, False)
        if not ours or not theirs:  # ranks that do not rise: go by the definition
            return merge(left + right, self.ranks) == [left, right]
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ours[i], theirs[j]
            joint = self.ranks.get(a + b)
            # Of equal ranks the leftmost is merged first: growth in ``left``, then the union, then growth in ``right``.
            if joint is not None and joint < a_until and joint <= b_until:
                return False
            if a_until == b_until == math.inf:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def apart(self, left: Text, right: Text) -> bool:
        known = self._known.get((left, right))
        if known is None:
            if len(self._known) >= self.memo:
                self._known.clear()
            known = self._known[left, right] = self._apart(left, right)
        return known


def makeable(tokens: Sequence[Text], ranks: dict[Text, float]) -> list[Text]:
    """The tokens that the merges of their own text give back whole."""
    return [t for t in tokens if t and merge(t, ranks) == [t]]
