"""Whether two tokens stay neighbours when their bytes are encoded together.

A token is made by a tree of merges.  Down its right side lie the tokens that end where it ends, from a single symbol
up to itself: its right spine; the left spine likewise.  Merges happen in the order of rank, the left one of equals
first, so while two neighbours grow, the tokens that touch at their border are one of the left token's right spine
and one of the right token's left spine.  They stay apart if at no time the union of the two that touch has a better
rank than the next step of either spine.
"""

from __future__ import annotations

from collections.abc import Callable

NEVER = float("inf")


class Spines:
    def __init__(self, rank: Callable, merge: Callable):
        """``rank(token)``: the lower the earlier, ``NEVER`` if it is none; ``merge(text)``: its tokens, two steps visible."""
        self.rank, self.merge = rank, merge
        self._right: dict = {}
        self._left: dict = {}
        self.known: dict = {}  # of pairs of tokens, whether they stay neighbours

    def halves(self, token):
        """The two tokens whose merge makes it; none if it is a symbol; False if merging never makes it."""
        if len(token) == 1:
            return None
        parts = self.merge(token, 2)
        return tuple(parts) if len(parts) == 2 and self.rank(token) != NEVER else False

    def _spine(self, token, side: int, kept: dict):
        if token not in kept:
            halves = self.halves(token)
            if halves is None:
                kept[token] = ((token, NEVER),)
            elif halves is False:
                kept[token] = False
            else:
                inner = self._spine(halves[side], side, kept)
                kept[token] = inner and (*((t, r) for t, r in inner[:-1]), (inner[-1][0], self.rank(token)), (token, NEVER))
        return kept[token]

    def neighbours(self, a, b) -> bool:
        key = a, b
        known = self.known.get(key)
        if known is None:
            if len(self.known) > 500_000:
                self.known.clear()
            known = self.known[key] = self._apart(a, b)
        return known

    def makes(self, token) -> bool:
        return bool(self._spine(token, 0, self._left)) and bool(self._spine(token, 1, self._right))

    def _apart(self, a, b) -> bool:
        right, left = self._spine(a, 1, self._right), self._spine(b, 0, self._left)
        if not right or not left:
            return False
        i = j = 0
        while True:
            (x, next_x), (y, next_y) = right[i], left[j]
            union = self.rank(x + y)
            if union < next_x and union <= next_y and union != NEVER:
                return False
            if next_x <= next_y:
                if next_x == NEVER:
                    return True
                i += 1
            else:
                j += 1
