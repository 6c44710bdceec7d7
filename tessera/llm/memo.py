"""A dictionary that computes what it lacks and forgets what wasn't asked for lately, so its size is bounded."""

from __future__ import annotations

from collections.abc import Callable

ENTRIES = 250_000
#: Keys longer than this aren't kept.
LONGEST = 64


class Memo(dict):
    def __init__(self, compute: Callable, entries: int = ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        if key in self.old:
            value = self.old[key]
        else:
            value = self.compute(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
