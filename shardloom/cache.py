"""Results of queries, kept for a while: least recently used go first."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import dataclass


@dataclass
class CacheStats:
    entries: int = 0
    hits: int = 0
    misses: int = 0
    expired: int = 0

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


class ResultCache:
    """Keys are parsed queries, so spacing and keyword case don't matter and literals do."""

    def __init__(self, max_entries: int = 1000, ttl_s: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.max_entries, self.ttl_s, self.clock = max_entries, ttl_s, clock
        self._held: OrderedDict[Hashable, tuple[float, str, object]] = OrderedDict()
        self._stats = CacheStats()

    def get(self, key: Hashable) -> object | None:
        found = self._held.get(key)
        if found and self.clock() - found[0] >= self.ttl_s:
            del self._held[key]
            self._stats.expired += 1
            found = None
        if found is None:
            self._stats.misses += 1
            return None
        self._held.move_to_end(key)
        self._stats.hits += 1
        return found[2]

    def put(self, key: Hashable, table: str, result: object) -> None:
        self._held[key] = (self.clock(), table, result)
        self._held.move_to_end(key)
        while len(self._held) > self.max_entries:
            self._held.popitem(last=False)

    def invalidate(self, table: str | None = None) -> int:
        """Forget the results of a table, or all; the number of them."""
        gone = [k for k, (_, t, _) in self._held.items() if table is None or t == table]
        for k in gone:
            del self._held[k]
        return len(gone)

    def stats(self) -> CacheStats:
        self._stats.entries = len(self._held)
        return self._stats
