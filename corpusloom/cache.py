"""A cache of answers in the driver: least recently used entries go first, old ones are not given (STR-05, SCH-23, EXT-02, AGG-33)."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Protocol


class Backend(Protocol):
    """What holds the entries."""

    def get(self, key: Hashable) -> object | None: ...
    def put(self, key: Hashable, value: object) -> None: ...


class Cache:
    """At most ``size`` entries, none older than ``seconds``."""

    def __init__(self, size: int = 256, seconds: float = 1800.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.entries: OrderedDict[Hashable, tuple[float, object]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Hashable) -> object | None:
        found = self.entries.get(key)
        if found is None or self.clock() - found[0] > self.seconds:
            self.entries.pop(key, None)
            self.misses += 1
            return None
        self.entries.move_to_end(key)
        self.hits += 1
        return found[1]

    def put(self, key: Hashable, value: object) -> None:
        self.entries[key] = (self.clock(), value)
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"entries": len(self.entries), "hits": self.hits, "misses": self.misses, "hit_rate": round(self.hits / asked, 4) if asked else 0.0}
