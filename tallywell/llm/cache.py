"""A bounded cache for what workers look up again and again."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Generic, TypeVar

Value = TypeVar("Value")

_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], Value]) -> Value:
    """What ``make`` gave for this key in this worker process. Only the last key's is kept, so that
    what one operator has cached does not stay in memory while the next one runs."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """For operators that hold nothing: drops what an earlier one has cached in this worker."""
    _HELD.clear()


#: Entries after which a generation ends.
CACHE_LIMIT = 350_000


class GenerationCache(Generic[Value]):
    """When full, the entries become old ones, which go at the next time unless used meanwhile."""

    def __init__(self, limit: int = CACHE_LIMIT) -> None:
        self.limit = limit
        self.new: dict[str, Value] = {}
        self.old: dict[str, Value] = {}

    def get(self, key: str) -> Value | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: Value) -> Value:
        if len(self.new) >= self.limit:
            self.new, self.old = {}, self.new
        self.new[key] = value
        return value
