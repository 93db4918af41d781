"""Measures of what ran, and estimates of what would."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Operation:
    name: str
    model: str
    rows: int
    seconds: float

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds > 0 else 0.0


@dataclass
class Metrics:
    """What the engine applied, in order. One for each registry; safe for threads."""

    operations: list[Operation] = field(default_factory=list)
    clock: Callable[[], float] = time.perf_counter
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    @contextmanager
    def timed(self, name: str, model: str) -> Iterator[dict[str, int]]:
        """Measures the block; it says in the mapping's ``rows`` how many rows it was about."""
        found, began = {"rows": 0}, self.clock()
        yield found
        with self.lock:
            self.operations.append(Operation(name, model, found["rows"], self.clock() - began))

    def total(self, name: str | None = None) -> Operation:
        own = [o for o in self.operations if name in (None, o.name)]
        return Operation(name or "all", "*", sum(o.rows for o in own), sum(o.seconds for o in own))


@dataclass(frozen=True)
class ParallelReport:
    """Seconds from the first start to the last end, seconds one after another, and what follows from these."""

    seconds: float
    sequential: float
    concurrency: int
    calls: int

    @property
    def speedup(self) -> float:
        return self.sequential / self.seconds if self.seconds > 0 and self.sequential > 0 else 1.0

    @property
    def efficiency(self) -> float:
        return min(1.0, self.speedup / max(1, min(self.concurrency, self.calls)))

    @property
    def utilisation(self) -> float:
        """How much of the concurrency the calls could use."""
        return min(1.0, self.speedup / self.concurrency) if self.calls >= self.concurrency else self.calls / self.concurrency

    @property
    def calls_per_second(self) -> float:
        return self.calls / self.seconds if self.seconds > 0 else 0.0


def batch_megabytes(items: int, item_bytes: int = 1024) -> float:
    return items * item_bytes / 2**20


def batch_fits(items: int, megabytes: float = 100, item_bytes: int = 1024) -> bool:
    return batch_megabytes(items, item_bytes) <= megabytes


def placeholders(conditions: Iterable[Mapping[str, object]]) -> int:
    """Values that a list of alternatives, each a mapping of field to value, would bind."""
    return sum(len(c) for c in conditions)


def alternatives_fit(conditions: Iterable[Mapping[str, object]], limit: int, margin: float = 0.8) -> bool:
    """Whether a literal predicate of these alternatives stays below ``margin`` of ``limit``; beyond, a key table is the way."""
    return placeholders(conditions) <= int(limit * margin)
