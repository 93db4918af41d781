"""Driver-side control: settings, batches, retries, parallel calls and a rate limit. Data are batched by Spark, not by these."""

from __future__ import annotations

import contextvars
import threading
import time
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from .metrics import ParallelReport

X, Y = TypeVar("X"), TypeVar("Y")
RETRYABLE = ("timeout", "connection", "deadlock", "lock")


Hook = Callable[[str, object], None]


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a registry, read by every query and mutation over it; a call's own arguments come first.

    ``insensitive_search``, ``list_limit`` and ``strict_nested`` are the compiler's, ``compare`` is that of upserts. ``before`` and
    ``after`` are hooks (model, items or change) of every upsert, run before a call's own. Actions that start Spark jobs wait for
    their turn at ``max_queries_per_second``, and snapshots are written with ``retries`` further attempts. ``parallel`` lets several
    tables be written at once, at most ``concurrency`` of them; a transaction doesn't. Below ``snapshot_folder`` snapshots are kept as
    Parquet, which later scans prune and skip in, until someone removes them; without one they are checkpoints in the shared folder.
    """

    insensitive_search: bool = True
    list_limit: int = 10_000
    strict_nested: bool = False
    compare: str = "strict"
    max_queries_per_second: float = 100
    concurrency: int = 4
    parallel: bool = True
    retries: int = 3
    snapshot_folder: str | None = None
    before: tuple[Hook, ...] = ()
    after: tuple[Hook, ...] = ()

    def __post_init__(self) -> None:
        for name in ("list_limit", "concurrency"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a positive whole number")
        rate = self.max_queries_per_second
        if isinstance(rate, bool) or not isinstance(rate, (int, float)) or not 0 < rate < float("inf"):
            raise ValueError("max_queries_per_second must be a positive number")
        if isinstance(self.retries, bool) or not isinstance(self.retries, int) or self.retries < 0:
            raise ValueError("retries must be a whole number")
        for name in ("insensitive_search", "strict_nested", "parallel"):
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} must be true or false")
        if self.compare not in ("strict", "normalized"):
            raise ValueError(f"no such comparison: {self.compare}")


def batches(items: Sequence[X], size: int) -> list[Sequence[X]]:
    if size < 1:
        raise ValueError("size must be positive")
    return [items[i : i + size] for i in range(0, len(items), size)]


def concurrency_for(n: int) -> int:
    return 1 if n < 100 else 2 if n < 1_000 else 4 if n < 10_000 else 8


def with_retry(call: Callable[[], X], retries: int = 3, delay: float = 0.1, longest: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> X:
    """Calls again, after waits that double, on errors whose text says they may pass."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if attempt == retries or not any(w in str(e).lower() for w in RETRYABLE):
                raise
            sleep(min(longest, delay * 2**attempt))
    raise AssertionError


def in_parallel(call: Callable[[X], Y], items: Iterable[X], concurrency: int = 4, report: Callable[[ParallelReport], None] | None = None) -> tuple[list[Y], list[tuple[X, Exception]]]:
    """Results in order, and the items that failed with their errors. Calls see the caller's context, an open transaction with it."""
    items = list(items)
    results: list[Y] = []
    errors: list[tuple[X, Exception]] = []
    took: list[float] = []
    began = time.perf_counter()

    def timed(x: X) -> Y:
        start = time.perf_counter()
        try:
            return call(x)
        finally:
            took.append(time.perf_counter() - start)

    with ThreadPoolExecutor(max(1, concurrency)) as pool:
        for item, future in [(x, pool.submit(contextvars.copy_context().run, timed, x)) for x in items]:
            try:
                results.append(future.result())
            except Exception as e:
                errors.append((item, e))
    if report is not None:
        report(ParallelReport(time.perf_counter() - began, sum(took), max(1, concurrency), len(items)))
    return results, errors


class TokenBucket:
    """At most ``rate`` calls a second on average and at once; full at first."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.most = max(1.0, float(rate))
        self.tokens, self.at, self.lock = self.most, clock(), threading.Lock()

    def acquire(self) -> float:
        """Waits for its turn and returns how long that took."""
        with self.lock:
            now = self.clock()
            self.tokens = min(self.most, self.tokens + (now - self.at) * self.rate)
            self.at = now
            self.tokens -= 1
            wait = max(0.0, -self.tokens / self.rate)
        if wait:
            self.sleep(wait)
        return wait
