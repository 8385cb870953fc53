"""Counters and timers of a run."""

from __future__ import annotations

import time
from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from lingloom.operators import sample as B
from lingloom.sources import io


@dataclass
class RunStats:
    """Counters gathered while data passes by (no extra job), and stage timings with count, total, average, greatest."""

    counters: dict[str, int] = field(default_factory=dict)
    timings: dict[str, list[float]] = field(default_factory=dict)
    _watched: list[tuple[str, Observation]] = field(default_factory=list)

    def inc(self, name: str, n: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + n

    def watch(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """``df`` unchanged; its aggregates are read once an action has run over it."""
        seen = Observation(name)
        self._watched.append((name, seen))
        return df.observe(seen, *[c.alias(k) for k, c in counts.items()])

    @contextmanager
    def time(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timings.setdefault(name, []).append(time.perf_counter() - began)

    def report(self) -> dict[str, dict]:
        found = dict(self.counters)
        for name, seen in self._watched:
            found |= {f"{name}.{k}": v for k, v in seen.get.items()}
        times = {k: {"count": len(v), "total": sum(v), "avg": sum(v) / len(v), "max": max(v)} for k, v in self.timings.items()}
        return {"counters": found, "timings": times}

    def write(self, path: str, spark: SparkSession | None = None) -> None:
        io.write_json_atomic(path, self.report(), spark)


def scan_until_filled(chunks: Iterable[DataFrame], bucket: Column, config: B.BalancedConfig = B.BalancedConfig()) -> tuple[DataFrame | None, int]:
    """Read pieces of a corpus until a balanced sample can be filled: (all rows read, pieces read).

    What is read is a prefix of the corpus, so a sample from it is biased towards
    that prefix; use it only where a full pass costs more than that matters.
    """
    wanted = B.quotas(config.size, max(1, len(config.boundaries) - 1))
    room = B.capacities(wanted, config.oversample)
    counts: dict[int, int] = {}
    read: DataFrame | None = None
    n = 0
    for chunk in chunks:
        n += 1
        read = chunk if read is None else read.unionByName(chunk)
        for r in chunk.groupBy(bucket.alias("b")).count().collect():
            counts[r["b"]] = counts.get(r["b"], 0) + r["count"]
        if B.can_fill(counts, wanted, room, config.size)[1]:
            break
    return read, n
