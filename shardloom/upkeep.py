"""Periodic work: expiry, seals' statistics, snapshots and alerts, for a scheduler to call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .alerts import AlertChecker
from .engine import Engine
from .operators.sampling import SubsampleStats
from .snapshots import snapshot


@dataclass
class Worker:
    """A task and how often it is due."""

    every_ms: int
    task: Callable[[int], object]
    last_ms: int | None = None

    def run_once(self, now_ms: int) -> object | None:
        """Run the task if it is due; its result, else None."""
        if self.last_ms is not None and now_ms - self.last_ms < self.every_ms:
            return None
        self.last_ms = now_ms
        return self.task(now_ms)


def sealed_stats(engine: Engine, now_ms: int) -> dict[str, dict[int, SubsampleStats]]:
    """Seal the shards that ended long enough ago; per table and shard their rows, and how many a subsample would keep.

    Nothing is dropped, but a sealed shard takes no more rows.
    """
    from pyspark.sql import functions as F

    from .functions.time import bucket_ms, to_ms
    from .types import TIME_COLUMN

    out = {}
    for name in engine.catalog.names():
        table = engine.catalog.get(name)
        end = now_ms - table.config.subsample_after_ms
        old = [s for s in table.shards() if s + table.config.shard_ms <= end]
        if not old:
            continue
        table.seal(old)
        rows = table.scan(None, old[-1] + table.config.shard_ms)
        counts = rows.groupBy(bucket_ms(to_ms(F.col(TIME_COLUMN)), table.config.shard_ms).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
        ratio = table.config.subsample_ratio
        out[name] = {r.shard: SubsampleStats(r.n, min(r.n, -int(-r.n * ratio // 1))) for r in counts.collect() if r.shard in set(old)}
    return out


@dataclass
class Upkeep:
    """All workers of an engine, each with its usual period."""

    engine: Engine
    alerts: AlertChecker | None = None
    snapshot_folder: str | None = None
    workers: dict[str, Worker] = field(default_factory=dict)

    def __post_init__(self):
        self.workers["expire"] = Worker(60_000, self.engine.expire)
        self.workers["subsample"] = Worker(300_000, lambda now: sealed_stats(self.engine, now))
        if self.snapshot_folder:
            self.workers["snapshot"] = Worker(300_000, lambda now: snapshot(self.engine, self.snapshot_folder))
        if self.alerts:
            self.workers["alerts"] = Worker(0, self.alerts.run_once)

    def run_once(self, now_ms: int | None = None) -> dict[str, object]:
        """Results of the workers that were due."""
        now = self.engine.now_ms() if now_ms is None else now_ms
        return {name: found for name, w in self.workers.items() if (found := w.run_once(now)) is not None}
