"""File-change streams: coalescing, session gaps, the update queue and the runtime's states."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window, functions as F

TRANSITIONS = {
    "stopped": {"starting"}, "starting": {"running", "failed", "stopping"}, "running": {"updating", "stopping", "failed"},
    "updating": {"running", "failed", "stopping"}, "failed": {"starting", "running", "updating", "stopping"}, "stopping": {"stopped", "failed"},
}


def sessions(events: DataFrame, gap_ms: int, ts: str = "ts") -> DataFrame:
    """events with ``batch``: a new one after more than gap_ms without any event. Gaps are found against the end of the
    previous minute's events, so the running order is per minute and only one row a minute is ordered globally."""
    e = events.withColumn("at", F.unix_micros(ts)).withColumn("minute", F.floor(F.col("at") / 60_000_000))
    minute = e.groupBy("minute").agg(F.max("at").alias("last"))
    prior = minute.withColumn("carried", F.lag("last").over(Window.orderBy("minute"))).select("minute", "carried")
    own = Window.partitionBy("minute").orderBy("at")
    opened = e.join(prior, "minute").withColumn("before", F.coalesce(F.lag("at").over(own), "carried"))
    opened = opened.withColumn("opens", (F.col("before").isNull() | (F.col("at") - F.col("before") > gap_ms * 1000)).cast("int"))
    counts = opened.groupBy("minute").agg(F.sum("opens").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("minute", "base")
    ranked = opened.withColumn("k", F.sum("opens").over(own.rangeBetween(Window.unboundedPreceding, 0)))
    return ranked.join(base, "minute").withColumn("batch", F.col("base") + F.col("k")).drop("at", "minute", "carried", "before", "opens", "k", "base")


def coalesced(changes: DataFrame, by: list[str], ts: str = "ts", kind: str = "change_type", seq: str = "seq") -> DataFrame:
    """One change per key: a delete last of all wins, a delete followed by something else is a change, else the latest."""
    return changes.groupBy(*by).agg(
        F.max_by(kind, F.struct(ts, seq)).alias("latest"), F.bool_or(F.col(kind) == "delete").alias("deleted"), F.min(ts).alias("detected_at")
    ).select(*by, F.when(F.col("deleted") & (F.col("latest") != "delete"), "change").otherwise(F.col("latest")).alias("change_type"), "detected_at")


def queued(changes: DataFrame, path: str = "file_path", ts: str = "detected_at") -> DataFrame:
    """The update queue: a path once, with its earliest detection."""
    return changes.groupBy(path).agg(F.min(ts).alias(ts))


@dataclass(frozen=True)
class Runtime:
    """State of an update loop; every step gives a new one."""

    lifecycle: str = "stopped"
    queue: dict[str, int] = field(default_factory=dict)
    deadline_ms: int | None = None
    in_flight: tuple[str, ...] = ()
    updated_ms: int | None = None
    error: str | None = None

    def to(self, state: str) -> Runtime:
        if state not in TRANSITIONS[self.lifecycle]:
            raise ValueError(f"no way from {self.lifecycle} to {state}")
        return replace(self, lifecycle=state)

    def enqueue(self, paths: list[str], now_ms: int, debounce_ms: int = 75) -> Runtime:
        if not paths:
            return self
        queue = dict(self.queue)
        for p in paths:
            queue[p] = min(queue.get(p, now_ms), now_ms)
        return replace(self, queue=queue, deadline_ms=max(now_ms + debounce_ms, self.deadline_ms or 0))

    def ready(self, now_ms: int) -> bool:
        return self.lifecycle in ("running", "failed") and not self.in_flight and bool(self.queue) and now_ms >= (self.deadline_ms or 0)

    def begin(self) -> Runtime:
        order = sorted(self.queue, key=lambda p: (self.queue[p], p))
        return replace(self.to("updating"), in_flight=tuple(order), queue={}, deadline_ms=None)

    def complete(self, now_ms: int) -> Runtime:
        return replace(self.to("running"), in_flight=(), updated_ms=max(now_ms, self.updated_ms or 0), error=None)

    def fail(self, now_ms: int, error: str) -> Runtime:
        """The files go back into the queue."""
        back = replace(self.to("failed"), in_flight=(), error=error)
        return back.enqueue(list(self.in_flight), now_ms, 0)

    def freshness(self, now_ms: int, stale_ms: int = 60_000) -> str:
        return "unknown" if self.updated_ms is None else "stale" if now_ms - self.updated_ms > stale_ms else "fresh"


def start(changes: DataFrame, apply: Callable[[list[str], int], None], checkpoint: str, trigger_ms: int = 75):
    """A streaming query over changes(file_path, change_type, ts): each micro-batch is coalesced and handed over once per batch id; a failed batch is replayed from the checkpoint."""

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = [r["file_path"] for r in batch.select("file_path").distinct().orderBy("file_path").collect()]
        if paths:
            apply(paths, batch_id)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{trigger_ms} milliseconds").start()
