"""Quiet-period batches of file events.

A batch opens at an event and takes every event that comes before the quiet period after the last one is over. With a cap, it
also closes at the event that finds it open for ``cap`` seconds or longer. The uncapped form is a session window. The capped
form depends on all events before, so each root's events are folded in order as a stream of sorted rows: memory is one row a
partition, however many events a root has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds a batch may stay open, and the allowed range of the quiet period with its default.
CAP, QUIET, QUIET_RANGE = 60.0, 3.0, (0.1, 300.0)


def check_quiet(seconds: float) -> float:
    if not QUIET_RANGE[0] <= seconds <= QUIET_RANGE[1]:
        raise ValueError(f"the quiet period must be between {QUIET_RANGE[0]} and {QUIET_RANGE[1]} seconds")
    return seconds


def sessions(events: DataFrame, root: str = "root", ts: str = "ts", gap: float = QUIET) -> DataFrame:
    """(root, started, ended, n): uncapped batches; ts in seconds. Rows with a null root or time are left out."""
    w = Window.partitionBy(root).orderBy(ts)
    e = events.filter(F.col(root).isNotNull() & F.col(ts).isNotNull())
    new = F.when(F.col(ts) - F.lag(ts).over(w) < gap, 0).otherwise(1)
    marked = e.withColumn("_new", new).withColumn("_batch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(root, "_batch").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("_batch")


def capped_batches(events: DataFrame, root: str = "root", ts: str = "ts", gap: float = QUIET, cap: float = CAP) -> DataFrame:
    """(root, started, ended, n): batches with a cap; ts in seconds. Rows with a null root or time are left out."""
    kind = dict(events.dtypes)[root]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = started = last = None
        n = 0
        for f in frames:
            out = []
            for k, t in zip(f[root], f[ts]):
                if n and (k != key or t - last >= gap):
                    out.append((key, started, last, n))
                    n = 0
                if not n:
                    key, started = k, t
                last, n = t, n + 1
                if t - started >= cap:
                    out.append((key, started, last, n))
                    n = 0
            yield pd.DataFrame(out, columns=[root, "started", "ended", "n"])
        if n:
            yield pd.DataFrame([(key, started, last, n)], columns=[root, "started", "ended", "n"])

    e = events.select(root, F.col(ts).cast("double").alias(ts)).filter(F.col(root).isNotNull() & F.col(ts).isNotNull())
    return e.repartition(root).sortWithinPartitions(root, ts).mapInPandas(fold, f"{root} {kind}, started double, ended double, n long")


def stream_batches(events: DataFrame, gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """Uncapped batches of an event stream (root, path, kind, ts timestamp): one row per batch with its distinct paths."""
    return (
        events.filter(F.col("kind") != "access")
        .withWatermark("ts", late)
        .groupBy("root", F.session_window("ts", gap).alias("w"))
        .agg(F.collect_set("path").alias("paths"))
        .select("root", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths")
    )


def stream_capped_batches(events: DataFrame, gap_ms: int = 3000, cap_ms: int = 60_000) -> DataFrame:
    """Capped batches of an event stream (root, path, kind), by the time of arrival: state is the open batch of a root.

    A batch is put out when its quiet period is over, or as soon as it has been open for the cap.
    """

    def step(key, frames, state):
        import time

        now = time.time() * 1000
        opened, paths = state.get if state.exists else (now, [])
        paths = set(paths)
        if not state.hasTimedOut:
            for f in frames:
                paths.update(f["path"].dropna())
        done = state.hasTimedOut or now - opened >= cap_ms
        if done:
            state.remove()
            if paths:
                yield pd.DataFrame({"root": [key[0]], "paths": [sorted(paths)]})
        elif paths:
            state.update((opened, sorted(paths)))
            state.setTimeoutDuration(max(1, int(min(gap_ms, opened + cap_ms - now))))

    return (
        events.filter(F.col("kind") != "access")
        .groupBy("root")
        .applyInPandasWithState(step, "root string, paths array<string>", "opened double, paths array<string>", "append", "ProcessingTimeTimeout")
    )
