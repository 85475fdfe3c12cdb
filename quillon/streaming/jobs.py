"""The same operators on streams: idempotent outbox, sliding-window limiter, miss counters, windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once_per_subject(events: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Events by (kind, subject_id) once, for as long as the watermark lets a repeat come."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(["kind", "subject_id"])


def _until(state: GroupState, live_ms: int | None, begun: int) -> None:
    """A key's state goes when its time to live is over."""
    if live_ms:
        state.setTimeoutDuration(max(1, begun + live_ms - state.getCurrentProcessingTimeMs()))


def _first(order: list[str], live_ms: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None  # one row is held, however many come
        for frame in frames:
            best = (frame if best is None else pd.concat([best, frame])).sort_values(order, kind="stable").head(1)
        now = state.getCurrentProcessingTimeMs()
        begun = state.get[0] if state.exists else None
        if begun is None or (live_ms and begun + live_ms <= now):
            state.update((now,))
            _until(state, live_ms, now)
            yield best
        else:
            _until(state, live_ms, begun)

    return run


def first_of_key(events: DataFrame, key: list[str], order: list[str], live_ms: int | None = None) -> DataFrame:
    """A stream without the repeats of each key, whenever they come within ``live_ms`` of the first (ever, if it is
    unset); of several in one batch the first by ``order`` goes through.

    Rows with a null in the key are no repeats of each other, as in a unique index; they pass without state.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if live_ms else GroupStateTimeout.NoTimeout
    whole = events.dropna(subset=key)
    kept = whole.groupBy(*key).applyInPandasWithState(_first(order, live_ms), events.schema, "begun long", "append", timeout)
    some_null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    return kept.unionByName(events.filter(some_null))


def batches_into(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: each micro-batch has a folder by its number, which a replay writes over."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def outbox(events: DataFrame, path: str, key: list[str], order: list[str], live_ms: int | None = None) -> DataStreamWriter:
    """Writes each key once: what has been written is known from keyed state, never from the table, and a replayed
    batch replaces itself. ``spark.read.parquet(path)`` has the events and the number of their batch."""
    return first_of_key(events, key, order, live_ms).writeStream.foreachBatch(batches_into(path))


LIMITED = "key string, at timestamp, allowed boolean, retry_after double"


def _judge(stamps: list[float], at: float, most: int, window: float) -> tuple[bool, float, list[float]]:
    stamps = [s for s in stamps if s > at - window]
    if len(stamps) < most:
        return True, 0.0, [*stamps, at]
    return False, stamps[0] + window - at, stamps


def limiter(most: int, window_seconds: float):
    """A stateful function for ``applyInPandasWithState``: at most ``most`` accepted hits a window and key.

    Refused hits do not count; the state is the accepted hits of one window, ``most`` at most.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps = list(state.get[0]) if state.exists else []
        hits = pd.concat(list(frames)).sort_values("at")
        rows = []
        for at in hits["at"]:
            allowed, wait, stamps = _judge(stamps, at.timestamp(), most, window_seconds)
            rows.append((key[0], at, allowed, wait))
        state.update((stamps,))
        yield pd.DataFrame(rows, columns=["key", "at", "allowed", "retry_after"])

    return run


def limited(hits: DataFrame, most: int, window_seconds: float) -> DataFrame:
    """Stream of (key, at) with the limiter's verdicts."""
    return hits.groupBy("key").applyInPandasWithState(limiter(most, window_seconds), LIMITED, "stamps array<double>", "append", GroupStateTimeout.NoTimeout)


def limited_batch(hits: DataFrame, most: int, window_seconds: float) -> DataFrame:
    """The same over a finished table: sorted within its partition, a key's hits pass as a stream of
    batches; a task holds the accepted hits of one window of one key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, stamps = None, []
        for frame in frames:
            rows = []
            for key, at in zip(frame["key"], frame["at"], strict=True):
                if key != own:
                    own, stamps = key, []
                allowed, wait, stamps = _judge(stamps, at.timestamp(), most, window_seconds)
                rows.append((key, at, allowed, wait))
            yield pd.DataFrame(rows, columns=["key", "at", "allowed", "retry_after"])

    return hits.select("key", "at").repartition("key").sortWithinPartitions("key", "at").mapInPandas(run, LIMITED)


def miss_counter():
    """State of one (source, external_id): eligible runs since it was seen. What is held of a batch are the runs after the
    last sighting in it."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, missed = None, []
        for frame in frames:
            seen = frame.loc[frame["seen"], "run"]
            last = seen.max() if last is None and len(seen) else max(last, seen.max()) if len(seen) else last
            missed += frame.loc[frame["eligible"] & ~frame["seen"], "run"].tolist()
            missed = [n for n in missed if last is None or n > last]
        misses = len(missed) + (state.get[0] if last is None and state.exists else 0)
        state.update((misses,))
        yield pd.DataFrame([(*key, misses)], columns=["source", "external_id", "misses"])

    return run


def counted_misses(runs: DataFrame) -> DataFrame:
    """Stream of (source, external_id, run, eligible, seen), runs in order from batch to batch: after each batch the misses of its listings."""
    return runs.groupBy("source", "external_id").applyInPandasWithState(miss_counter(), "source string, external_id string, misses long", "misses long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, width: str, late: str | None = None) -> DataFrame:
    """Tumbling counts and sums by type; with ``late`` a watermark for streams."""
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
