"""Incremental twins of the batch folds, on Structured Streaming.

Every function takes a streaming (or batch) DataFrame.  The folds share their transition
function with the batch operators, so both give the same results for the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.ledger import next_state

FAULT = "fingerprint_id string, state string, total long, regressions long, first_ms long, last_ms long"
SESSION = "key string, status string, started_ms long, heartbeat_ms long"


def once(events: DataFrame, key: str = "import_id", at: str = "at", late: str = "1 day") -> DataFrame:
    """Events whose key was seen within the watermark are dropped."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def day_buckets(events: DataFrame, at: str = "at", keys: tuple[str, ...] = ("scope", "component"), late: str = "2 days") -> DataFrame:
    """`day, keys, successes, failures, duration_ms` by UTC day; late events count until the watermark passes their day."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    out = timed.groupBy(F.window(at, "1 day").alias("w"), *keys).agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.sum("duration_ms").alias("duration_ms"))
    return out.select(F.floor(F.unix_millis("w.start") / 86_400_000).cast("int").alias("day"), *keys, "successes", "failures", "duration_ms")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """`key, started_at, until, events`: sessions closed by a pause."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("until"), "events")


def fault_states(events: DataFrame) -> DataFrame:
    """The state of each fault after every micro-batch (`fingerprint_id, at, id, event`); the last row of a fault holds.

    Within a micro-batch events are folded in the order of time and id.
    """

    def fold(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, total, again, first, last = state.get if state.exists else (None, 0, 0, None, None)
        rows = pd.concat([g[["at", "id", "event"]] for g in groups]).sort_values(["at", "id"], kind="stable")
        for at, event in zip(rows["at"], rows["event"]):
            now, back = next_state(now, event)
            again += back
            if event == "occurrence":
                ms = int(at.timestamp() * 1000)
                total, first, last = total + 1, ms if first is None else min(first, ms), ms if last is None else max(last, ms)
        state.update((now, total, again, first, last))
        yield pd.DataFrame({"fingerprint_id": [key[0]], "state": [now], "total": [total], "regressions": [again], "first_ms": pd.array([first], "Int64"), "last_ms": pd.array([last], "Int64")})

    return events.groupBy("fingerprint_id").applyInPandasWithState(fold, FAULT, "state string, total long, regressions long, first long, last long", "update", GroupStateTimeout.NoTimeout)


def session_states(events: DataFrame, minutes: int = 30) -> DataFrame:
    """OPEN, CLOSED or ABANDONED of each session key from its events (`key, at, kind`: 'start', 'heartbeat', 'end').

    A start after a heartbeat older than `minutes` abandons the session before it; without any event for as long a processing-time timer does.
    """
    limit = minutes * 60_000

    def fold(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, start, beat = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "status": ["ABANDONED" if status == "OPEN" else status], "started_ms": [start], "heartbeat_ms": [beat]})
            return
        status, start, beat = state.get if state.exists else (None, None, None)
        out = []
        for at, kind in pd.concat(list(groups)).sort_values("at", kind="stable")[["at", "kind"]].itertuples(index=False):
            ms = int(at.timestamp() * 1000)
            if kind == "start":
                if status == "OPEN" and beat < ms - limit:
                    out.append((key[0], "ABANDONED", start, beat))
                    start = ms
                status, start = "OPEN", ms if status != "OPEN" else start
            elif kind == "end" and status == "OPEN":
                status = "CLOSED"
            beat = ms
        state.update((status, start, beat))
        state.setTimeoutDuration(limit)
        out.append((key[0], status, start, beat))
        yield pd.DataFrame(out, columns=["key", "status", "started_ms", "heartbeat_ms"])

    return events.groupBy("key").applyInPandasWithState(fold, SESSION, "status string, start long, beat long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def paired_calls(opens: DataFrame, closes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream-stream left join of opened calls (`call_id, tool, at`) and closes (`call_id, at, ok`) within an hour; calls never closed come out once the watermark has passed."""
    a = opens.withWatermark("at", late).select(F.col("call_id").alias("o_id"), "tool", F.col("at").alias("started_at"))
    b = closes.withWatermark("at", late).select(F.col("call_id").alias("c_id"), F.col("at").alias("ended_at"), "ok")
    within = F.expr("o_id = c_id and ended_at >= started_at and ended_at <= started_at + interval 1 hour")
    return a.join(b, within, "left_outer").select(F.col("o_id").alias("call_id"), "tool", "started_at", "ended_at", "ok")


def to_two(primary: str, mirror: str):
    """For `foreachBatch`: writes each batch to two tables, each in its own folder named by the batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for path in (primary, mirror):
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return write
