"""Tool-call logs: pairing, duplicates, statistics, error groups, breaker runs and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import error_fingerprint
from quern.operators.metrics import nearest_rank


def pair_calls(opens: DataFrame, closes: DataFrame, key: str = "call_id") -> DataFrame:
    """Opened calls (`call_id, tool, at`) with the first close (`call_id, at, ok`): `ended_at, duration_ms, ok`, null for calls never closed."""
    ends = closes.groupBy(key).agg(F.min_by(F.struct(F.col("at").alias("ended_at"), "ok"), "at").alias("e"))
    out = opens.join(ends, key, "left").select(*opens.columns, "e.*")
    return out.withColumn("duration_ms", F.unix_millis(F.col("ended_at").cast("timestamp")) - F.unix_millis(F.col("at").cast("timestamp")))


def dedupe_calls(calls: DataFrame, key: str = "call_id") -> DataFrame:
    """One record of each call: one from the end event before others, one with a known outcome before others, then the first (`seq`)."""
    rank = F.when(F.col("source") == "end", 2).otherwise(0) + F.when(F.col("ok").isNotNull(), 1).otherwise(0)
    rest = [c for c in calls.columns if c != key]
    return calls.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(rank, -F.col("seq"))).alias("r")).select(key, "r.*")


def tool_stats(calls: DataFrame) -> DataFrame:
    """`tool, total, errors, incomplete, error_rate, mean_ms, p50_ms, p95_ms, max_ms`; percentiles are nearest ranks over finished calls."""
    return calls.groupBy("tool").agg(
        F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("errors"), F.count_if(F.col("ok").isNull()).alias("incomplete"),
        F.floor(F.avg("duration_ms") + 0.5).alias("mean_ms"), nearest_rank("duration_ms", 0.5).alias("p50_ms"), nearest_rank("duration_ms", 0.95).alias("p95_ms"), F.max("duration_ms").alias("max_ms"),
    ).withColumn("error_rate", F.col("errors") / F.col("total"))


def error_groups(calls: DataFrame, text: str = "output") -> DataFrame:
    """`fingerprint, n, tools, first_seen, last_seen` of failed calls."""
    return calls.where("not ok").groupBy(error_fingerprint(F.col(text)).alias("fingerprint")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("tool")).alias("tools"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def breaker_openings(calls: DataFrame, key: str, order: list[str], threshold: int = 3, recover_s: int = 300) -> DataFrame:
    """`key, opened_at, failures, recovers_at`: runs of at least `threshold` failures without a success between them.

    Each run opens the breaker at its `threshold`-th failure.
    """
    w = Window.partitionBy(key).orderBy(*order)
    runs = calls.withColumn("_run", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(w)).where("not ok")
    n = runs.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order)))
    out = n.groupBy(key, "_run").agg(F.max("_n").cast("long").alias("failures"), F.max(F.when(F.col("_n") == threshold, F.col(order[0]))).alias("opened_at")).where(F.col("failures") >= threshold)
    return out.select(key, "opened_at", "failures", (F.col("opened_at") + F.expr(f"interval {recover_s} seconds")).alias("recovers_at"))


def sessions(events: DataFrame, key: str, at: str, gap_minutes: int = 30) -> DataFrame:
    """`key, started_at, ended_at, events`: stretches without a pause of `gap_minutes`."""
    w = F.session_window(F.col(at), f"{gap_minutes} minutes")
    return events.groupBy(key, w.alias("w")).agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count("*").alias("events")).drop("w")
