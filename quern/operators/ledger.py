"""The event ledger: buckets, fault states, bounded samples, retention and sessions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vocab as V
from quern.plans.skew import hot_keys, salted_join

DAY_MS = 86_400_000
STATES = list(V.FAULT_MOVES)


def day_of(ts: Column) -> Column:
    return F.floor(F.unix_millis(ts) / DAY_MS).cast("int")


def day_buckets(events: DataFrame, at: str = "at", keys: tuple[str, ...] = ("scope", "component")) -> DataFrame:
    """`day, keys, successes, failures, duration_ms` from events with `ok, duration_ms`."""
    return events.groupBy(day_of(F.col(at)).alias("day"), *keys).agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.sum("duration_ms").alias("duration_ms"))


def totals(buckets: DataFrame, key: str = "scope") -> DataFrame:
    return buckets.groupBy(key).agg(F.sum("successes").alias("successes"), F.sum("failures").alias("failures"), F.sum("duration_ms").alias("duration_ms"))


def health(rows: DataFrame) -> DataFrame:
    """`rows` (`successes, failures`) with `failure_rate` and `score`, 0 and 100 without events."""
    n = F.col("successes") + F.col("failures")
    return rows.withColumn("failure_rate", F.when(n == 0, 0.0).otherwise(F.col("failures") / n)).withColumn("score", F.when(n == 0, 100).otherwise(F.floor(100 * F.col("successes") / n + 0.5)))


def safe_metadata(component: Column, phase: Column, category: Column, duration: Column) -> Column:
    """Metadata with anything outside the allowed values replaced, duration within a day."""
    allow = lambda c, values, default: F.when(c.isin(values), c).otherwise(default)
    return F.struct(allow(component, V.FAULT_COMPONENTS, "runtime").alias("component"), allow(phase, V.FAULT_PHASES, "request").alias("phase"), allow(category, V.FAULT_CATEGORIES, "internal").alias("category"), F.greatest(F.lit(0), F.least(F.lit(DAY_MS), F.floor(F.coalesce(duration, F.lit(0)) + 0.5))).cast("long").alias("duration_ms"))


def fingerprint(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("fault-v1"), *[F.coalesce(f, F.lit("")) for f in fields]), 256)


def operation_state(category: Column) -> Column:
    return F.when(category == "expected", "FAILED_EXPECTED").when(category == "timeout", "TIMED_OUT").when(category == "cancelled", "CANCELLED").when(category == "dependency", "FAILED_DEPENDENCY").otherwise("FAILED_INTERNAL")


def late_results(operations: DataFrame, events: DataFrame) -> DataFrame:
    """Timed-out operations that still wait (`id, late_state`) with the first late result (`id, at, result`), once only."""
    first = events.groupBy("id").agg(F.min_by("result", F.struct("at", "result")).alias("result"))
    waits = (F.col("state") == "TIMED_OUT") & F.col("late_state").isin("NONE", "PENDING_AFTER_TIMEOUT")
    out = operations.join(first, "id", "left")
    return out.withColumn("late_state", F.when(waits & F.col("result").isNotNull(), F.concat(F.lit("LATE_"), F.col("result"))).otherwise(F.col("late_state"))).drop("result")


@lru_cache(maxsize=None)
def next_state(state: str | None, event: str) -> tuple[str, int]:
    """State after an event, and whether a fault came back.  Events: 'occurrence', or the state asked for by hand (illegal ones change nothing)."""
    if state is None:
        return ("NEW", 0) if event == "occurrence" else (None, 0)
    if event == "occurrence":
        return ("REGRESSED", 1) if state in ("VERIFIED_FIXED", "CLOSED") else (state, 0)
    return (event, 0) if event in V.FAULT_MOVES[state].split() else (state, 0)


#: Events by number: none, an occurrence, then the states asked for; and what each makes of each state (0: not seen yet).
EVENTS = ["occurrence", *STATES]


def _tables() -> tuple[list[int], list[int]]:
    starts = [None, *STATES]
    moves = [(i, 0) if e is None else (lambda r: (starts.index(r[0]), r[1]))(next_state(s, e)) for i, s in enumerate(starts) for e in [None, *EVENTS]]
    return [m[0] for m in moves], [m[1] for m in moves]


def fault_states(events: DataFrame, key: str = "fingerprint_id") -> DataFrame:
    """`key, state, total, regressions, first_seen, last_seen` from events (`key, at, id, event`) in the order of time and id.

    A stretch of events is a mapping from the state before to the state after, and mappings compose: the
    days of all faults are folded first, in parallel, and then the days of each fault, whose number is bounded by the
    calendar.  Rows without key or time do not count; an event that isn't known changes nothing.
    """
    after, back = (F.array(*[F.lit(x) for x in t]) for t in _tables())
    n, width = len(STATES) + 1, len(EVENTS) + 1
    number = F.coalesce(F.array_position(F.array(*[F.lit(e) for e in EVENTS]), F.col("event")), F.lit(0)).cast("int")
    rows = events.where(F.col(key).isNotNull() & F.col("at").isNotNull()).select(key, "at", "id", number.alias("e"), day_of(F.col("at")).alias("day"))
    seen = F.when(F.col("e") == 1, F.col("at"))
    daily = rows.groupBy(key, "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "e"))), lambda x: x["e"]).alias("es"), F.count_if(F.col("e") == 1).alias("total"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))
    at = lambda s, e: s * width + e + 1
    start = F.struct(F.array(*[F.lit(i) for i in range(n)]).alias("to"), F.array_repeat(F.lit(0), n).alias("again"))
    step = lambda acc, e: F.struct(F.transform(acc["to"], lambda s: F.element_at(after, at(s, e))).alias("to"), F.zip_with(acc["again"], acc["to"], lambda g, s: g + F.element_at(back, at(s, e))).alias("again"))
    mapped = daily.select(key, "day", F.aggregate("es", start, step).alias("m"), "total", "first_seen", "last_seen")
    whole = mapped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("day", "m"))).alias("ms"), F.sum("total").alias("total"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    none = F.struct(F.lit(0).alias("s"), F.lit(0).alias("g"))
    join = lambda acc, x: F.struct(F.element_at(x["m"]["to"], acc["s"] + 1).alias("s"), (acc["g"] + F.element_at(x["m"]["again"], acc["s"] + 1)).alias("g"))
    end = whole.withColumn("end", F.aggregate("ms", none, join)).where("end.s > 0")
    return end.select(key, F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("end.s")).alias("state"), "total", F.col("end.g").cast("long").alias("regressions"), "first_seen", "last_seen")


def bounded_sample(rows: DataFrame, regressions: DataFrame | None = None, key: str = "fingerprint_id", most: int = 5) -> DataFrame:
    """At most `most` rows of each key, with `why`: the first, the last, the slowest, the first since its first regression, the smallest id, then the newest.

    `regressions` (`key, at`): when a fault came back.  All but the newest are plain aggregates with partial sums; only the newest
    few of each key are ranked.
    """
    row = F.struct("at", "id", "duration_ms")
    since = rows.sparkSession.createDataFrame([], f"{key} string, back timestamp") if regressions is None else regressions.groupBy(key).agg(F.min("at").alias("back"))
    rows = rows.join(since, key, "left")
    after = F.when(F.col("at") >= F.col("back"), F.struct("at", "id"))
    four = rows.groupBy(key).agg(F.min_by(row, F.struct("at", "id")).alias("a"), F.max_by(row, F.struct("at", "id")).alias("b"), F.max_by(row, F.struct("duration_ms", "at", "id")).alias("c"), F.min_by(row, after).alias("d"), F.min_by(row, "id").alias("e"))
    picked = four.select(key, F.explode(F.array(*[F.struct(F.col(f"{c}.id").alias("id"), F.lit(i).alias("p")) for i, c in enumerate("abcde")])).alias("x")).select(key, "x.*").where("id is not null")
    newest = rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("at").desc(), F.col("id").desc()))).where(F.col("n") <= most).select(key, "id", (F.col("n") + 10).alias("p"))
    both = picked.unionByName(newest).groupBy(key, "id").agg(F.min("p").alias("p"))
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("p", "id"))).where(F.col("n") <= most)
    return ranked.select(key, "id", F.element_at(F.array(*map(F.lit, ("first", "last", "slowest", "first since regression", "smallest id", "newest"))), F.least(F.col("p"), F.lit(5)).cast("int") + 1).alias("why"))


def retained(rows: DataFrame, at: str, as_of: str, days: int = 30, most: int | None = None) -> DataFrame:
    """Rows of the last `days` days, of these the newest `most`."""
    kept = rows.where(F.col(at) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))
    return kept.orderBy(F.col(at).desc(), F.col("id").desc()).limit(most) if most else kept


def compacted(buckets: DataFrame, first_day: int) -> tuple[DataFrame, DataFrame]:
    """Buckets from `first_day` on, and the counts of the others added up (`pruned_successes, pruned_failures`) by scope."""
    old = buckets.where(F.col("day") < first_day).groupBy("scope").agg(F.sum("successes").alias("pruned_successes"), F.sum("failures").alias("pruned_failures"))
    return buckets.where(F.col("day") >= first_day), old


def evictable(faults: DataFrame, most: int) -> DataFrame:
    """The longest unseen faults over the limit, only those that are ignored, closed or verified."""
    n = faults.count()
    done = faults.where(F.col("state").isin("IGNORED", "CLOSED", "VERIFIED_FIXED"))
    return done.orderBy("last_seen", "fingerprint_id").limit(max(0, n - most))


def abandoned(sessions: DataFrame, minutes: int = 30) -> DataFrame:
    """Sessions with `status`: an open stable one is ABANDONED if its last heartbeat lies more than `minutes` before any later start of its project and agent.

    The latest start of each project and agent decides, which is one aggregate; sessions without project or agent meet no other.
    """
    own = F.struct("started_at", "id")
    keyed = sessions.withColumn("_k", F.when(F.col("project_id").isNotNull() & F.col("agent").isNotNull(), F.concat_ws("\u0001", "project_id", "agent")))
    starts = keyed.where("_k is not null").groupBy("_k").agg(F.max(own).alias("_last"), F.count("*").alias("n"))
    hot = hot_keys(starts, "_k")
    out = salted_join(keyed, starts.drop("n"), "_k", hot, F.col("id"), "left")
    stale = (F.col("_last") > own) & (F.col("heartbeat_at") < F.col("_last.started_at") - F.expr(f"interval {minutes} minutes"))
    status = F.when((F.col("kind") == "stable") & F.col("ended_at").isNull() & F.coalesce(stale, F.lit(False)), "ABANDONED").when(F.col("ended_at").isNotNull(), "CLOSED").otherwise("OPEN")
    return out.withColumn("status", status).drop("_k", "_last")


def incident_drafts(faults: DataFrame) -> DataFrame:
    """Observations of an incident for each fault that is verified as fixed: `fingerprint_id, ord, text`."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    texts = F.array(line("SYMPTOM", F.col("fingerprint_id")), line("TOTAL", F.col("total").cast("string")), line("REGRESSIONS", F.col("regressions").cast("string")), line("STATE", F.col("state")))
    return faults.where("state = 'VERIFIED_FIXED'").select("fingerprint_id", F.posexplode(texts).alias("ord", "text"))


def within_budget(events: DataFrame, most: int, key: str = "fingerprint_id", at: str = "at") -> DataFrame:
    """`key, total, detailed`: every fault counts, but only the first `most` that appear keep more than their total.

    The first ones are a distributed top-n over one row for each fault.
    """
    each = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("total"), F.min(at).alias("_first"))
    first = each.orderBy(F.col("_first").asc_nulls_last(), key).limit(most).select(key, F.lit(True).alias("detailed"))
    return each.join(first, key, "left").select(key, "total", F.coalesce("detailed", F.lit(False)).alias("detailed"))


def retention(samples: DataFrame, buckets: DataFrame, faults: DataFrame, sessions: DataFrame, linked: DataFrame, as_of: str, most_samples: int = 2000, most_faults: int = 5000, days: int = 30, bucket_days: int = 365) -> dict[str, DataFrame]:
    """One pass of retention: what is kept of each table, and the counts of the buckets that go.

    Samples (`id, created_at`) of the last `days`, of these the newest; buckets (`scope, day, successes, failures`) of the last `bucket_days`, the
    others added up by scope in 'pruned'; faults (`fingerprint_id, state, last_seen`) up to their number, the longest unseen go first and only
    if they are ignored, closed or verified and not `linked` (`fingerprint_id`) to an incident; sessions (`id, heartbeat_at`) with a sign of life in the last `days`.
    """
    now = F.lit(as_of).cast("timestamp")
    last = F.datediff(now, F.lit("1970-01-01")) - bucket_days
    old = buckets.where(F.col("day") < last)
    pruned = old.groupBy("scope").agg(F.sum("successes").alias("pruned_successes"), F.sum("failures").alias("pruned_failures"))
    free = faults.join(linked.select("fingerprint_id").distinct(), "fingerprint_id", "left_anti").where(F.col("state").isin("IGNORED", "CLOSED", "VERIFIED_FIXED"))
    over = max(0, faults.count() - most_faults)
    gone = free.orderBy("last_seen", "fingerprint_id").limit(over).select("fingerprint_id")
    return {
        "samples": retained(samples, "created_at", as_of, days, most_samples),
        "buckets": buckets.where(F.col("day") >= last),
        "pruned": pruned,
        "faults": faults.join(gone, "fingerprint_id", "left_anti"),
        "sessions": sessions.where(F.col("heartbeat_at") >= now - F.expr(f"interval {days} days")),
    }
