"""The streaming folds, run over the test tables until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.catalog.ops import SQL as OPS
from quern.catalog.ops import _fault_events
from quern.operators import store as S
from quern.plans.tables import load, shared_root
from quern.streaming import folds
from quern.streaming.run import read_stream, run_once

c = Catalog()


def _events(spark, sf):
    e = read_stream(spark, sf, "events")
    return e.select(F.col("event_id").alias("import_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("user_id") % 5).cast("string").alias("scope"), F.col("event_type").alias("component"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration_ms"), F.col("user_id").cast("string").alias("key"))


@c.query("SELECT CAST(floor(epoch_us(ts) / 86400000000) AS INT) AS day, CAST(user_id % 5 AS VARCHAR) AS scope, event_type AS component, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures, floor(sum(value) * 100 + 0.5) / 100 AS duration_ms FROM events GROUP BY ALL")
def stream_day_buckets(spark, sf):
    out = run_once(folds.day_buckets(_events(spark, sf)), "complete")
    return out.withColumn("duration_ms", F.floor(F.col("duration_ms") * 100 + 0.5) / 100)


@c.query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(min(ts)) AS started_us, count(*) AS events FROM s GROUP BY user_id, n")
def stream_sessions(spark, sf):
    return run_once(folds.sessions(_events(spark, sf), "key", "at"), "complete").select("key", F.unix_micros("started_at").alias("started_us"), "events")


@c.query("SELECT count(*) AS events, count(DISTINCT event_id) AS ids FROM events")
def stream_once(spark, sf):
    """The stream united with itself: every event comes twice and counts once."""
    e = _events(spark, sf)
    out = run_once(folds.once(e.unionByName(_events(spark, sf)), late="60 days"))
    return out.agg(F.count("*").alias("events"), F.count_distinct("import_id").alias("ids"))


SLICES, FILES = 4, 2


def _in_slices(rows, order: str, key: str):
    """`rows` as a stream of SLICES micro-batches in the order of time; each lies in FILES files, told apart by key, so no task writes a slice alone."""
    spark = rows.sparkSession
    rows = rows.where(F.col(order).isNotNull())
    bounds = rows.selectExpr(f"percentile_approx(unix_micros({order}), array({', '.join(str((i + 1) / SLICES) for i in range(SLICES - 1))})) AS b").first()["b"] or []
    path = f"{shared_root(spark)}/quern/{spark.sparkContext.applicationId}/slices-{uuid.uuid4().hex}"
    at = F.unix_micros(order)
    for i in range(len(bounds) + 1):
        part = rows
        if i > 0:
            part = part.where(at > bounds[i - 1])
        if i < len(bounds):
            part = part.where(at <= bounds[i])
        part.repartition(FILES, key).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(path)


@c.query(OPS["fault_states"])
def stream_fault_states(spark, sf):
    """The stateful fold over events that come in several micro-batches, state carried over; equal to the batch fold."""
    stream = _in_slices(_fault_events(spark, sf).select("fingerprint_id", "at", "id", "event"), "at", "fingerprint_id")
    out = run_once(folds.fault_states(stream), "update")
    last = S.latest(out, ["fingerprint_id"], [F.col("batch_id")]).where("state is not null")
    return last.select("fingerprint_id", "state", "total", "regressions", F.timestamp_millis("first_ms").alias("first_seen"), F.timestamp_millis("last_ms").alias("last_seen"))


@c.query("WITH o AS (SELECT event_id // 2 AS call_id, event_type AS tool, ts FROM events WHERE event_id % 2 = 0), e AS (SELECT event_id // 2 AS call_id, ts, value < 100 AS ok FROM events WHERE event_id % 2 = 1 AND event_id % 10 <> 1), w AS (SELECT max(ts) AS seen FROM events) SELECT o.call_id, o.tool, e.ok FROM o LEFT JOIN e ON o.call_id = e.call_id AND e.ts BETWEEN o.ts AND o.ts + INTERVAL 1 HOUR")
def stream_call_pairs(spark, sf):
    """Calls never closed come out too, once the watermark has passed; events far in the future, left out again, move it past the last call."""
    e = read_stream(spark, sf, "events").withColumn("call_id", F.floor(F.col("event_id") / 2)).withColumn("at", F.col("ts").cast("timestamp"))
    far = spark.read.parquet(f"{sf}/events.parquet").limit(1).selectExpr("event_id", "timestamp'2100-01-01' AS at", "event_type", "value").selectExpr("-2L AS call_id", "event_type AS tool", "at", "false AS ok")
    late = _in_slices(far.unionByName(far.withColumn("at", F.col("at") + F.expr("interval 2 days"))), "at", "call_id")
    opens = e.where("event_id % 2 = 0").select("call_id", F.col("event_type").alias("tool"), "at").unionByName(late.select("call_id", "tool", "at"))
    closes = e.where("event_id % 2 = 1 and event_id % 10 <> 1").select("call_id", "at", (F.col("value") < 100).alias("ok")).unionByName(late.select("call_id", "at", "ok"))
    return run_once(folds.paired_calls(opens, closes)).where("call_id >= 0").select("call_id", "tool", "ok")


def _beats(spark, sf):
    """`key, at, kind`: start, heartbeat and end of each session, by project and agent."""
    s = load(spark, sf, "runtime_sessions").where("id is not null").distinct()
    kinds = F.array(F.struct(F.lit("start").alias("kind"), F.col("started_at").alias("at")), F.struct(F.lit("heartbeat").alias("kind"), F.col("heartbeat_at").alias("at")), F.struct(F.lit("end").alias("kind"), F.col("ended_at").alias("at")))
    return s.select(F.concat_ws("|", "project_id", "agent").alias("key"), F.explode(kinds).alias("e")).select("key", "e.*").where("at is not null").distinct()


@c.query("WITH s AS (SELECT DISTINCT * FROM runtime_sessions WHERE id IS NOT NULL), e AS (SELECT concat_ws('|', project_id, agent) AS key, started_at AS t FROM s UNION SELECT concat_ws('|', project_id, agent), heartbeat_at FROM s UNION SELECT concat_ws('|', project_id, agent), ended_at FROM s) SELECT key, epoch_ms(max(t)) AS heartbeat_ms FROM e WHERE t IS NOT NULL GROUP BY 1")
def stream_session_states(spark, sf):
    """The last sign of life of each project and agent, from the stateful fold of its sessions."""
    out = run_once(folds.session_states(_in_slices(_beats(spark, sf), "at", "key")), "update", one_batch=True)
    return out.groupBy("key").agg(F.max("heartbeat_ms").alias("heartbeat_ms"))


@c.query("SELECT 'mirror' AS t, count(*) AS n, count(DISTINCT event_id) AS ids FROM events UNION ALL SELECT 'primary', count(*), count(DISTINCT event_id) FROM events")
def stream_two_writers(spark, sf):
    """Each micro-batch goes to two tables, by batch, so that a repeated one replaces itself."""
    base = f"{shared_root(spark)}/quern/{spark.sparkContext.applicationId}/two-{uuid.uuid4().hex}"
    stream = _in_slices(load(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("at")), "at", "event_id")
    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(folds.to_two(f"{base}/primary", f"{base}/mirror")).start().awaitTermination()
    counted = [spark.read.parquet(f"{base}/{t}").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids")).select(F.lit(t).alias("t"), "n", "ids") for t in ("primary", "mirror")]
    return counted[0].unionByName(counted[1])


QUERIES, SQL = c.QUERIES, c.SQL
