"""Queries of graph traversal, logs, the event ledger and synchronisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.catalog.store import _SIDES, ENT, OBS, REL, _sides, entities, observations, relations
from quern.functions import text as X
from quern.functions import vocab as V
from quern.operators import graph as G
from quern.operators import ledger as E
from quern.operators import logs as LG
from quern.operators import store as S
from quern.operators import sync as Y
from quern.plans.tables import load

c = Catalog()
AS_OF_DAY = 20_550


# --- graph: entities as symbols, relations as calls ---


def _edges(spark, sf):
    return relations(spark, sf).where("from_name is not null and to_name is not null and trim(from_name) <> '' and trim(to_name) <> ''").select(F.col("from_name").alias("src"), F.col("to_name").alias("dst"))


def _symbols(spark, sf):
    e = entities(spark, sf).where("name is not null")
    one = S.latest(e.select("name", "id", "entity_type", "lifecycle"), ["name"], [F.col("id")])
    part = lambda n: F.coalesce(F.try_element_at(F.split("name", ":"), F.lit(n)), F.lit("x"))
    return one.select(F.col("name").alias("id"), part(3).alias("name"), F.concat(F.lit("src/"), F.lower(part(2)), F.lit("/"), F.lower(part(1)), F.lit(".ts")).alias("file"), F.when(F.col("entity_type").like("tech%"), "function").when(F.col("entity_type").like("biz%"), "method").otherwise("class").alias("kind"), (F.col("lifecycle") == "active").alias("exported"))


def _targets(spark, sf):
    return entities(spark, sf).where("entity_type = 'tech-stack'").select(F.col("name").alias("start")).distinct()


_G = f"""{ENT}, {REL}, edges AS (SELECT from_name AS src, to_name AS dst FROM rel WHERE trim(from_name) <> '' AND trim(to_name) <> ''), targets AS (SELECT DISTINCT name AS start FROM ent WHERE entity_type = 'tech-stack'),
 sym0 AS (SELECT * FROM ent WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY id DESC) = 1), sym AS (SELECT name AS id, coalesce(nullif(split_part(name, ':', 3), ''), 'x') AS name, 'src/' || lower(coalesce(nullif(split_part(name, ':', 2), ''), 'x')) || '/' || lower(split_part(name, ':', 1)) || '.ts' AS file, CASE WHEN entity_type LIKE 'tech%' THEN 'function' WHEN entity_type LIKE 'biz%' THEN 'method' ELSE 'class' END AS kind, lifecycle = 'active' AS exported FROM sym0)"""
_BOTH = "und AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"
_UP = "up AS (SELECT DISTINCT dst AS src, src AS dst FROM edges WHERE src <> dst)"


def _bfs(edges: str, depth: int, passable: str = "") -> str:
    hops = [f"h0 AS (SELECT start, start AS node FROM targets), s0 AS (SELECT * FROM h0)"]  # noqa: F541
    for d in range(1, depth + 1):
        hops.append(f"h{d} AS (SELECT DISTINCT h.start, e.dst AS node FROM h{d - 1} h JOIN {edges} e ON e.src = h.node {passable} EXCEPT SELECT * FROM s{d - 1}), s{d} AS (SELECT * FROM s{d - 1} UNION SELECT * FROM h{d})")
    return ", ".join(hops) + ", bfs AS (" + " UNION ALL ".join(f"SELECT *, {d} AS depth FROM h{d}" for d in range(1, depth + 1)) + ")"


@c.query(f"WITH {_G}, {_BOTH}, {_bfs('und', 2)} SELECT start, node, depth FROM bfs")
def related_depth_2(spark, sf):
    return G.related(_edges(spark, sf), _targets(spark, sf), 2)


_LOWER = """low AS (SELECT lower(from_name) AS src, lower(to_name) AS dst FROM rel WHERE trim(from_name) <> '' AND trim(to_name) <> '' AND relation_type = 'depends_on'), lund AS (SELECT src, dst FROM low WHERE src <> dst UNION SELECT dst, src FROM low WHERE src <> dst),
 spell AS (SELECT lower(n) AS node, min(n) AS n FROM (SELECT from_name AS n FROM rel WHERE trim(from_name) <> '' AND trim(to_name) <> '' AND relation_type = 'depends_on' UNION ALL SELECT to_name FROM rel WHERE trim(from_name) <> '' AND trim(to_name) <> '' AND relation_type = 'depends_on') GROUP BY 1)"""


@c.query(f"WITH {_G}, {_LOWER}, {_bfs('lund', 5).replace('start AS node FROM targets', 'node FROM (SELECT DISTINCT lower(start) AS start, lower(start) AS node FROM targets)')} SELECT b.start, s.n AS node, b.depth FROM bfs b JOIN spell s ON s.node = b.node")
def related_typed(spark, sf):
    """Five hops along one type of relation, letter case ignored."""
    r = relations(spark, sf).where("trim(from_name) <> '' and trim(to_name) <> ''").select(F.col("from_name").alias("src"), F.col("to_name").alias("dst"), F.col("relation_type").alias("kind"))
    return G.related_typed(r, _targets(spark, sf), 5, "depends_on")


@c.query(f"WITH {_G}, {_BOTH}, {_bfs('und', 3, 'JOIN sym ON sym.id = e.dst')} SELECT start, node, depth, floor(0.95::DOUBLE * pow(0.9::DOUBLE, depth - 1) * 100 + 0.5) / 100 AS confidence FROM bfs")
def blast_both(spark, sf):
    return G.blast_radius(_edges(spark, sf), _symbols(spark, sf), _targets(spark, sf), "both")


@c.query(f"WITH {_G}, dn AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), {_bfs('dn', 3, 'JOIN sym ON sym.id = e.dst')} SELECT start, node, depth, floor(0.95::DOUBLE * pow(0.9::DOUBLE, depth - 1) * 100 + 0.5) / 100 AS confidence FROM bfs")
def blast_downstream(spark, sf):
    return G.blast_radius(_edges(spark, sf), _symbols(spark, sf), _targets(spark, sf), "downstream")


@c.query(f"WITH {_G}, ce AS (SELECT DISTINCT to_name AS src, from_name AS dst FROM rel WHERE trim(from_name) <> '' AND trim(to_name) <> '' AND from_name <> to_name AND relation_type = 'uses'), {_bfs('ce', 3)}, n AS (SELECT t.start, count(*) FILTER (depth = 1) AS d1, count(*) FILTER (depth = 2) AS d2, count(*) FILTER (depth = 3) AS d3 FROM targets t LEFT JOIN bfs b ON b.start = t.start GROUP BY 1) SELECT *, CASE WHEN d1 > 5 THEN 'HIGH' WHEN d1 > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM n")
def impact_of_calls(spark, sf):
    """The quick check: edges of one kind only."""
    r = relations(spark, sf).where("trim(from_name) <> '' and trim(to_name) <> ''").select(F.col("from_name").alias("src"), F.col("to_name").alias("dst"), F.col("relation_type").alias("kind"))
    return G.impact_counts(r, _targets(spark, sf), kinds=["uses"])


@c.query(f"WITH {_G}, k AS (SELECT DISTINCT from_name AS src, to_name AS dst, relation_type AS kind FROM rel WHERE trim(from_name) <> '' AND trim(to_name) <> '' AND from_name <> to_name) SELECT dst AS start, 'caller' AS side, src AS node, kind FROM k WHERE dst IN (SELECT start FROM targets) UNION ALL SELECT src, 'callee', dst, kind FROM k WHERE src IN (SELECT start FROM targets)")
def incident_relations(spark, sf):
    r = relations(spark, sf).where("trim(from_name) <> '' and trim(to_name) <> ''").select(F.col("from_name").alias("src"), F.col("to_name").alias("dst"), F.col("relation_type").alias("kind"))
    return G.incident_relations(r, _targets(spark, sf))


@c.query(f"WITH {_G}, {_UP}, {_bfs('up', 3, 'JOIN sym ON sym.id = e.dst')} SELECT start, node, depth, floor(0.95::DOUBLE * pow(0.9::DOUBLE, depth - 1) * 100 + 0.5) / 100 AS confidence FROM bfs")
def blast_radius(spark, sf):
    return G.blast_radius(_edges(spark, sf), _symbols(spark, sf), _targets(spark, sf))


@c.query(f"WITH {_G}, {_UP}, {_bfs('up', 3)}, n AS (SELECT t.start, count(*) FILTER (depth = 1) AS d1, count(*) FILTER (depth = 2) AS d2, count(*) FILTER (depth = 3) AS d3 FROM targets t LEFT JOIN bfs b ON b.start = t.start GROUP BY 1) SELECT *, CASE WHEN d1 > 5 THEN 'HIGH' WHEN d1 > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM n")
def impact_counts(spark, sf):
    return G.impact_counts(_edges(spark, sf), _targets(spark, sf))


@c.query(f"WITH {_G}, d AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst) SELECT start, (SELECT count(*) FROM d WHERE d.dst = start) AS callers, (SELECT count(*) FROM d WHERE d.src = start) AS callees FROM targets")
def symbol_context(spark, sf):
    return G.symbol_context(_edges(spark, sf), _targets(spark, sf))


@c.query(f"WITH {_G}, g AS (SELECT id FROM sym WHERE file LIKE '%/tech.ts') SELECT (SELECT count(*) FROM sym WHERE file NOT LIKE '%/tech.ts') AS symbols, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)) AS edges")
def subgraph_removal(spark, sf):
    sym = _symbols(spark, sf)
    s, e = G.without_files(sym, _edges(spark, sf), sym.select("file").where("file like '%/tech.ts'").distinct())
    return s.agg(F.count("*").alias("symbols")).crossJoin(e.agg(F.count("*").alias("edges")))


@c.query(f"WITH {_G}, {_BOTH}, {_bfs('und', 1)} SELECT start, node FROM bfs QUALIFY row_number() OVER (PARTITION BY start ORDER BY node) <= 3")
def one_hop_expansion(spark, sf):
    return G.one_hop(_edges(spark, sf), _targets(spark, sf))


_ENTRY = """d AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), cx AS (SELECT s.*, (SELECT count(*) FROM d WHERE d.dst = s.id) AS callers, (SELECT count(*) FROM d WHERE d.src = s.id) AS callees, lower(s.name) AS n, lower(s.file) AS f FROM sym s WHERE kind IN ('function', 'method')),
 en AS (SELECT id, name, exported::INT + (callers = 0)::INT * 2 + regexp_matches(n, '^(handle|on)')::INT * 2 + regexp_matches(n, '^(register|setup|init)')::INT * 2 + regexp_matches(n, '^(run|start|main)')::INT * 3 + regexp_matches(n, '^(process|execute)')::INT + regexp_matches(n, 'route|endpoint|handler')::INT * 2 + regexp_matches(n, 'middleware|plugin')::INT + regexp_matches(f, '(index|main|app)\\.')::INT + regexp_matches(f, '(server|cli)\\.|handler')::INT + (callees >= 3)::INT AS score FROM cx)"""


@c.query(f"WITH {_G}, {_ENTRY} SELECT * FROM en WHERE score > 0 ORDER BY score DESC, id LIMIT 50")
def entry_points(spark, sf):
    return G.entry_points(_symbols(spark, sf), _edges(spark, sf))


@c.query()
def process_detection(spark, sf):
    return G.processes(_symbols(spark, sf), _edges(spark, sf))


@c.query(f"WITH {_G} SELECT file, count(*) AS n, count(*) FILTER (exported) AS exported FROM sym GROUP BY 1")
def container_members(spark, sf):
    return _symbols(spark, sf).groupBy("file").agg(F.count("*").alias("n"), F.count_if("exported").alias("exported"))


@c.query(f"WITH {OBS}, refs AS (SELECT unnest(regexp_extract_all(o.text, '[A-Za-z][\\w./-]*\\.(?:mjs|ts|sql|py)')) AS path FROM obs o) SELECT path, count(*) AS n FROM refs GROUP BY 1")
def rules_by_file(spark, sf):
    o = observations(spark, sf)
    return o.select(F.explode(X.all_matches(F.col("text"), r"[A-Za-z][\w./-]*\.(?:mjs|ts|sql|py)")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


# --- logs: events as tool calls ---


def _calls(spark, sf):
    e = load(spark, sf, "events")
    return e.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), F.col("ts").alias("at"), F.col("user_id").alias("session"), F.col("value").alias("duration_ms"), F.when(F.col("event_id") % 13 == 0, None).otherwise(F.col("event_type") != "error").alias("ok"), F.concat(F.lit("Error: "), F.col("props"), F.lit(" at /srv/app/x.js")).alias("output"))


_CALLS = "calls AS (SELECT event_id AS call_id, event_type AS tool, ts AS at_, user_id AS session, value AS duration_ms, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type <> 'error' END AS ok, 'Error: ' || props || ' at /srv/app/x.js' AS output FROM events)"


@c.query("WITH o AS (SELECT event_id // 2 AS call_id, event_type AS tool, ts AS at FROM events WHERE event_id % 2 = 0), e AS (SELECT event_id // 2 AS call_id, ts AS ended_at, value < 100 AS ok FROM events WHERE event_id % 2 = 1 AND event_id % 10 <> 1) SELECT o.call_id, o.tool, o.at, e.ended_at, e.ok, epoch_us(e.ended_at) // 1000 - epoch_us(o.at) // 1000 AS duration_ms FROM o LEFT JOIN e USING (call_id)")
def call_pairing(spark, sf):
    e = load(spark, sf, "events").withColumn("call_id", F.floor(F.col("event_id") / 2))
    opens = e.where("event_id % 2 = 0").select("call_id", F.col("event_type").alias("tool"), F.col("ts").alias("at"))
    closes = e.where("event_id % 2 = 1 and event_id % 10 <> 1").select("call_id", F.col("ts").alias("at"), (F.col("value") < 100).alias("ok"))
    return LG.pair_calls(opens, closes)


@c.query("WITH r AS (SELECT event_id % 5000 AS call_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'end' ELSE 'start' END AS source, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type <> 'error' END AS ok FROM events) SELECT call_id, seq, source, ok FROM r QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY (CASE WHEN source = 'end' THEN 2 ELSE 0 END + CASE WHEN ok IS NOT NULL THEN 1 ELSE 0 END) DESC, seq) = 1")
def call_dedupe(spark, sf):
    e = load(spark, sf, "events")
    rows = e.select((F.col("event_id") % 5000).alias("call_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "end").otherwise("start").alias("source"), F.when(F.col("event_id") % 4 != 0, F.col("event_type") != "error").alias("ok"))
    return LG.dedupe_calls(rows)


@c.query(f"WITH {_CALLS} SELECT tool, count(*) AS total, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (ok IS NULL) AS incomplete, CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS mean_ms, quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms, max(duration_ms) AS max_ms, count(*) FILTER (NOT ok) / count(*)::DOUBLE AS error_rate FROM calls GROUP BY 1")
def tool_stats(spark, sf):
    return LG.tool_stats(_calls(spark, sf))


@c.query(f"WITH {_CALLS} SELECT substr(trim(regexp_replace(regexp_replace(output, '/[^\\s''\"]{{4,}}', '<path>', 'g'), '\\b\\d+\\b', '<n>', 'g')), 1, 160) AS fingerprint, count(*) AS n, list_sort(list(DISTINCT tool)) AS tools, min(at_) AS first_seen, max(at_) AS last_seen FROM calls WHERE NOT ok GROUP BY 1")
def error_groups(spark, sf):
    return LG.error_groups(_calls(spark, sf))


@c.query(f"WITH {_CALLS}, r AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY at_, call_id) AS run FROM calls WHERE ok IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY at_, call_id) AS n FROM r WHERE NOT ok) SELECT session, max(CASE WHEN n = 3 THEN at_ END) AS opened_at, count(*) AS failures, max(CASE WHEN n = 3 THEN at_ END) + INTERVAL 300 SECOND AS recovers_at FROM f GROUP BY session, run HAVING count(*) >= 3")
def circuit_breaker(spark, sf):
    return LG.breaker_openings(_calls(spark, sf).where("ok is not null"), "session", ["at", "call_id"])


@c.query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events FROM s GROUP BY user_id, n")
def sessionize(spark, sf):
    return LG.sessions(load(spark, sf, "events"), "user_id", "ts")


# --- ledger ---


def _operations(spark, sf):
    o = load(spark, sf, "diag_operation").where("id is not null")
    return S.latest(o, ["id"], [F.col("created_at").isNull(), -F.unix_micros("created_at"), F.col("parent_id"), F.col("state")])


_OPS = "ops AS (SELECT * FROM diag_operation WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"


@c.query(f"WITH {_OPS} SELECT CAST(floor(epoch_ms(created_at) / 86400000) AS INT) AS day, state AS component, count(*) FILTER (late_state = 'LATE_SUCCEEDED') AS successes, count(*) FILTER (NOT late_state = 'LATE_SUCCEEDED') AS failures, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM ops GROUP BY ALL")
def day_buckets(spark, sf):
    o = _operations(spark, sf).select(F.col("created_at").alias("at"), F.col("state").alias("component"), (F.col("late_state") == "LATE_SUCCEEDED").alias("ok"), "duration_ms")
    return E.day_buckets(o, keys=("component",))


def _buckets(spark, sf):
    return load(spark, sf, "diag_bucket").dropDuplicates(["import_id"]).where("day is not null and component is not null")


_BK = "bk AS (SELECT DISTINCT ON (import_id) * FROM diag_bucket WHERE day IS NOT NULL AND component IS NOT NULL)"


@c.query(f"WITH {_BK}, t AS (SELECT scope, CAST(sum(successes) AS BIGINT) AS successes, CAST(sum(failures) AS BIGINT) AS failures, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM bk GROUP BY 1), n AS (SELECT *, successes + failures AS n FROM t) SELECT scope, successes, failures, duration_ms, CASE WHEN n = 0 THEN 0 ELSE failures / n::DOUBLE END AS failure_rate, CAST(CASE WHEN n = 0 THEN 100 ELSE floor(100.0::DOUBLE * successes / n + 0.5) END AS BIGINT) AS score FROM n")
def runtime_health(spark, sf):
    return E.health(E.totals(_buckets(spark, sf)))


def _late(spark, sf):
    o = load(spark, sf, "diag_operation").where("id is not null and late_state like 'LATE%'")
    return o.select("id", F.col("created_at").alias("at"), F.substring("late_state", 6, 99).alias("result"))


@c.query(f"WITH {_OPS}, ev AS (SELECT id, first(substr(late_state, 6) ORDER BY created_at, substr(late_state, 6)) AS result FROM diag_operation WHERE late_state LIKE 'LATE%' GROUP BY 1) SELECT o.id, o.state, CASE WHEN o.state = 'TIMED_OUT' AND o.late_state IN ('NONE', 'PENDING_AFTER_TIMEOUT') AND ev.result IS NOT NULL THEN 'LATE_' || ev.result ELSE o.late_state END AS late_state FROM ops o LEFT JOIN ev USING (id)")
def late_results(spark, sf):
    return E.late_results(_operations(spark, sf), _late(spark, sf)).select("id", "state", "late_state")


def _fault_events(spark, sf):
    o = _operations(spark, sf).where("fingerprint_id is not null")
    pick = F.element_at(F.array(*[F.lit(s) for s in E.STATES]), (F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % len(E.STATES)) + 1)
    return o.select("fingerprint_id", F.col("created_at").alias("at"), "id", F.when(F.col("state").isin("FAILED_INTERNAL", "TIMED_OUT"), "occurrence").otherwise(pick).alias("event"), "duration_ms")


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, bs in V.FAULT_MOVES.items() for b in bs.split())
_EV = f"{_OPS}, ev AS (SELECT fingerprint_id, created_at AS at_, id, CASE WHEN state IN ('FAILED_INTERNAL', 'TIMED_OUT') THEN 'occurrence' ELSE {E.STATES!r}[('0x' || substr(id, 1, 2))::INT % {len(E.STATES)} + 1] END AS event, duration_ms FROM ops WHERE fingerprint_id IS NOT NULL)"


@c.query(f"""WITH RECURSIVE {_EV}, n AS (SELECT *, row_number() OVER (PARTITION BY fingerprint_id ORDER BY at_, id) AS i FROM ev), fold AS (SELECT fingerprint_id, 0::BIGINT AS i, NULL::VARCHAR AS state, 0::BIGINT AS regressions FROM n WHERE i = 1
 UNION ALL SELECT f.fingerprint_id, n.i, CASE WHEN n.event = 'occurrence' THEN CASE WHEN f.state IS NULL THEN 'NEW' WHEN f.state IN ('VERIFIED_FIXED', 'CLOSED') THEN 'REGRESSED' ELSE f.state END WHEN (f.state, n.event) IN ({_LEGAL}) THEN n.event ELSE f.state END, f.regressions + CASE WHEN n.event = 'occurrence' AND f.state IN ('VERIFIED_FIXED', 'CLOSED') THEN 1 ELSE 0 END FROM fold f JOIN n ON n.fingerprint_id = f.fingerprint_id AND n.i = f.i + 1),
 l AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY fingerprint_id ORDER BY i DESC) = 1) SELECT l.fingerprint_id, l.state, count(*) FILTER (event = 'occurrence') AS total, l.regressions, min(CASE WHEN event = 'occurrence' THEN at_ END) AS first_seen, max(CASE WHEN event = 'occurrence' THEN at_ END) AS last_seen FROM l JOIN ev ON ev.fingerprint_id = l.fingerprint_id WHERE l.state IS NOT NULL GROUP BY ALL""")
def fault_states(spark, sf):
    return E.fault_states(_fault_events(spark, sf))


@c.query(f"""WITH {_EV}, back AS (SELECT fingerprint_id, min(at_) AS back FROM ev WHERE event = 'REGRESSED' GROUP BY 1), p AS (SELECT ev.fingerprint_id, first(id ORDER BY at_, id) AS a, first(id ORDER BY at_ DESC, id DESC) AS b, first(id ORDER BY duration_ms DESC NULLS LAST, at_ DESC, id DESC) AS c, first(id ORDER BY at_, id) FILTER (at_ >= back) AS r, min(id) AS d FROM ev LEFT JOIN back ON back.fingerprint_id = ev.fingerprint_id GROUP BY 1),
 u AS (SELECT fingerprint_id, a AS id, 0 AS p FROM p UNION ALL SELECT fingerprint_id, b, 1 FROM p UNION ALL SELECT fingerprint_id, c, 2 FROM p UNION ALL SELECT fingerprint_id, r, 3 FROM p WHERE r IS NOT NULL UNION ALL SELECT fingerprint_id, d, 4 FROM p UNION ALL SELECT fingerprint_id, id, 10 + n FROM (SELECT fingerprint_id, id, row_number() OVER (PARTITION BY fingerprint_id ORDER BY at_ DESC, id DESC) AS n FROM ev) WHERE n <= 5),
 m AS (SELECT fingerprint_id, id, min(p) AS p FROM u GROUP BY ALL) SELECT fingerprint_id, id, ['first', 'last', 'slowest', 'first since regression', 'smallest id', 'newest'][least(p, 5) + 1] AS why FROM m QUALIFY row_number() OVER (PARTITION BY fingerprint_id ORDER BY p, id) <= 5""")
def bounded_sample(spark, sf):
    e = _fault_events(spark, sf)
    return E.bounded_sample(e, e.where("event = 'REGRESSED'").select("fingerprint_id", "at"))


@c.query(f"WITH {_OPS} SELECT id, created_at FROM ops WHERE created_at >= TIMESTAMPTZ '2026-06-01 00:00:00+00' - INTERVAL 90 DAY ORDER BY created_at DESC, id DESC LIMIT 100")
def retention_newest(spark, sf):
    return E.retained(_operations(spark, sf), "created_at", "2026-06-01", 90, 100).select("id", "created_at")


@c.query(f"WITH {_BK} SELECT scope, CAST(sum(successes) AS BIGINT) AS pruned_successes, CAST(sum(failures) AS BIGINT) AS pruned_failures FROM bk WHERE day < {AS_OF_DAY - 365} GROUP BY 1")
def bucket_compaction(spark, sf):
    return E.compacted(_buckets(spark, sf), AS_OF_DAY - 365)[1]


@c.query(f"WITH {_EV} SELECT fingerprint_id, id FROM ev WHERE event <> 'occurrence' QUALIFY row_number() OVER (PARTITION BY fingerprint_id ORDER BY at_ DESC, id DESC) <= 32")
def transition_cap(spark, sf):
    return S.keep_newest(_fault_events(spark, sf).where("event <> 'occurrence'"), [F.col("at").desc(), F.col("id").desc()], 32, ["fingerprint_id"]).select("fingerprint_id", "id")


@c.query("WITH s AS (SELECT DISTINCT * FROM runtime_sessions WHERE started_at IS NOT NULL), l AS (SELECT *, CASE WHEN project_id IS NOT NULL AND agent IS NOT NULL THEN max(started_at) OVER (PARTITION BY project_id, agent ORDER BY started_at, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS nxt FROM s) SELECT id, CASE WHEN kind = 'stable' AND ended_at IS NULL AND nxt IS NOT NULL AND heartbeat_at < nxt - INTERVAL 30 MINUTE THEN 'ABANDONED' WHEN ended_at IS NOT NULL THEN 'CLOSED' ELSE 'OPEN' END AS status FROM l")
def session_status(spark, sf):
    return E.abandoned(load(spark, sf, "runtime_sessions").distinct().where("started_at is not null")).select("id", "status")


@c.query(f"""WITH {_OPS} SELECT id, 'runtime' AS component, CASE WHEN lower(split_part(state, '_', 2)) IN ('internal', 'expected', 'dependency', 'timeout', 'cancelled') THEN lower(split_part(state, '_', 2)) ELSE 'internal' END AS category, greatest(0, least(86400000, coalesce(duration_ms, 0))) AS duration_ms, sha256('fault-v1|' || state || '|' || coalesce(fingerprint_id, '')) AS fingerprint FROM ops""")
def fault_metadata(spark, sf):
    o = _operations(spark, sf)
    meta = E.safe_metadata(F.col("state"), F.lit("request"), F.lower(F.try_element_at(F.split("state", "_"), F.lit(2))), F.col("duration_ms"))
    return o.select("id", meta.alias("m"), E.fingerprint(F.col("state"), F.col("fingerprint_id")).alias("fingerprint")).select("id", "m.component", "m.category", "m.duration_ms", "fingerprint")


# --- synchronisation ---

_TWO = f"{_SIDES}, l1 AS (SELECT * FROM lhs QUALIFY row_number() OVER (PARTITION BY name ORDER BY project_id NULLS FIRST) = 1), r1 AS (SELECT * FROM rhs QUALIFY row_number() OVER (PARTITION BY name ORDER BY project_id NULLS FIRST) = 1)"


def _two(spark, sf):
    first = Window.partitionBy("name").orderBy(F.col("project_id").asc_nulls_first())
    return tuple(d.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n") for d in _sides(spark, sf))


@c.query(f"WITH {_TWO}, j AS (SELECT coalesce(l.name, r.name) AS name, l.name IS NULL AS no_a, r.name IS NULL AS no_b, l.entity_type <> r.entity_type OR list_sort(list_transform(l.observations, lambda o: lower(trim(o)))) <> list_sort(list_transform(r.observations, lambda o: lower(trim(o)))) AS drift FROM l1 l FULL JOIN r1 r ON l.name = r.name), o AS (SELECT name, CASE WHEN no_a THEN 'missing in a' WHEN no_b THEN 'missing in b' WHEN drift THEN 'drifted' END AS outcome FROM j) SELECT * FROM o WHERE outcome IS NOT NULL")
def parity_diff(spark, sf):
    return Y.parity(*_two(spark, sf))


@c.query(f"WITH {REL}, a AS (SELECT DISTINCT from_name, to_name, relation_type FROM rel WHERE substr(id, 1, 1) <> '0'), b AS (SELECT DISTINCT from_name, to_name, relation_type FROM rel WHERE substr(id, 1, 1) <> '1') SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def relation_parity(spark, sf):
    r = relations(spark, sf)
    return Y.relation_parity(r.where("substr(id, 1, 1) <> '0'"), r.where("substr(id, 1, 1) <> '1'"))


@c.query(f"WITH {_TWO} SELECT (SELECT count(*) FROM l1) AS a, (SELECT count(*) FROM r1) AS b, (SELECT count(*) FROM l1) <> (SELECT count(*) FROM r1) AND (SELECT count(*) FROM l1) <= 20000 AS rebuild")
def rebuild_gate(spark, sf):
    return Y.rebuild_needed(*_two(spark, sf))


_M3 = f"""{_TWO}, mk AS (SELECT 'o' AS s, name, entity_type, observations FROM l1 UNION ALL SELECT 't', name, entity_type, observations FROM r1), bs AS (SELECT name, entity_type, observations FROM l1 WHERE length(name) % 3 <> 0 UNION ALL SELECT name, entity_type, observations FROM r1 r WHERE length(name) % 5 = 0 AND NOT EXISTS (SELECT 1 FROM l1 WHERE l1.name = r.name)),
 j AS (SELECT coalesce(b.name, o.name, t.name) AS name, b.name IS NOT NULL AS b, o.name IS NOT NULL AS o, t.name IS NOT NULL AS t, (o.entity_type, list_sort(o.observations)) AS mo, (t.entity_type, list_sort(t.observations)) AS mt, (b.entity_type, list_sort(b.observations)) AS mb, len(o.observations) AS no, len(t.observations) AS nt FROM bs b FULL JOIN l1 o ON o.name = b.name FULL JOIN r1 t ON t.name = coalesce(b.name, o.name)),
 k AS (SELECT *, b AND mo = mb AS so, b AND mt = mb AS st FROM j), m3 AS (SELECT name, CASE WHEN o AND t AND mo = mt THEN 'ours' WHEN o AND t AND so THEN 'theirs' WHEN o AND t AND st THEN 'ours' WHEN o AND t THEN CASE WHEN nt > no THEN 'theirs' ELSE 'ours' END WHEN o AND b AND so THEN 'deleted' WHEN t AND b AND st THEN 'deleted' WHEN o THEN 'ours' WHEN t THEN 'theirs' ELSE 'deleted' END AS outcome,
 (o AND t AND mo <> mt AND NOT so AND NOT st) OR (o AND NOT t AND b AND NOT so) OR (t AND NOT o AND b AND NOT st) AS conflict FROM k)"""


def _merged(spark, sf):
    ours, theirs = (d.select("name", "entity_type", "observations") for d in _two(spark, sf))
    base = ours.where(F.length("name") % 3 != 0).unionByName(theirs.where(F.length("name") % 5 == 0).join(ours.select("name"), "name", "left_anti"))
    return Y.merge_three(base, ours, theirs)


@c.query(f"WITH {_M3} SELECT name, outcome, conflict FROM m3")
def merge_three_way(spark, sf):
    return _merged(spark, sf).select("name", "outcome", "conflict")


@c.query(f"WITH {_M3}, {REL} SELECT DISTINCT from_name, to_name, relation_type FROM rel WHERE from_name IN (SELECT name FROM m3 WHERE outcome <> 'deleted') AND to_name IN (SELECT name FROM m3 WHERE outcome <> 'deleted')")
def merge_relations(spark, sf):
    r = relations(spark, sf)
    return Y.merged_relations(r.where("substr(id, 1, 1) < '9'"), r.where("substr(id, 1, 1) > '5'"), _merged(spark, sf))


@c.query("WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, text, doc_id FROM documents WHERE text IS NOT NULL), a AS (SELECT path, sha256(text) AS h FROM d WHERE doc_id % 7 <> 0), b AS (SELECT path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM d WHERE doc_id % 5 <> 0), o AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path) SELECT * FROM o WHERE change IS NOT NULL")
def manifest_diff(spark, sf):
    d = load(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    a = d.where("doc_id % 7 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    b = d.where("doc_id % 5 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return Y.manifest_changes(a, b)


@c.query(f"WITH {_TWO}, p AS (SELECT r.name, CASE WHEN l.name IS NULL THEN 'created' WHEN NOT (length(l.name) % 4 <> 0) OR l.entity_type <> r.entity_type OR l.lifecycle <> r.lifecycle THEN 'conflict' WHEN l.observations <> r.observations THEN 'updated' ELSE 'unchanged' END AS outcome FROM r1 r LEFT JOIN l1 l ON l.name = r.name) SELECT * FROM p")
def scan_preview(spark, sf):
    old, new = _two(spark, sf)
    return Y.scan_preview(old.select("name", "entity_type", "lifecycle", "observations", (F.length("name") % 4 != 0).alias("scanned")), new)


@c.query("WITH d AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL) SELECT CAST(doc_id AS VARCHAR) AS id, hash FROM d WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0)")
def vectors_to_make(spark, sf):
    d = load(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), "text", "doc_id")
    have = d.where("doc_id % 3 = 0").select("id", F.sha2("text", 256).alias("hash"), F.when(F.col("doc_id") % 2 == 0, "m1").otherwise("m0").alias("model"), F.lit(64).alias("dimension"))
    return Y.vectors_to_make(d.select("id", "text"), have, "m1", 64).select("id", "hash")


@c.query(f"WITH {ENT}, w AS (SELECT id, name FROM ent), ca AS (SELECT id AS k FROM ent WHERE substr(id, 1, 1) < '4' UNION SELECT name FROM ent WHERE substr(id, 1, 1) > 'b') SELECT id, name, CASE WHEN id IN (SELECT k FROM ca) THEN 'id' WHEN name IN (SELECT k FROM ca) THEN 'name' END AS source FROM w")
def cached_vectors(spark, sf):
    e = entities(spark, sf)
    cache = e.where("substr(id, 1, 1) < '4'").select(F.col("id").alias("key")).union(e.where("substr(id, 1, 1) > 'b'").select("name")).distinct().withColumn("vector", F.array(F.lit(0.5)))
    return Y.cached_vectors(e.select("id", "name"), cache).select("id", "name", "source")


@c.query(f"WITH {_TWO} SELECT r.name, len(list_filter(list_distinct(list_transform(r.observations, lambda x: regexp_replace(x, '^\\[[^\\]]*\\]\\s*', ''))), lambda x: NOT list_contains(list_transform(l.observations, lambda y: regexp_replace(y, '^\\[[^\\]]*\\]\\s*', '')), x))) AS added FROM r1 r JOIN l1 l ON l.name = r.name WHERE l.lifecycle = 'candidate' AND added > 0")
def learned_texts(spark, sf):
    old, new = _two(spark, sf)
    return Y.new_texts(old, new).select("name", F.size("added").cast("long").alias("added"))


@c.query("WITH s AS (SELECT trim(name) AS name, coalesce(root_path, '') AS command, id AS position FROM projects) SELECT name, command, position, CASE WHEN name = '' THEN 'no name' WHEN command = '' THEN 'no command' WHEN position <> min(position) OVER (PARTITION BY lower(name)) THEN 'duplicate' END AS error FROM s")
def settings_check(spark, sf):
    p = load(spark, sf, "projects").select(F.trim("name").alias("name"), F.coalesce("root_path", F.lit("")).alias("command"), F.col("id").alias("position"))
    return Y.valid_settings(p)


QUERIES, SQL = c.QUERIES, c.SQL
