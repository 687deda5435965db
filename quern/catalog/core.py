"""The queries p1, p2, p3 and p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.hierarchy import descendants, hierarchy, pointers
from quern.operators.intervals import periods_and_gaps
from quern.operators.references import orphan_references, orphan_report
from quern.operators.rolling import daily_series, trailing_totals
from quern.plans.tables import load, written

BUCKET_KEYS, BUCKET_VALUES = ["scope", "component"], ["failures", "successes"]


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    obs, rel = load(spark, sf, "observations"), load(spark, sf, "relations")
    fields = [(obs, "observations", "entity_name"), (rel, "relations", "from_name"), (rel, "relations", "to_name")]
    return orphan_references(fields, load(spark, sf, "entities"), F.col("lifecycle").isin("active", "candidate"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("ref_table", "ref_field", "ref_id")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(load(spark, sf, "diag_operation"))


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(load(spark, sf, "diag_operation"), with_path=True)


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "diag_operation")
    links = pointers(rows)
    return descendants(hierarchy(rows, with_path=True, links=links), links)


def _rolling(spark: SparkSession, sf: str) -> DataFrame:
    series = daily_series(load(spark, sf, "diag_bucket"), BUCKET_KEYS, "day", BUCKET_VALUES, "import_id")
    return trailing_totals(series, BUCKET_KEYS, "day", BUCKET_VALUES, [7, 30])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _rolling(spark, sf).select(*BUCKET_KEYS, "day", "failures_7d", "successes_7d", "failures_30d", "successes_30d")


def p3_averages(spark: SparkSession, sf: str) -> DataFrame:
    return _rolling(spark, sf).select(*BUCKET_KEYS, "day", "failures_7d_avg", "successes_7d_avg", "failures_30d_avg", "successes_30d_avg")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return periods_and_gaps(load(spark, sf, "runtime_sessions"), ["project_id", "agent"], F.unix_millis("started_at"), F.unix_millis(F.coalesce("ended_at", "heartbeat_at")))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_paths, p2_descendants, p3_found, p3_averages, p5_found)}

_REFS = """
refs AS (
  SELECT DISTINCT ref_table, ref_field, ref_id, key, ts FROM (
    SELECT 'observations' AS ref_table, 'entity_name' AS ref_field, id AS ref_id, lower(trim(entity_name, ' ' || chr(9))) AS key, created_at AS ts FROM observations
    UNION ALL SELECT 'relations', 'from_name', id, lower(trim(from_name, ' ' || chr(9))), created_at FROM relations
    UNION ALL SELECT 'relations', 'to_name', id, lower(trim(to_name, ' ' || chr(9))), created_at FROM relations) WHERE key <> ''),
targets AS (
  SELECT lower(trim(name, ' ' || chr(9))) AS key, bool_or(created_at IS NULL) AS always, min(created_at) AS first
  FROM entities WHERE lifecycle IN ('active', 'candidate') GROUP BY 1),
orphans AS (
  SELECT r.* FROM refs r LEFT JOIN targets t ON r.key = t.key
  WHERE t.key IS NULL OR (NOT t.always AND r.ts IS NOT NULL AND t.first > r.ts))
"""
_TREE = """
ops AS (
  SELECT id, first(lower(trim(parent_id)) ORDER BY created_at NULLS LAST, parent_id NULLS LAST) AS pkey FROM diag_operation WHERE id IS NOT NULL GROUP BY id),
links AS (SELECT o.id, p.id AS parent FROM ops o LEFT JOIN ops p ON o.pkey = lower(p.id)),
tree AS (
  SELECT id AS op_id, id AS root_id, 0 AS depth, [id] AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, t.root_id, t.depth + 1, list_append(t.path, l.id) FROM tree t JOIN links l ON l.parent = t.op_id)
"""
_RING = """
lost AS (SELECT l.* FROM links l LEFT JOIN tree t ON l.id = t.op_id WHERE t.op_id IS NULL),
walk AS (
  SELECT id AS op_id, id AS cur, 0 AS n FROM lost
  UNION ALL SELECT w.op_id, l.parent, w.n + 1 FROM walk w JOIN lost l ON l.id = w.cur WHERE w.n < 2 * (SELECT count(*) FROM lost)),
ring AS (SELECT op_id, min(cur) AS root_id FROM walk WHERE n >= (SELECT count(*) FROM lost) GROUP BY op_id)
"""
_SERIES = """
rows_ AS (SELECT import_id, first(scope ORDER BY day, scope) AS scope, first(component ORDER BY day, scope) AS component, first(day ORDER BY day, scope) AS day, first(coalesce(failures, 0) ORDER BY day, scope) AS f, first(coalesce(successes, 0) ORDER BY day, scope) AS s
  FROM diag_bucket WHERE day IS NOT NULL AND component IS NOT NULL AND scope IS NOT NULL GROUP BY import_id),
daily AS (SELECT scope, component, day, sum(f) AS f, sum(s) AS s FROM rows_ GROUP BY ALL),
span AS (SELECT scope, component, unnest(range(min(day), max(day) + 1)) AS day FROM daily GROUP BY scope, component),
dense AS (SELECT p.scope, p.component, CAST(p.day AS INT) AS day, coalesce(f, 0) AS f, coalesce(s, 0) AS s FROM span p LEFT JOIN daily d ON p.scope = d.scope AND p.component = d.component AND p.day = d.day),
sums AS (SELECT scope, component, day, CAST(sum(f) OVER a AS BIGINT) AS failures_7d, CAST(sum(s) OVER a AS BIGINT) AS successes_7d, CAST(sum(f) OVER b AS BIGINT) AS failures_30d, CAST(sum(s) OVER b AS BIGINT) AS successes_30d FROM dense
  WINDOW a AS (PARTITION BY scope, component ORDER BY day ROWS 6 PRECEDING), b AS (PARTITION BY scope, component ORDER BY day ROWS 29 PRECEDING))
"""

SQL = {
    "p1_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_field, ref_id FROM orphans",
    "p1_report": f"WITH {_REFS}, one AS (SELECT DISTINCT ref_table, ref_field, ref_id, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS month FROM orphans) SELECT ref_table, ref_field, month, count(*) AS orphans FROM one GROUP BY ALL",
    "p2_found": f"WITH RECURSIVE {_TREE}, {_RING} SELECT op_id, root_id, CAST(depth AS INT) AS depth FROM tree UNION ALL SELECT op_id, root_id, CAST(-1 AS INT) FROM ring",
    "p2_paths": f"WITH RECURSIVE {_TREE}, {_RING} SELECT op_id, root_id, CAST(depth AS INT) AS depth, path FROM tree UNION ALL SELECT op_id, root_id, CAST(-1 AS INT), NULL FROM ring",
    "p2_descendants": f"WITH RECURSIVE {_TREE}, pairs AS (SELECT op_id, depth, unnest(path) AS up, unnest(range(len(path))) AS pos FROM tree) SELECT up AS op_id, op_id AS descendant_id, CAST(depth - pos AS INT) AS distance FROM pairs WHERE pos < depth",
    "p3_found": f"WITH {_SERIES} SELECT * FROM sums",
    "p3_averages": f"WITH {_SERIES} SELECT scope, component, day, failures_7d / 7.0::DOUBLE AS failures_7d_avg, successes_7d / 7.0::DOUBLE AS successes_7d_avg, failures_30d / 30.0::DOUBLE AS failures_30d_avg, successes_30d / 30.0::DOUBLE AS successes_30d_avg FROM sums",
    "p5_found": """WITH s AS (SELECT project_id, agent, epoch_ms(started_at) AS a, epoch_ms(coalesce(ended_at, heartbeat_at)) AS b FROM runtime_sessions WHERE project_id IS NOT NULL AND agent IS NOT NULL),
ok AS (SELECT * FROM s WHERE a <= b), m AS (SELECT *, max(b) OVER (PARTITION BY project_id, agent ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, agent ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM m),
p AS (SELECT project_id, agent, n, min(a) AS a, max(b) AS b FROM g GROUP BY ALL)
SELECT project_id, agent, 'period' AS kind, a AS start_ms, b AS end_ms FROM p
UNION ALL SELECT project_id, agent, 'gap', b, nxt FROM (SELECT *, lead(a) OVER (PARTITION BY project_id, agent ORDER BY a) AS nxt FROM p) WHERE nxt IS NOT NULL""",
}
