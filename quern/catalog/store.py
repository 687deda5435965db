"""Queries over the knowledge store: text functions, scopes, writes and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.functions import text as X
from quern.functions import vocab as V
from quern.operators import store as S
from quern.plans.tables import load
from quern.sources import lines as L

c = Catalog()
AS_OF = "2026-07-01"


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return S.once(load(spark, sf, "entities"))


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """With `text`: content, or the parsed raw text."""
    obs = S.once(load(spark, sf, "observations"))
    return obs.withColumn("text", F.coalesce(F.when(F.trim("content") != "", F.col("content")), X.parse_observation(F.col("raw_text"))["text"], F.lit("")))


def relations(spark: SparkSession, sf: str) -> DataFrame:
    return S.once(load(spark, sf, "relations"))


def first_project(spark: SparkSession, sf: str) -> str:
    return load(spark, sf, "projects").agg(F.min("id")).first()[0]


ENT = "ent AS (SELECT DISTINCT ON (id) * FROM entities WHERE id IS NOT NULL)"
OBS = r"""obs AS (SELECT DISTINCT ON (id) *, coalesce(CASE WHEN trim(content) <> '' THEN content END, regexp_replace(raw_text, '^\[(\d\.?\d*)(?:\|(\d{4}-\d{2}-\d{2}))?\]\s*', ''), '') AS text FROM observations WHERE id IS NOT NULL)"""
REL = "rel AS (SELECT DISTINCT ON (id) * FROM relations WHERE id IS NOT NULL)"


@c.query(f"""WITH {OBS} SELECT id, least(coalesce(try_cast(nullif(regexp_extract(raw_text, '^\\[(\\d\\.?\\d*)', 1), '') AS DOUBLE), 0.8::DOUBLE), 1.0::DOUBLE) AS confidence,
 nullif(regexp_extract(raw_text, '^\\[\\d\\.?\\d*\\|(\\d{{4}}-\\d{{2}}-\\d{{2}})\\]', 1), '') AS obs_date, regexp_replace(raw_text, '^\\[(\\d\\.?\\d*)(?:\\|(\\d{{4}}-\\d{{2}}-\\d{{2}}))?\\]\\s*', '') AS text FROM obs WHERE raw_text IS NOT NULL""")
def observation_parse(spark, sf):
    return observations(spark, sf).where("raw_text is not null").select("id", X.parse_observation(F.col("raw_text")).alias("p")).select("id", "p.*")


@c.query(f"WITH {OBS} SELECT id, '[' || CAST(confidence AS VARCHAR) || CASE WHEN obs_date IS NOT NULL THEN '|' || obs_date ELSE '' END || '] ' || text AS line, CASE WHEN text LIKE '[%' THEN text ELSE '[0.8|{AS_OF}] ' || text END AS prefixed FROM obs WHERE confidence IS NOT NULL")
def observation_format(spark, sf):
    o = observations(spark, sf).where("confidence is not null")
    return o.select("id", X.format_observation(F.col("confidence"), F.col("obs_date"), F.col("text")).alias("line"), X.with_default_prefix(F.col("text"), AS_OF).alias("prefixed"))


@c.query(f"""WITH {OBS} SELECT nullif(regexp_extract(text, '^([A-Z]{{2,10}}):', 1), '') AS category, nullif(lower(regexp_extract(text, '^(\\w+):', 1)), '') AS prefix,
 nullif(regexp_extract(regexp_replace(text, '^\\[[^\\]]*\\]\\s*', ''), '^([A-Z][A-Z0-9_]{{1,24}})\\s*:', 1), '') AS key, count(*) AS n FROM obs GROUP BY ALL""")
def observation_keys(spark, sf):
    t = F.col("text")
    return observations(spark, sf).groupBy(X.writer_category(t).alias("category"), X.prefix_word(t).alias("prefix"), X.observation_key(t).alias("key")).agg(F.count("*").alias("n"))


@c.query(f"""WITH {ENT}, s AS (SELECT *, lower(regexp_replace(split_part(name, ':', 2), '[\\s\\-_]', '', 'g')) AS seg FROM ent) SELECT upper(trim(split_part(name, ':', 1))) AS prefix, CASE WHEN length(seg) >= 3 THEN seg END AS scope, entity_type, count(*) AS n FROM s GROUP BY ALL""")
def name_segments(spark, sf):
    return entities(spark, sf).groupBy(X.name_prefix(F.col("name")).alias("prefix"), X.scope_segment(F.col("name")).alias("scope"), "entity_type").agg(F.count("*").alias("n"))


@c.query("""SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS raw_words, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS index_words,
 len(list_filter(string_split_regex(lower(regexp_replace(text, '["^()+\\-]', ' ', 'g')), '\\s+'), lambda t: t <> '')) AS prefix_terms,
 len(list_filter(string_split_regex(trim(text), '\\s+'), lambda t: t <> '')) AS blank_terms, len(list_filter(string_split_regex(lower(text), '[\\s_\\-]+'), lambda t: length(t) > 1)) AS code_terms FROM documents WHERE text IS NOT NULL""")
def tokeniser_counts(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").where("text is not null").select("doc_id", *[F.size(f(t)).alias(f.__name__) for f in (X.raw_words, X.index_words, X.prefix_terms, X.blank_terms, X.code_terms)])


_STOP = "[" + ", ".join(f"'{w}'" for w in V.SEARCH_STOP) + "]"
SEARCH_TOKENS_SQL = r"""list_distinct(list_transform(list_filter(flatten(list_transform(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda w: list_concat([w],
 CASE WHEN len(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '(\p{{L}})(\p{{N}})', '\1 \2', 'g'), '(\p{{N}})(\p{{L}})', '\1 \2', 'g'), '[\s_]+'), lambda p: p <> '')) > 1
 THEN list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '(\p{{L}})(\p{{N}})', '\1 \2', 'g'), '(\p{{N}})(\p{{L}})', '\1 \2', 'g'), '[\s_]+'), lambda p: p <> '') ELSE [] END))),
 lambda w: length(w) >= 3 AND NOT list_contains({stop}, lower(w))), lambda w: lower(w)))"""


@c.query(f"WITH {ENT} SELECT id, list_sort({SEARCH_TOKENS_SQL.format(t='name', stop=_STOP)}) AS tokens FROM ent")
def search_token_sets(spark, sf):
    return entities(spark, sf).select("id", F.array_sort(X.search_tokens(F.col("name"))).alias("tokens"))


@c.query(f"""WITH {OBS}, d AS (SELECT id, confidence, datediff('day', try_cast(obs_date AS DATE), DATE '{AS_OF}') AS age FROM obs WHERE confidence IS NOT NULL),
 h AS (SELECT *, CASE WHEN confidence <= 0.5 THEN 30.0::DOUBLE WHEN confidence <= 0.8 THEN 70.0 ELSE 180.0 END AS half FROM d)
 SELECT id, age, floor(CASE WHEN age IS NULL OR age < 0 THEN confidence ELSE confidence * exp(-ln(2.0::DOUBLE) / half * age) END * 1e6 + 0.5) / 1e6 AS decayed, coalesce(age > 180, false) AS stale, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM h""")
def observation_decay(spark, sf):
    age = F.datediff(F.lit(AS_OF).cast("date"), F.try_to_date("obs_date") if hasattr(F, "try_to_date") else F.expr("try_cast(obs_date as date)"))
    o = observations(spark, sf).where("confidence is not null").withColumn("age", age.cast("long"))
    return o.select("id", "age", X.rounded(X.decayed(F.col("confidence"), F.col("age")), 6).alias("decayed"), F.coalesce(F.col("age") > 180, F.lit(False)).alias("stale"), X.confidence_band(F.col("confidence")).alias("band"))


@c.query("""WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z][\\w./-]*\\.(?:mjs|ts|sql|py)')) AS path FROM documents)
 SELECT path, regexp_replace(regexp_replace(trim(replace(path, chr(92), '/')), '^\\./', ''), ':\\d+(-\\d+)?$', '') AS normal, len(string_split(path, '/')) AS parts, md5(path)[1:12] AS short_hash, sha256(path)[1:16] AS long_hash FROM f""")
def path_facts(spark, sf):
    paths = load(spark, sf, "documents").select(F.explode(X.all_matches(F.col("text"), r"[A-Za-z][\w./-]*\.(?:mjs|ts|sql|py)")).alias("path")).distinct()
    p = F.col("path")
    return paths.select("path", X.normal_path(p).alias("normal"), F.size(F.split(p, "/")).cast("long").alias("parts"), F.substring(F.md5(p), 1, 12).alias("short_hash"), F.substring(F.sha2(p, 256), 1, 16).alias("long_hash"))


# a line of output that shows an error, for SQL: by how it starts, or by what its first 300 characters hold
_LINES = "string_split(text, chr(10))"
_MARKERS = "['Cannot read properties of', 'is not a function', 'is not defined', 'ENOENT', 'ECONNREFUSED', 'Traceback (most recent call last)', 'MCP error -', 'Tool execution failed']"
_STARTS = r"regexp_matches({0}, '^\s*Error:')"


@c.query(f"""WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Error: ' || text WHEN 1 THEN 'open ENOENT ' || text WHEN 2 THEN repeat('.', 300) || 'ENOENT' ELSE text END AS value FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, value, list_filter({_MARKERS}, lambda m: contains(substr(value, 1, 300), m))[1] AS hit FROM l)
 SELECT doc_id, CASE WHEN {_STARTS.format('value')} THEN 'Error:' ELSE hit END AS marker FROM m""")
def error_markers(spark, sf):
    """Texts as the outputs of calls: some start with an error, some hold one, some only behind the first 300 characters."""
    n = F.col("doc_id") % 4
    out = F.when(n == 0, F.concat(F.lit(" Error: "), "text")).when(n == 1, F.concat(F.lit("open ENOENT "), "text")).when(n == 2, F.concat(F.repeat(F.lit("."), 300), F.lit("ENOENT"))).otherwise(F.col("text"))
    return load(spark, sf, "documents").where("text is not null").select("doc_id", X.error_marker(out).alias("marker"))


@c.query(f"""WITH l AS (SELECT doc_id, coalesce(list_filter({_LINES}, lambda x: {_STARTS.format('x')} OR len(list_filter({_MARKERS}, lambda m: contains(substr(x, 1, 300), m))) > 0)[1], {_LINES}[1]) AS line FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '[A-Za-z]:[\\\\/][^\\s''"]+', '<path>', 'g'), '/[^\\s''"]{{4,}}', '<path>', 'g'), '(?i)\\b[0-9a-f]{{8,}}\\b', '<hash>', 'g'), '\\b\\d+\\b', '<n>', 'g')), 1, 160) AS fingerprint FROM l""")
def error_fingerprints(spark, sf):
    d = load(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", X.error_fingerprint(F.col("text")).alias("fingerprint"))


_WS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@c.query(r"""WITH a AS (SELECT doc_id, regexp_replace(substr(text, 1, 2048), '-----BEGIN(?s:.*?)(?:-----END[^\n]*|\z)', '<secret>', 'g') AS t FROM documents WHERE text IS NOT NULL),
 b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis)://\S+', '<url>', 'g'), '(?i)\b(?:password|token|secret|authorization|cookie|credential|api[_-]?key)\s*[:=]\s*[^\s,;]+', '<secret>', 'g') AS t FROM a),
 c AS (SELECT doc_id, regexp_replace(t, '\x27[^\x27"`\n]*\x27|"[^\x27"`\n]*"|`[^\x27"`\n]*`', '<quoted>', 'g') AS t FROM b),
 d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\b[a-f0-9]{8}-(?:[a-f0-9]{4}-){3}[a-f0-9]{12}\b', '<uuid>', 'g'), '\b\d{4}-\d{2}-\d{2}(?:T[\d:.+-]+Z?)?', '<date>', 'g') AS t FROM c),
 e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?:[A-Za-z]:[\\/]|/(?:home|Users|tmp|var)/)[^\s,)]+', '<path>', 'g'), '\b[a-zA-Z0-9_+/=-]{24,}\b', '<opaque>', 'g') AS t FROM d)
 SELECT doc_id, trim(regexp_replace(regexp_replace(t, '\b\d+(?:\.\d+)?\b', '<number>', 'g'), 'WS+', ' ', 'g')) AS message FROM e""".replace("WS", _WS))
def normal_messages(spark, sf):
    return load(spark, sf, "documents").where("text is not null").select("doc_id", X.normal_message(F.col("text")).alias("message"))


@c.query("""WITH h AS (SELECT doc_id, text, substr(text, 1, 1500) AS head FROM documents WHERE text IS NOT NULL), b AS (SELECT *, CASE WHEN instr(reverse(head), chr(10)) > 0 THEN 1500 - instr(reverse(head), chr(10)) ELSE 0 END AS cut FROM h)
 SELECT doc_id, CASE WHEN length(text) <= 1500 THEN text WHEN cut > 1200 THEN substr(head, 1, cut) ELSE head END AS shown FROM b""")
def capped_texts(spark, sf):
    d = load(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", X.capped_output(F.col("text"), 1500).alias("shown"))


@c.query("""WITH t AS (SELECT doc_id, regexp_replace(text, '^WS+|WS+$', '', 'g') AS t, lower(text) AS low FROM documents WHERE text IS NOT NULL), u AS (SELECT *, len(string_split_regex(t, 'WS+')) AS n FROM t)
 SELECT doc_id, CASE WHEN t = '' THEN 'empty' WHEN n > 30 THEN 'long' WHEN regexp_matches(t, '\\b(?:[a-z]+(?:[A-Z][a-z]*)+|[A-Z][a-z]+(?:[A-Z][a-z]*)+|[a-z]+(?:_[a-z]+)+)\\b') OR regexp_matches(t, '\\b[\\w\\-./\\\\]+\\.(?:m?[jt]sx?|py|java|go|rs|rb|php|cs|kt|swift|sql|sh|md|json|ya?ml|toml|html|css|xml)\\b') OR regexp_matches(t, '\\b[\\w\\-]+[/\\\\][\\w\\-./\\\\]+') THEN 'code token'
 WHEN regexp_matches(low, '\\b(?:CODE)\\b') THEN 'code word' WHEN regexp_matches(low, '\\b(?:KNOW)\\b') THEN 'knowledge word' WHEN n <= 8 THEN 'short' ELSE 'medium' END AS gate FROM u""".replace("WS", _WS).replace("CODE", "|".join(V.CODE_WORDS)).replace("KNOW", "|".join(V.KNOWLEDGE_WORDS)))
def recall_gates(spark, sf):
    d = load(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", X.recall_gate(F.col("text")).alias("gate"))


@c.query("SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL")
def json_props(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type").agg(F.count("*").alias("n"), X.rounded(F.sum("value"), 2).alias("total"))


@c.query(f"WITH {ENT}, p AS (SELECT min(id) AS pid FROM projects) SELECT id, name, entity_type, lifecycle FROM ent, p WHERE project_id = pid AND lifecycle = 'active'")
def scope_list(spark, sf):
    return S.visible(entities(spark, sf), first_project(spark, sf)).select("id", "name", "entity_type", "lifecycle")


@c.query(f"WITH {ENT}, p AS (SELECT min(id) AS pid FROM projects) SELECT id, name, project_id, lifecycle FROM ent, p WHERE (project_id = pid OR project_id IS NULL) AND lifecycle IN ('active', 'candidate')")
def scope_with_global(spark, sf):
    return S.visible(entities(spark, sf), first_project(spark, sf), True, ("active", "candidate")).select("id", "name", "project_id", "lifecycle")


@c.query(f"WITH {ENT} SELECT id, name FROM ent WHERE project_id IS NULL AND lifecycle = 'active'")
def scope_global_only(spark, sf):
    return S.visible(entities(spark, sf), None).select("id", "name")


@c.query(f"WITH {ENT} SELECT entity_type, lifecycle, count(*) AS n FROM ent GROUP BY ALL")
def type_histogram(spark, sf):
    return entities(spark, sf).groupBy("entity_type", "lifecycle").agg(F.count("*").alias("n"))


@c.query(f"WITH {ENT}, {OBS}, o AS (SELECT entity_id, list(text ORDER BY seq)[1:3] AS observations FROM obs GROUP BY 1) SELECT e.id, e.name, e.entity_type, coalesce(o.observations, []) AS observations FROM ent e LEFT JOIN o ON e.id = o.entity_id WHERE e.lifecycle = 'active'")
def entity_details(spark, sf):
    return S.with_observations(entities(spark, sf).where("lifecycle = 'active'"), observations(spark, sf), 3).select("id", "name", "entity_type", "observations")


@c.query(f"WITH {ENT}, {REL} SELECT r.id, r.from_entity_id, r.to_entity_id, r.relation_type FROM rel r JOIN ent a ON a.id = r.from_entity_id JOIN ent b ON b.id = r.to_entity_id WHERE r.lifecycle = 'active' AND a.lifecycle = 'active' AND b.lifecycle = 'active'")
def active_relations(spark, sf):
    return S.active_relations(relations(spark, sf), entities(spark, sf)).select("id", "from_entity_id", "to_entity_id", "relation_type")


@c.query(f"WITH {ENT}, {REL}, n AS (SELECT DISTINCT name FROM ent WHERE entity_type LIKE 'tech-%') SELECT id, from_name, to_name, relation_type FROM rel WHERE from_name IN (SELECT name FROM n) AND to_name IN (SELECT name FROM n)")
def induced_subgraph(spark, sf):
    return S.induced(relations(spark, sf), entities(spark, sf).where("entity_type like 'tech-%'")).select("id", "from_name", "to_name", "relation_type")


@c.query(f"WITH {ENT}, w AS (SELECT DISTINCT from_name AS wanted FROM relations WHERE from_name IS NOT NULL) SELECT w.wanted, e.id, e.name, e.entity_type, e.lifecycle FROM w LEFT JOIN ent e ON lower(e.name) = lower(w.wanted) OR e.id = lower(w.wanted)")
def open_nodes(spark, sf):
    wanted = load(spark, sf, "relations").where("from_name is not null").select(F.col("from_name").alias("wanted")).distinct()
    return S.open_nodes(wanted, entities(spark, sf))


def _sides(spark, sf):
    e = S.with_observations(entities(spark, sf), observations(spark, sf))
    key = F.conv(F.substring("id", 1, 2), 16, 10).cast("int")
    one = S.latest(e.withColumn("_k", key).select("project_id", "name", "id", "entity_type", "lifecycle", "observations", "_k"), ["project_id", "name"], [F.col("id")])
    left = one.where("_k % 3 <> 0").drop("_k", "id")
    right = one.where("_k % 2 = 0").withColumn("entity_type", F.when(F.col("_k") % 10 == 0, "tech-stack").otherwise(F.col("entity_type"))).withColumn("observations", F.when(F.col("_k") % 4 == 0, F.concat("observations", F.array(F.lit("NOTE: more")))).otherwise(F.col("observations"))).drop("_k", "id")
    return left, right


_SIDES = f"""{ENT}, {OBS}, o2 AS (SELECT entity_id, list(text ORDER BY seq) AS observations FROM obs GROUP BY 1),
 e2 AS (SELECT e.*, coalesce(o.observations, []) AS observations, ('0x' || substr(e.id, 1, 2))::INT AS k FROM ent e LEFT JOIN o2 o ON o.entity_id = e.id),
 one AS (SELECT * FROM e2 QUALIFY row_number() OVER (PARTITION BY project_id, name ORDER BY id DESC) = 1),
 lhs AS (SELECT project_id, name, entity_type, lifecycle, observations FROM one WHERE k % 3 <> 0),
 rhs AS (SELECT project_id, name, CASE WHEN k % 10 = 0 THEN 'tech-stack' ELSE entity_type END AS entity_type, lifecycle, CASE WHEN k % 4 = 0 THEN list_append(observations, 'NOTE: more') ELSE observations END AS observations FROM one WHERE k % 2 = 0)"""


@c.query(f"""WITH {_SIDES}, m AS (SELECT coalesce(l.project_id, r.project_id) AS project_id, coalesce(l.name, r.name) AS name, coalesce(l.entity_type, r.entity_type) AS entity_type, coalesce(l.lifecycle, r.lifecycle) AS lifecycle, l.name IS NOT NULL AS old, r.name IS NOT NULL AS fresh, l.entity_type AS lt, r.entity_type AS rt,
 list_sort(list_distinct(list_concat(coalesce(l.observations, []), coalesce(r.observations, [])))) AS both_, list_sort(l.observations) AS lo FROM lhs l FULL JOIN rhs r ON l.name = r.name AND l.project_id IS NOT DISTINCT FROM r.project_id)
 SELECT project_id, name, entity_type, lifecycle, CASE WHEN NOT old THEN both_ WHEN NOT fresh OR lt <> rt THEN lo ELSE both_ END AS observations,
 CASE WHEN NOT old THEN 'created' WHEN NOT fresh THEN 'kept' WHEN lt <> rt THEN 'conflict' WHEN len(both_) > len(lo) THEN 'merged' ELSE 'unchanged' END AS outcome FROM m""")
def entity_merge(spark, sf):
    return S.merge_entities(*_sides(spark, sf)).withColumn("observations", F.array_sort("observations"))


@c.query(f"WITH {_SIDES} SELECT project_id, name, entity_type FROM rhs UNION ALL SELECT l.project_id, l.name, l.entity_type FROM lhs l WHERE NOT EXISTS (SELECT 1 FROM rhs r WHERE r.name = l.name)")
def entity_replace(spark, sf):
    old, new = _sides(spark, sf)
    return S.replace_rows(old, new, ["name"]).select("project_id", "name", "entity_type")


@c.query(f"""WITH {ENT}, {REL}, inc AS (SELECT DISTINCT from_entity_id, to_entity_id, relation_type FROM rel), old AS (SELECT DISTINCT from_entity_id, to_entity_id, relation_type FROM rel WHERE lifecycle = 'active' AND substr(id, 1, 1) < '8'),
 ok AS (SELECT id FROM ent WHERE lifecycle IN ('active', 'candidate')) SELECT i.*, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'no endpoint' WHEN o.relation_type IS NOT NULL THEN 'exists' ELSE 'inserted' END AS outcome
 FROM inc i LEFT JOIN ok a ON a.id = i.from_entity_id LEFT JOIN ok b ON b.id = i.to_entity_id LEFT JOIN old o ON o.from_entity_id = i.from_entity_id AND o.to_entity_id = i.to_entity_id AND o.relation_type = i.relation_type""")
def relation_insert(spark, sf):
    rel = relations(spark, sf)
    old = rel.where("lifecycle = 'active' and substr(id, 1, 1) < '8'")
    return S.insert_relations(old, rel.select("from_entity_id", "to_entity_id", "relation_type"), entities(spark, sf))


@c.query(f"WITH {ENT}, {OBS}, {REL}, g AS (SELECT DISTINCT name FROM ent WHERE lifecycle = 'rejected') SELECT 'entities' AS t, count(*) AS n FROM ent WHERE name NOT IN (SELECT name FROM g) UNION ALL SELECT 'observations', count(*) FROM obs WHERE entity_name IS NULL OR entity_name NOT IN (SELECT name FROM g) UNION ALL SELECT 'relations', count(*) FROM rel WHERE (from_name IS NULL OR from_name NOT IN (SELECT name FROM g)) AND (to_name IS NULL OR to_name NOT IN (SELECT name FROM g))")
def delete_cascade(spark, sf):
    e, o, r = entities(spark, sf), observations(spark, sf), relations(spark, sf)
    kept = S.delete_cascade(e, o, r, e.where("lifecycle = 'rejected'"))
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n") for n, t in zip(("entities", "observations", "relations"), kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_GONE = "g AS (SELECT id FROM ent WHERE entity_type = 'tech-config' AND lifecycle IN ('active', 'candidate'))"
_LEFT = "CASE WHEN {0} AND lifecycle IN ('active', 'candidate') THEN 'archived' ELSE lifecycle END AS lifecycle"


@c.query(f"""WITH {ENT}, {OBS}, {REL}, {_GONE} SELECT 'entity' AS t, id, {_LEFT.format("entity_type = 'tech-config'")} FROM ent
 UNION ALL SELECT 'observation', id, {_LEFT.format('entity_id IN (SELECT id FROM g)')} FROM obs UNION ALL SELECT 'relation', id, {_LEFT.format('(from_entity_id IN (SELECT id FROM g) OR to_entity_id IN (SELECT id FROM g))')} FROM rel""")
def archive_entities(spark, sf):
    kept = S.archive_cascade(entities(spark, sf), observations(spark, sf), relations(spark, sf), F.col("entity_type") == "tech-config")
    parts = [t.select(F.lit(n).alias("t"), "id", "lifecycle") for n, t in zip(("entity", "observation", "relation"), kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@c.query(f"WITH {ENT}, {OBS}, o AS (SELECT entity_id, unnest(list(text ORDER BY seq)) AS text FROM obs GROUP BY 1) SELECT e.id, contains(o.text, 'cache') OR contains(o.text, 'lease') AS archived, count(*) AS n FROM ent e JOIN o ON e.id = o.entity_id GROUP BY ALL")
def archive_observations(spark, sf):
    texts = observations(spark, sf).where("entity_id is not null").select(F.col("entity_id").alias("id"), F.explode(S.archive_texts(F.array("text"), ["cache", "lease"])).alias("o"))
    return texts.join(entities(spark, sf).select("id"), "id", "left_semi").groupBy("id", F.col("o.archived").alias("archived")).agg(F.count("*").alias("n"))


@c.query(f"""WITH {ENT}, q AS (SELECT id, ['active', 'archived', 'rejected', 'candidate'][1 + ('0x' || substr(id, 1, 1))::INT % 4] AS "to" FROM ent UNION ALL SELECT 'nobody', 'active')
 SELECT q.id, e.lifecycle AS "from", q."to", CASE WHEN e.id IS NULL THEN 'missing' WHEN e.lifecycle = q."to" THEN 'same' WHEN (e.lifecycle, q."to") IN (('candidate', 'active'), ('candidate', 'rejected'), ('candidate', 'archived'), ('active', 'archived'), ('archived', 'active'), ('rejected', 'candidate')) THEN 'moved' ELSE 'illegal' END AS outcome FROM q LEFT JOIN ent e ON e.id = q.id""")
def lifecycle_moves(spark, sf):
    e = entities(spark, sf)
    to = F.element_at(F.array(*map(F.lit, ("active", "archived", "rejected", "candidate"))), (F.conv(F.substring("id", 1, 1), 16, 10).cast("int") % 4 + 1))
    asked = e.select("id", to.alias("to")).unionByName(spark.createDataFrame([("nobody", "active")], "id string, to string"))
    return S.transition(e, asked)


@c.query(f"WITH {OBS}, h AS (SELECT entity_id, list(text ORDER BY seq) AS all_ FROM obs WHERE entity_id IS NOT NULL GROUP BY 1) SELECT entity_id, len(list_append(all_, 'last')[-50:]) AS kept, list_append(all_, 'last')[-50:][1] AS oldest FROM h")
def history_append(spark, sf):
    # only the newest fifty of an entity are moved and gathered
    o = S.keep_newest(observations(spark, sf).where("entity_id is not null").select("entity_id", "seq", "text"), [F.col("seq").desc(), F.col("text").desc()], 50, ["entity_id"])
    h = o.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("all"))
    grown = h.select("entity_id", S.append_history(F.col("all"), F.lit("last")).alias("h"))
    return grown.select("entity_id", F.size("h").alias("kept"), F.col("h")[0].alias("oldest"))


@c.query(f"WITH {ENT} SELECT id, name, project_id FROM ent WHERE lifecycle = 'candidate'")
def review_queue(spark, sf):
    return entities(spark, sf).where("lifecycle = 'candidate'").select("id", "name", "project_id")


@c.query(f"""WITH {ENT}, {OBS}, {REL}, l AS (SELECT 1 AS x FROM (SELECT DISTINCT name FROM ent)), b AS (SELECT id FROM ent WHERE substr(id, 1, 1) = '0')
 SELECT (SELECT count(*) FROM l) + (SELECT count(*) FROM b) + (SELECT count(*) FROM rel) AS lines, (SELECT count(*) FROM b) AS bad_lines, (SELECT count(*) FROM l) AS entities, (SELECT count(*) FROM rel) AS relations, (SELECT sum(len(o)) FROM (SELECT list(text ORDER BY seq) AS o, e.name FROM ent e JOIN obs ON obs.entity_id = e.id WHERE e.id IN (SELECT max(id) FROM ent GROUP BY name) GROUP BY e.id, e.name))::BIGINT AS observations""")
def jsonl_scan(spark, sf):
    e = S.with_observations(entities(spark, sf), observations(spark, sf))
    one = S.latest(e, ["name"], [F.col("id")])
    lines = L.as_lines(one, relations(spark, sf)).select("value").unionByName(entities(spark, sf).where("substr(id, 1, 1) = '0'").select(F.concat(F.lit('{"type": '), F.col("id")).alias("value")))
    return L.line_counts(L.parsed_lines(lines))


_PARTS = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) AS p{i}" for i in range(8))


@c.query(f"""WITH {ENT}, r AS (SELECT sha256(id || '|' || sha256(name)) AS h FROM ent), p AS (SELECT count(*) AS files, {_PARTS} FROM r) SELECT files, sha256(concat_ws('|', files, {', '.join(f'p{i}' for i in range(8))})) AS digest FROM p""")
def manifest_digest(spark, sf):
    return L.digest(entities(spark, sf).select(F.col("id").alias("path"), F.sha2("name", 256).alias("hash")))


@c.query(f"WITH {ENT}, {OBS}, o AS (SELECT entity_id, list(text ORDER BY seq, text) AS o FROM obs GROUP BY 1) SELECT e.id, e.project_id, e.name, e.entity_type, e.lifecycle, coalesce(o.o, []) AS observations FROM ent e LEFT JOIN o ON o.entity_id = e.id")
def knowledge_export(spark, sf):
    """All projects and lifecycles, out to versioned JSON and read back."""
    e = S.with_observations(entities(spark, sf), observations(spark, sf))
    doc = F.to_json(F.struct(F.lit(1).alias("version"), "id", "project_id", "name", "entity_type", "lifecycle", "observations"))
    back = F.from_json(doc, "struct<id:string,project_id:string,name:string,entity_type:string,lifecycle:string,observations:array<string>>")
    return e.select(back.alias("b")).select("b.*")


@c.query(f"WITH {ENT} SELECT id, name FROM ent WHERE project_id IS NULL AND lifecycle = 'active' AND name LIKE 'TECH:%'")
def unresolved_scope(spark, sf):
    """An unresolved project adds nothing, global rows asked for or not; no project means the global ones."""
    e = entities(spark, sf)
    none = S.visible(e, S.UNRESOLVED, True).unionByName(S.visible(e, S.UNRESOLVED))
    return none.unionByName(S.visible(e, None).where("name like 'TECH:%'")).select("id", "name")


@c.query(f"WITH {ENT}, p AS (SELECT min(id) AS pid FROM projects), w AS (SELECT DISTINCT name AS wanted FROM ent) SELECT w.wanted, e.id, e.entity_type, e.lifecycle FROM w LEFT JOIN ent e ON e.name = w.wanted AND e.project_id = (SELECT pid FROM p)")
def point_lookup(spark, sf):
    e = entities(spark, sf)
    return S.pick(e, first_project(spark, sf), e.select(F.col("name").alias("wanted")).distinct())


@c.query(f"WITH {ENT} SELECT id, name, entity_type FROM ent WHERE lower(entity_type) IN ('tech-stack', 'biz-rule')")
def names_and_types(spark, sf):
    return S.among(entities(spark, sf), types=["TECH-Stack", "biz-RULE"]).select("id", "name", "entity_type")


QUERIES, SQL = c.QUERIES, c.SQL
