"""Remaining small operators: scans of other formats, projections, reports and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.catalog import fixtures as FX
from quern.catalog.code import _F, _RELATIONS, _SYMBOLS, _files
from quern.catalog.code import _symbols as _code_symbols
from quern.catalog.ops import SQL as OPS
from quern.catalog.ops import _BK, _CALLS, _EV, _G, _UP, _bfs, _buckets, _calls, _edges, _fault_events, _symbols, _targets
from quern.catalog.retrieval import _CARDS, _cards
from quern.catalog.store import ENT, OBS, REL, entities, observations, relations
from quern.functions import text as X
from quern.functions import vocab as V
from quern.operators import code as K
from quern.operators import graph as G
from quern.operators import ledger as E
from quern.operators import metrics as M
from quern.operators import retrieval as R
from quern.operators import store as S
from quern.plans.tables import load
from quern.sources import lines as L

c = Catalog()


def _docs(spark, sf):
    return load(spark, sf, "documents").where("text is not null")


@c.query("SELECT doc_id, 'note ' || doc_id AS name, kind AS description, list_filter([lang, source], lambda t: t IS NOT NULL) AS tags FROM documents WHERE text IS NOT NULL")
def frontmatter_scan(spark, sf):
    d = _docs(spark, sf)
    page = F.concat(F.lit("---\nname: note "), F.col("doc_id").cast("string"), F.lit("\ndescription: "), "kind", F.lit("\ntags: ["), F.concat_ws(", ", "lang", "source"), F.lit("]\n---\n"), "text")
    return L.frontmatter(d.select("doc_id", page.alias("text"))).select("doc_id", "name", "description", "tags")


@c.query("SELECT id || '/' || f AS path, CASE f WHEN 'package.json' THEN 'node' WHEN 'pyproject.toml' THEN 'python' WHEN 'go.mod' THEN 'go' WHEN 'Cargo.toml' THEN 'rust' END AS ecosystem, name AS package_name FROM projects, (VALUES ('package.json'), ('pyproject.toml'), ('go.mod'), ('Cargo.toml')) t(f)")
def package_scan(spark, sf):
    p = load(spark, sf, "projects")
    kinds = {"package.json": F.to_json(F.struct("name")), "pyproject.toml": F.format_string('[project]\nname = "%s"\n', "name"), "go.mod": F.concat(F.lit("module example.org/x/"), "name", F.lit("\n")), "Cargo.toml": F.format_string('[package]\nname = "%s"\n', "name")}
    files = None
    for f, text in kinds.items():
        one = p.select(F.concat("id", F.lit(f"/{f}")).alias("path"), text.alias("text"))
        files = one if files is None else files.unionByName(one)
    return L.package_facts(files)


@c.query("WITH l AS (SELECT source AS file, text AS value FROM documents WHERE text IS NOT NULL), u AS (SELECT DISTINCT file, value FROM l) SELECT file, count(*) AS lines, count(*) FILTER (length(value) > 5000) AS too_long FROM u GROUP BY 1")
def session_line_import(spark, sf):
    d = _docs(spark, sf).select(F.col("source").alias("file"), F.col("text").alias("value"))
    return L.bounded_lines(d.unionByName(d), 5000).groupBy("file").agg(F.count("*").alias("lines"), F.count_if("too_long").alias("too_long"))


@c.query("SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS n, floor(embedding[1]::DOUBLE * 1000 + 0.5) / 1000 AS first FROM embeddings")
def embedding_cache_scan(spark, sf):
    e = load(spark, sf, "embeddings").select(F.to_json(F.create_map(F.col("vec_id").cast("string"), F.transform("embedding", lambda x: x.cast("double")))).alias("value"))
    cache = e.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("id", "v"))
    return cache.select("id", F.size("v").cast("long").alias("n"), X.rounded(F.col("v")[0], 3).alias("first"))


@c.query(f"WITH {ENT}, {REL} SELECT 'symbol' AS part, count(*) AS n FROM ent UNION ALL SELECT 'relation', count(*) FROM rel UNION ALL SELECT 'bad', count(*) FROM projects")
def code_graph_scan(spark, sf):
    """One file of mixed lines, taken apart by type; malformed ones are counted."""
    sym = entities(spark, sf).select(F.to_json(F.struct(F.lit("symbol").alias("type"), "name")).alias("value"))
    rel = relations(spark, sf).select(F.to_json(F.struct(F.lit("relation").alias("type"), F.col("from_name").alias("from"), F.col("to_name").alias("to"))).alias("value"))
    p = L.parsed_lines(sym.unionByName(rel).unionByName(load(spark, sf, "projects").select(F.concat(F.lit("{broken "), "id").alias("value"))))
    return p.groupBy(F.when(F.col("bad"), "bad").otherwise(F.col("record.type")).alias("part")).agg(F.count("*").alias("n"))


_TIERS = ", ".join(repr(t) for t in sorted({p for r in V.ENTITY_RULES.values() for p in r[0].split()}))


@c.query(f"""WITH {ENT}, {OBS}, r AS (SELECT o.id, e.name, o.raw_text AS t FROM obs o JOIN ent e ON e.id = o.entity_id WHERE o.raw_text IS NOT NULL), x AS (SELECT id, name, t, regexp_extract(t, '^\\[(\\d\\.?\\d*)(?:\\|(\\d{{4}}-\\d{{2}}-\\d{{2}}))?\\]\\s*', 1) AS n FROM (SELECT id, name, t FROM r UNION ALL SELECT id || '!', name, '[7' || substr(t, 2) FROM r) r)
 SELECT id, list_filter([CASE WHEN NOT regexp_matches(name, '^[^:]+:[^:]+:.+$') THEN 'name' END, CASE WHEN upper(trim(split_part(name, ':', 1))) NOT IN ({_TIERS}) THEN 'tier' END,
 CASE WHEN (regexp_matches(t, '^\\[\\d') AND n = '') OR (n <> '' AND try_cast(n AS DOUBLE) > 1) THEN 'confidence' END], lambda x: x IS NOT NULL) AS problems FROM x""")
def write_validation(spark, sf):
    """Every older text as it would be written again, and once more with its bracket spoiled."""
    r = observations(spark, sf).where("raw_text is not null").select("id", "entity_id", F.col("raw_text").alias("t"))
    r = r.unionByName(r.select(F.concat("id", F.lit("!")).alias("id"), "entity_id", F.concat(F.lit("[7"), F.substring("t", 2, 1 << 30)).alias("t")))
    return r.join(entities(spark, sf).select(F.col("id").alias("entity_id"), "name"), "entity_id").select("id", X.write_problems(F.col("name"), F.array("t")).alias("problems"))


@c.query(f"WITH {_G} SELECT id, name FROM sym WHERE contains(lower(name), 'sess') OR contains(lower(id), 'cache')")
def symbol_substring(spark, sf):
    return _symbols(spark, sf).where(F.contains(F.lower("name"), F.lit("sess")) | F.contains(F.lower("id"), F.lit("cache"))).select("id", "name")


@c.query(f"WITH {_F}, want AS (SELECT DISTINCT regexp_extract(path, '[^/]+$') AS w FROM files WHERE doc_id % 3 = 0) SELECT f.path, w FROM files f JOIN want ON f.path = w OR ends_with(f.path, '/' || w)")
def path_suffix_match(spark, sf):
    f = _files(spark, sf)
    want = f.where("doc_id % 3 = 0").select(F.regexp_extract("path", r"[^/]+$", 0).alias("w")).distinct()
    last = f.select("path", F.regexp_extract("path", r"[^/]+$", 0).alias("_l"))  # equal ends share the last segment: an equi-join
    return last.join(want.withColumn("_l", F.regexp_extract("w", r"[^/]+$", 0)), "_l").where(X.path_ends_match(F.col("path"), F.col("w"))).select("path", "w")


@c.query("WITH t AS (SELECT event_type AS tool, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT tool, v[least(floor(len(v) * 0.95)::INT + 1, len(v))] AS p95 FROM t")
def bench_percentiles(spark, sf):
    return load(spark, sf, "events").groupBy(F.col("event_type").alias("tool")).agg(M.bench_percentile(F.col("value"), 0.95).alias("p95"))


@c.query("WITH r AS (SELECT event_type AS tool, CAST(user_id % 7 AS VARCHAR) AS note, event_id % 2 AS run, value FROM events), g AS (SELECT tool, note, run, round(max(value), 2) AS v FROM r GROUP BY ALL), b AS (SELECT * FROM g WHERE run = 0 AND note <> '3'), a AS (SELECT * FROM g WHERE run = 1) SELECT a.tool, a.note, b.v AS before, a.v AS after, floor((a.v - b.v) / b.v * 100 * 1e6 + 0.5) / 1e6 AS change_pct, b.v IS NULL AS is_new FROM a LEFT JOIN b ON a.tool = b.tool AND a.note = b.note")
def bench_difference(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_type").alias("tool"), (F.col("user_id") % 7).cast("string").alias("note"), (F.col("event_id") % 2).alias("run"), "value")
    g = e.groupBy("tool", "note", "run").agg(F.max("value").alias("v"))
    out = M.run_difference(g.where("run = 0 and note <> '3'"), g.where("run = 1"), ["tool", "note"], "v")
    return out.withColumn("change_pct", X.rounded(F.col("change_pct"), 6))


@c.query(f"WITH {_F}, d AS (SELECT regexp_replace(path, '/[^/]+$', '') AS dir, regexp_extract(path, '\\.([a-z]+)$', 1) AS ext FROM files), n AS (SELECT dir, ext, count(*) AS n FROM d GROUP BY ALL) SELECT dir, sum(n)::BIGINT AS files, first(ext ORDER BY n DESC, ext DESC) AS main_ext FROM n GROUP BY 1")
def directory_histogram(spark, sf):
    f = _files(spark, sf).select(F.regexp_replace("path", r"/[^/]+$", "").alias("dir"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("ext"))
    return f.groupBy("dir", "ext").agg(F.count("*").alias("n")).groupBy("dir").agg(F.sum("n").alias("files"), F.max_by("ext", F.struct("n", "ext")).alias("main_ext"))


@c.query(f"WITH {OBS}, t AS (SELECT entity_name, count(*) AS n FROM obs GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, entity_name NULLS LAST) AS k, count(*) OVER () AS c FROM t) SELECT entity_name, n, c - 10 AS more FROM r WHERE k <= 10")
def top_with_tail(spark, sf):
    n = observations(spark, sf).groupBy("entity_name").agg(F.count("*").alias("n"))
    top = n.orderBy(F.col("n").desc(), F.col("entity_name").asc_nulls_last()).limit(10)
    return top.crossJoin(F.broadcast(n.agg((F.count("*") - 10).alias("more"))))


@c.query(f"WITH {ENT}, n AS (SELECT count(*) AS n FROM ent) SELECT n, CASE WHEN n < 500 THEN 20 WHEN n < 5000 THEN 15 WHEN n < 15000 THEN 10 ELSE 5 END AS budget FROM n")
def adaptive_budget(spark, sf):
    n = entities(spark, sf).agg(F.count("*").alias("n"))
    return n.withColumn("budget", F.when(F.col("n") < 500, 20).when(F.col("n") < 5000, 15).when(F.col("n") < 15000, 10).otherwise(5))


@c.query(f"WITH {OBS} SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC NULLS LAST, seq) AS rank, seq, text FROM obs WHERE entity_id IS NOT NULL QUALIFY rank <= 5")
def history_newest(spark, sf):
    # the newest five of an entity are found before anything is gathered
    o = S.keep_newest(observations(spark, sf).where("entity_id is not null"), [F.col("updated_at").desc_nulls_last(), F.col("seq")], 5, ["entity_id"])
    item = F.struct(F.col("text").alias("content"), F.array(F.struct(F.col("updated_at").alias("changed_at"), "seq")).alias("history"))
    one = o.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("i")))), lambda x: x["i"]).alias("obs"))
    return S.history_rows(one, "entity_id", "obs", 5).select("entity_id", F.col("rank").cast("long").alias("rank"), "seq", F.col("content").alias("text"))


@c.query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, md5(coalesce(text, ''))[1:12] AS short FROM documents")
def content_hashes(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return load(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("hash"), F.substring(F.md5(t), 1, 12).alias("short"))


@c.query()
def fault_signatures(spark, sf):
    return _docs(spark, sf).select("doc_id", X.hmac_sha256(b"salt", X.normal_message(F.col("text"))).alias("signature"))


@c.query("SELECT doc_id, text AS plain FROM documents WHERE text IS NOT NULL")
def unwrapped_outputs(spark, sf):
    """Outputs wrapped in the three shapes in turn come out as the text they hold."""
    d = _docs(spark, sf)
    part = F.array(F.struct("text"))
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.to_json(part)).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(part.alias("content")))).otherwise(F.to_json(F.struct("text")))
    return d.select("doc_id", X.output_text(wrapped).alias("plain"))


@c.query("SELECT id, array_to_string(list_transform(list_filter(string_split_regex(name, '[-_.\\s]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') AS pascal, array_to_string(list_transform(string_split(name, '-'), lambda w: upper(w[1]) || w[2:]), '') AS component FROM projects")
def case_forms(spark, sf):
    n = F.col("name")
    return load(spark, sf, "projects").select("id", X.pascal_case(n).alias("pascal"), X.kebab_to_pascal(n).alias("component"))


@c.query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`([^`\n]*)`', '\1', 'g') AS t FROM documents WHERE text IS NOT NULL),
 b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS t FROM a),
 c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#{1,6}[ \t]+', '', 'g'), '(?m)^>[ \t]?', '', 'g'), '(?m)^[-*_]{3,}[ \t]*$', '', 'g') AS t FROM b)
 SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\*\*([^*\n]+)\*\*', '\1', 'g'), '\*([^*\n]+)\*', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS plain FROM c""")
def markdown_stripped(spark, sf):
    d = _docs(spark, sf).where("text is not null")
    return d.select("doc_id", X.plain_markdown(F.col("text")).alias("plain"))


@c.query("SELECT id, CASE WHEN status = 'OPEN' THEN true WHEN status = 'CLOSED' THEN false END AS flag, [coalesce(agent, ''), kind] AS parts, epoch_ms(started_at) % 1000 / 8.0::DOUBLE AS number FROM (SELECT DISTINCT * FROM runtime_sessions)")
def coerced_values(spark, sf):
    r = load(spark, sf, "runtime_sessions").distinct()
    word = F.when(F.col("status") == "OPEN", "TRUE").when(F.col("status") == "CLOSED", "false").otherwise("maybe")
    return r.select("id", X.loose_boolean(word).alias("flag"), X.json_or_words(F.to_json(F.array(F.coalesce("agent", F.lit("")), "kind"))).alias("parts"), X.loose_number(F.concat(F.lit(" "), (F.unix_millis("started_at") % 1000 / 8.0).cast("string"))).alias("number"))


@c.query(f"WITH {_F} SELECT DISTINCT path, list_filter([CASE WHEN regexp_matches(path, '(^|/)(routes?|controllers?|api)/') THEN 'routes' END, CASE WHEN regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|\\.(test|spec)\\.') THEN 'tests' END, 'source'], lambda x: x IS NOT NULL) AS phases FROM files")
def scan_phases(spark, sf):
    return _files(spark, sf).select("path", X.scan_phases(F.col("path")).alias("phases")).distinct()


_TOOLS = ["query", "context", "impact", "detect_changes", "index", "semantic_search", "search_nodes", "open_nodes", "create_entities", "add_observations", "create_relations", "unified_search", "session_start", "health", "read_graph", "archive", "audit_trail", "skill_search"]


@c.query("SELECT t.name, p.profile, p.profile = 'full' OR t.name NOT IN ('read_graph', 'archive', 'audit_trail', 'skill_search') AS enabled FROM (" + FX.values([(t,) for t in _TOOLS]) + ") t(name), (VALUES ('core'), ('full')) p(profile)")
def tool_profile(spark, sf):
    tools = spark.createDataFrame([(t, p) for t in _TOOLS for p in ("core", "full")], "name string, profile string")
    return tools.withColumn("enabled", (F.col("profile") == "full") | F.col("name").isin(V.CORE_TOOLS))


@c.query(f"WITH {_G}, {_UP}, tg AS (SELECT id AS start FROM sym WHERE exported AND file LIKE '%/tech.ts'), d AS (SELECT t.start, count(DISTINCT u.dst) AS d1 FROM tg t LEFT JOIN up u ON u.src = t.start GROUP BY 1) SELECT start, d1 FROM d WHERE d1 > 0")
def check_edit_report(spark, sf):
    """Public symbols of the touched files that something depends on."""
    s = _symbols(spark, sf).where("exported and file like '%/tech.ts'").select(F.col("id").alias("start"))
    return G.impact_counts(_edges(spark, sf), s).where("d1 > 0").select("start", "d1")


@c.query(f"WITH {_G}, {_UP}, {_bfs('up', 1)}, k AS (SELECT t.start, count(b.node) AS d1 FROM targets t LEFT JOIN bfs b ON b.start = t.start GROUP BY 1) SELECT start, d1 FROM k")
def impact_annotation(spark, sf):
    return G.impact_counts(_edges(spark, sf), _targets(spark, sf)).select("start", "d1")


@c.query(f"WITH {_EV} SELECT fingerprint_id, id FROM ev WHERE fingerprint_id IN (SELECT min(fingerprint_id) FROM ev) OR id IN (SELECT max(id) FROM ev)")
def lookup_any_id(spark, sf):
    e = _fault_events(spark, sf)
    keys = e.agg(F.min("fingerprint_id").alias("f"), F.max("id").alias("i"))
    return e.crossJoin(F.broadcast(keys)).where("fingerprint_id = f or id = i").select("fingerprint_id", "id")


@c.query(f"WITH {_BK}, t AS (SELECT CAST(sum(successes) AS BIGINT) AS successes, CAST(sum(failures) AS BIGINT) AS failures FROM bk) SELECT t.*, (SELECT count(DISTINCT fingerprint_id) FROM diag_operation) AS faults FROM t")
def ledger_summary(spark, sf):
    b = _buckets(spark, sf).agg(F.sum("successes").alias("successes"), F.sum("failures").alias("failures"))
    return b.crossJoin(load(spark, sf, "diag_operation").agg(F.count_distinct("fingerprint_id").alias("faults")))


@c.query(f"WITH fs AS (SELECT * FROM ({OPS['fault_states']})) SELECT * FROM fs WHERE state IN ('IGNORED', 'CLOSED', 'VERIFIED_FIXED') ORDER BY last_seen, fingerprint_id LIMIT (SELECT greatest(0, count(*) - 5) FROM fs)")
def evictable_faults(spark, sf):
    return E.evictable(E.fault_states(_fault_events(spark, sf)), 5)


@c.query(f"WITH fs AS (SELECT *, CASE WHEN regressions > 0 THEN 'VERIFIED_FIXED' ELSE state END AS st FROM ({OPS['fault_states']})), t AS (SELECT fingerprint_id, ['SYMPTOM: ' || fingerprint_id, 'TOTAL: ' || total, 'REGRESSIONS: ' || regressions, 'STATE: ' || st] AS l FROM fs WHERE st = 'VERIFIED_FIXED') SELECT fingerprint_id, CAST(unnest(range(4)) AS INT) AS ord, unnest(l) AS text FROM t")
def incident_drafts(spark, sf):
    return E.incident_drafts(E.fault_states(_fault_events(spark, sf)).withColumn("state", F.when(F.col("regressions") > 0, "VERIFIED_FIXED").otherwise(F.col("state"))))


@c.query(f"WITH {_CARDS}, s AS (SELECT doc_id, regexp_replace(lower(label), '[\\s\\-_]', '', 'g') AS flat FROM cards) SELECT doc_id, CASE WHEN contains(flat, 'tindra') THEN 'match' WHEN contains(flat, 'kernel') OR contains(flat, 'marlow') THEN 'other' ELSE 'neutral' END AS scope FROM s WHERE contains(flat, 'tindra')")
def scope_recall(spark, sf):
    """Recall without keywords: the entities of the own scope."""
    cards = _cards(spark, sf).select(F.col("doc_id").alias("id"), F.col("label").alias("name"), "entity_type", "observations")
    return R.recall(cards, [], ["tindra"], ["tindra", "kernel", "marlow"], k=1 << 20).select(F.col("id").alias("doc_id"), "scope")


@c.query(f"WITH {ENT}, s AS (SELECT DISTINCT regexp_replace(lower(split_part(name, ':', 2)), '[\\s\\-_]', '', 'g') AS scope FROM ent WHERE entity_type IN ('biz-domain', 'tech-stack')), p AS (SELECT id, regexp_replace(lower(regexp_extract(root_path, '[^/]+$')), '[\\s\\-_]', '', 'g') AS dir FROM projects) SELECT p.id, s.scope FROM p JOIN s ON contains(p.dir, s.scope) WHERE length(s.scope) >= 3")
def scope_detection(spark, sf):
    e = entities(spark, sf).where(F.col("entity_type").isin("biz-domain", "tech-stack"))
    scopes = e.select(X.scope_segment(F.col("name")).alias("scope")).where("scope is not null").distinct()
    dirs = load(spark, sf, "projects").select("id", X.squeezed(F.element_at(F.split("root_path", "/"), -1)).alias("dir"))
    # substrings of the folder of three characters or more: turns `contains` into an equi-join
    parts = dirs.select("id", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("dir")), lambda i: F.transform(F.sequence(i, F.length("dir")), lambda j: F.substr("dir", i, j - i + 1))))).alias("scope")).where(F.length("scope") >= 3).distinct()
    return parts.join(scopes, "scope").select("id", "scope")


@c.query(f"WITH {_F}, r AS (SELECT path, name, regexp_replace(name, '^(handle|on|register|setup|init|run|start|process|execute)', '') AS cut FROM sym) SELECT path, name, CASE WHEN length(cut) < 2 THEN upper(name[1]) || name[2:] ELSE upper(cut[1]) || cut[2:] END AS label FROM r")
def process_labels(spark, sf):
    return _code_symbols(spark, sf).select("path", "name", X.process_label(F.col("name")).alias("label"))


@c.query(f"WITH {OBS}, k AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z][\\w./-]*\\.(?:mjs|ts|sql|py)')) AS p FROM obs) SELECT id, p AS path, regexp_replace(p, '^\\./', '') AS normal FROM k")
def referenced_files(spark, sf):
    o = observations(spark, sf).select("id", F.explode(X.all_matches(F.col("text"), r"[A-Za-z][\w./-]*\.(?:mjs|ts|sql|py)")).alias("path"))
    return o.select("id", "path", X.normal_path(F.col("path")).alias("normal"))


@c.query(f"WITH {ENT} SELECT id, CASE WHEN id < '8' THEN id WHEN id < 'b' THEN entity_type WHEN project_id <> '' THEN project_id || '::' || name ELSE name END AS key FROM ent")
def identity_keys(spark, sf):
    e = entities(spark, sf)
    return e.select("id", X.identity_key(F.when(F.col("id") < "8", F.col("id")).otherwise(""), F.when(F.col("id") < "b", F.col("entity_type")), F.col("project_id"), F.col("name")).alias("key"))


@c.query(f"WITH {_F} SELECT path, count(*) AS n FROM sym WHERE exported GROUP BY 1")
def member_relations(spark, sf):
    """Each exported function as a member of its file."""
    s = _code_symbols(spark, sf).where("exported").withColumn("parent", F.col("path"))
    return K.member_of(s).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n"))


@c.query(f"WITH {ENT}, {REL}, t AS (SELECT id, 'Seen `' || from_name || '` and `TECH:' || to_name || '`.' AS text FROM rel WHERE from_name IS NOT NULL AND to_name IS NOT NULL), m AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '`((?:BIZ|TECH|PATTERN|INCIDENT|RULE|FLOW|ENTITY|DECISION|GOTCHA):[^`]+)`', 1)) AS name FROM t) SELECT 'conversation' AS source, name, count(*) AS n FROM m WHERE name NOT IN (SELECT name FROM ent) GROUP BY name")
def transcript_capture(spark, sf):
    """Entities named in lines of talk about relations that the store doesn't know yet."""
    talk = relations(spark, sf).where("from_name is not null and to_name is not null").select(F.col("id").alias("doc_id"), F.concat(F.lit("Seen `"), "from_name", F.lit("` and `TECH:"), "to_name", F.lit("`.")).alias("text"))
    found = K.mentions(talk).where("kind = 'explicit'").select("doc_id", "name").join(entities(spark, sf).select("name"), "name", "left_anti")
    return found.groupBy("name").agg(F.count("*").alias("n")).select(F.lit("conversation").alias("source"), "name", "n")


@c.query(f"WITH {ENT} SELECT project_id, entity_type, count(*) AS n FROM ent GROUP BY 1, 2")
def minimal_detail(spark, sf):
    return entities(spark, sf).groupBy("project_id", "entity_type").agg(F.count("*").alias("n"))


@c.query(f"WITH {OBS} SELECT id, text AS content, false AS archived, 0 AS versions FROM obs")
def structured_observations(spark, sf):
    o = observations(spark, sf).select("id", F.explode(S.as_structs(F.array("text"))).alias("o"))
    return o.select("id", "o.content", "o.archived", F.size("o.history").alias("versions"))


@c.query(f"WITH {_EV}, t AS (SELECT fingerprint_id, count(*) AS total, min(at_) AS f FROM ev GROUP BY 1) SELECT fingerprint_id, total, row_number() OVER (ORDER BY f NULLS LAST, fingerprint_id) <= 20 AS detailed FROM t")
def budget_saturation(spark, sf):
    return E.within_budget(_fault_events(spark, sf), 20)


@c.query(f"""WITH {_BK}, fs AS (SELECT * FROM ({OPS['fault_states']})), lk AS (SELECT fingerprint_id FROM fs WHERE regressions > 1), fr AS (SELECT * FROM fs WHERE state IN ('IGNORED', 'CLOSED', 'VERIFIED_FIXED') AND fingerprint_id NOT IN (SELECT fingerprint_id FROM lk) ORDER BY last_seen, fingerprint_id LIMIT (SELECT greatest(0, count(*) - 10) FROM fs)),
 sa AS (SELECT DISTINCT ON (id) * FROM diag_operation WHERE id IS NOT NULL ORDER BY id, created_at), n AS (SELECT epoch_ms(TIMESTAMPTZ '2026-03-01 00:00:00+00') AS now)
 SELECT 'samples' AS t, least(300, (SELECT count(*) FROM sa, n WHERE epoch_ms(created_at) >= now - 30 * 86400000::BIGINT)) AS kept UNION ALL SELECT 'buckets', (SELECT count(*) FROM bk, n WHERE day >= now // 86400000 - 365) UNION ALL SELECT 'faults', (SELECT count(*) FROM fs) - (SELECT count(*) FROM fr)
 UNION ALL SELECT 'sessions', (SELECT count(*) FROM (SELECT DISTINCT * FROM runtime_sessions), n WHERE epoch_ms(heartbeat_at) >= now - 30 * 86400000::BIGINT) UNION ALL SELECT 'pruned ' || scope, CAST(sum(coalesce(successes, 0) + coalesce(failures, 0)) AS BIGINT) FROM bk, n WHERE day < now // 86400000 - 365 GROUP BY scope""")
def retention_run(spark, sf):
    from quern.catalog.ops import _operations

    faults = E.fault_states(_fault_events(spark, sf))
    out = E.retention(_operations(spark, sf).select("id", "created_at"), _buckets(spark, sf), faults, load(spark, sf, "runtime_sessions").distinct(), faults.where("regressions > 1"), "2026-03-01", 300, 10)
    rows = out["pruned"].select(F.concat(F.lit("pruned "), "scope").alias("t"), (F.coalesce("pruned_successes", F.lit(0)) + F.coalesce("pruned_failures", F.lit(0))).alias("kept"))
    for name in ("samples", "buckets", "faults", "sessions"):
        rows = rows.unionByName(out[name].agg(F.count("*").alias("kept")).select(F.lit(name).alias("t"), "kept"))
    return rows


_CAPSULES = [("c01.json", '{"id": "a", "x": 1}'), ("c02.json", "{broken"), ("c03.json", '{"id": "a"}'), ("c04.json", '{"id": "old"}'), ("c05.json", '{"id": "b", "t": "' + "x" * 50 + '"}'), ("c06.json", "[1]"), ("c07.json", '{"id": "c"}')]


@c.query("SELECT * FROM (" + FX.values([("c01.json", "a", "imported"), ("c02.json", None, "invalid"), ("c03.json", "a", "duplicate"), ("c04.json", "old", "duplicate"), ("c05.json", "b", "too long"), ("c06.json", None, "invalid")]) + ") t(file, id, outcome)")
def crash_capsules(spark, sf):
    known = spark.createDataFrame([("old",)], "id string")
    return L.capsules(spark.createDataFrame(_CAPSULES, "file string, value string"), known, 6, 40)


@c.query("WITH e AS (SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'tool:call' WHEN 'view' THEN 'search:query' ELSE 'other:' || event_type END AS type FROM events) SELECT event_id, type FROM e WHERE type IN ('tool:call', 'tool:result', 'search:query', 'search:fusion', 'bridge:forward') AND ts IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1000")
def trace_tail(spark, sf):
    t = F.when(F.col("event_type") == "click", "tool:call").when(F.col("event_type") == "view", "search:query").otherwise(F.concat(F.lit("other:"), "event_type"))
    return L.trace_tail(load(spark, sf, "events").select("event_id", "ts", t.alias("type")), 1000, ["ts", "event_id"]).select("event_id", "type")


@c.query("SELECT * FROM (" + FX.values([("meta", None), *[("symbol", i) for i, *_ in _SYMBOLS], *[("relation", f"{a} {k} {b}") for a, b, k, _ in _RELATIONS]]) + ") t(type, what)")
def code_graph_lines(spark, sf):
    """An index written as lines and read again."""
    lines = L.graph_lines(*K.indexed(K.extract(FX.files(spark))))
    r = L.parsed_lines(lines, L.GRAPH).where("not bad").select("record.*")
    return r.select(F.col("_type").alias("type"), F.when(F.col("_type") == "symbol", F.col("id")).when(F.col("_type") == "relation", F.concat_ws(" ", "from", "kind", "to")).alias("what"))


@c.query(f"WITH {OBS}, o AS (SELECT id, created_at, printf('%012x', epoch_ms(created_at)) AS ms, sha256(id) AS h FROM obs WHERE created_at IS NOT NULL) SELECT id, ms[1:8] || '-' || ms[9:12] || '-7' || h[1:3] || '-8' || h[4:6] || '-' || h[7:18] AS ordered FROM o")
def time_ordered_ids(spark, sf):
    return observations(spark, sf).where("created_at is not null").select("id", X.time_ordered_id(F.col("created_at"), F.col("id")).alias("ordered"))


@c.query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS ok, CASE WHEN doc_id % 5 < 4 THEN text END AS output FROM documents WHERE text IS NOT NULL")
def call_outcomes(spark, sf):
    """Results of calls in five shapes: fine, marked as an error, fine without a mark, `Err`, and something else."""
    d, n = _docs(spark, sf), F.col("doc_id") % 5
    content = F.array(F.struct("text")).alias("content")
    ok = lambda *flag: F.to_json(F.struct(F.struct(*flag, content).alias("Ok")))
    shape = F.when(n == 0, ok(F.lit(False).alias("isError"))).when(n == 1, ok(F.lit(True).alias("isError"))).when(n == 2, ok()).when(n == 3, F.to_json(F.struct(F.col("text").alias("Err")))).otherwise(F.lit('{"pending": 1}'))
    return d.select("doc_id", X.call_outcome(shape).alias("r")).select("doc_id", "r.*")


QUERIES, SQL = c.QUERIES, c.SQL
