"""Queries of the code graph over the code among the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.catalog import fixtures as FX
from quern.catalog.store import _WS
from quern.functions import text as X
from quern.operators import code as K
from quern.plans.tables import load

c = Catalog()


def _files(spark, sf):
    d = load(spark, sf, "documents").where("kind = 'code_file' and text is not null")
    return d.select(F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mjs")).alias("path"), "text", "doc_id")


def _symbols(spark, sf):
    return K.line_symbols(_files(spark, sf))


_F = r"""files AS (SELECT 'src/' || source || '/' || doc_id || '.mjs' AS path, text, doc_id FROM documents WHERE kind = 'code_file' AND text IS NOT NULL),
 ln AS (SELECT path, doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
 dec AS (SELECT *, regexp_extract(value, '^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(', 1) AS js, regexp_extract(value, '^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(', 1) AS py FROM ln),
 sym AS (SELECT path, CASE WHEN js <> '' THEN js ELSE py END AS name, CAST(line AS INT) AS line, CASE WHEN js <> '' THEN 'js' ELSE 'py' END AS lang, CASE WHEN js <> '' THEN regexp_matches(value, '^\s*export\s') ELSE NOT starts_with(py, '_') END AS exported, path || '::' || CASE WHEN js <> '' THEN js ELSE py END AS id FROM dec WHERE js <> '' OR py <> ''),
 sp AS (SELECT *, CAST(coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, 1073741824) AS INT) AS line_end FROM sym)"""


@c.query(f"WITH {_F} SELECT id, path, name, line, lang, exported FROM sym")
def code_symbols(spark, sf):
    return _symbols(spark, sf).select("id", "path", "name", "line", "lang", "exported")


@c.query(f"WITH {_F} SELECT name, last(id ORDER BY path, line) AS id FROM sym GROUP BY 1")
def symbol_name_map(spark, sf):
    return K.name_map(_symbols(spark, sf), ["path", "line"])


def _returns(spark, sf):
    return K.lines_of(_files(spark, sf)).where(F.col("value").rlike(r"^\s*(return|if|for|while)\b")).select("path", "line")


@c.query(f"WITH {_F}, pt AS (SELECT path, CAST(line AS INT) AS line FROM ln WHERE regexp_matches(value, '^\\s*(return|if|for|while)\\b')) SELECT path, line, coalesce((SELECT s.id FROM sp s WHERE s.path = p.path AND s.line <= p.line AND s.line_end >= p.line ORDER BY s.line_end - s.line, s.id LIMIT 1), path) AS inside FROM pt p")
def enclosing_symbol(spark, sf):
    return K.enclosing(_returns(spark, sf), K.spans(_symbols(spark, sf)))


@c.query(f"WITH {_F}, ch AS (SELECT path, line FROM ln WHERE contains(value, 'continue')) SELECT id, line FROM sp WHERE EXISTS (SELECT 1 FROM ch WHERE ch.path = sp.path AND ch.line BETWEEN sp.line AND sp.line_end)")
def changed_symbols(spark, sf):
    ch = K.lines_of(_files(spark, sf)).where(F.contains("value", F.lit("continue"))).select("path", "line")
    return K.touched(K.spans(_symbols(spark, sf)), ch).select("id", "line")


def _refs(spark, sf):
    s = _symbols(spark, sf)
    return s.select(F.col("id").alias("ref_id"), "name", F.concat(F.lit("src/"), F.element_at(F.split("path", "/"), 2), F.lit("/x.mjs")).alias("path"), "line", F.lit("js").alias("lang"), F.lit("calls").alias("kind")).distinct()


def _scores(spark, sf):
    return K.candidate_scores(_refs(spark, sf), _symbols(spark, sf).withColumn("kind", F.lit("function")))


_SC = f"""{_F}, rf AS (SELECT DISTINCT id AS ref_id, name, 'src/' || split_part(path, '/', 2) || '/x.mjs' AS path, line FROM sym),
 sc AS (SELECT r.ref_id, r.name, s.id AS target, CASE WHEN s.path = r.path THEN 120 ELSE least(15 * CASE WHEN string_split(r.path, '/')[2] <> string_split(s.path, '/')[2] THEN 1 WHEN string_split(r.path, '/')[3] <> string_split(s.path, '/')[3] THEN 2 ELSE 3 END, 80) END + CASE WHEN s.lang = 'js' THEN 50 ELSE -80 END + 25 + CASE WHEN s.exported THEN 10 ELSE 0 END AS points FROM rf r JOIN sym s ON s.name = r.name)"""


@c.query(f"WITH {_SC} SELECT ref_id, name, target, points FROM sc")
def candidate_scores(spark, sf):
    return _scores(spark, sf)


@c.query(f"WITH {_SC}, t AS (SELECT ref_id, max(points) AS top FROM sc GROUP BY 1), n AS (SELECT sc.ref_id, target, top, row_number() OVER (PARTITION BY sc.ref_id ORDER BY points DESC, target) AS n FROM sc JOIN t ON t.ref_id = sc.ref_id WHERE points >= top - 10) SELECT ref_id, max(CASE WHEN n = 1 THEN target END) AS target, least(1, greatest(0, max(top) / 200.0::DOUBLE)) AS confidence, count(*) > 1 AS ambiguous, coalesce(list(target ORDER BY n) FILTER (n BETWEEN 2 AND 5), []) AS others FROM n WHERE n <= 5 GROUP BY 1")
def best_candidates(spark, sf):
    return K.best_candidate(_scores(spark, sf))


@c.query(f"WITH {_SC} SELECT DISTINCT ref_id, ref_id AS target FROM rf")
def import_resolution(spark, sf):
    """Each reference imports its own symbol's file from a sibling, without the ending; `import_endings` has the harder cases."""
    r = _refs(spark, sf).withColumn("path", F.concat(F.lit("src/"), F.hash("ref_id").cast("string"), F.lit(".mjs")))
    module = F.concat(F.lit("./"), F.regexp_extract("ref_id", r"^src/(.*)\.mjs::", 1))
    return K.import_targets(r, r.select("path", "name", module.alias("module")), _symbols(spark, sf))


_IMPORTS = [("a/main.ts", "one", "./lib/one"), ("a/main.ts", "two", "./lib/two"), ("a/main.ts", "three", "../b/three"), ("a/main.ts", "four", "./lib"), ("a/main.ts", "five", "five"), ("a/main.ts", "six", "./lib/six.ts")]
_EXPORTS = ["a/lib/one.mjs::one", "a/lib/one.ts::one", "a/lib/two/index.js::two", "a/lib/two/index.ts::two", "b/three.py::three", "c/three.ts::three", "a/lib/deep/x.ts::four", "five.ts::five", "a/lib/six.ts::six", "a/lib/one.ts::other"]


@c.query("SELECT * FROM (" + FX.values([("one", "a/lib/one.ts::one"), ("two", "a/lib/two/index.ts::two"), ("three", "b/three.py::three"), ("four", "a/lib/deep/x.ts::four"), ("six", "a/lib/six.ts::six")]) + ") t(ref_id, target)")
def import_endings(spark, sf):
    """Endings in their order, a folder's index, a path upwards, a name below the path, a path with its ending; a bare name is none."""
    imports = spark.createDataFrame(_IMPORTS, "path string, name string, module string")
    symbols = spark.createDataFrame([(x.split("::")[1], x, x.split("::")[0]) for x in _EXPORTS], "name string, id string, path string")
    return K.import_targets(imports.select(F.col("name").alias("ref_id"), "path", "name"), imports, symbols)


@c.query(f"""WITH {_SC}, t AS (SELECT ref_id, max(points) AS top FROM sc GROUP BY 1), b AS (SELECT sc.ref_id, min(target) AS target, least(1, greatest(0, max(top) / 200.0::DOUBLE)) AS confidence FROM sc JOIN t ON t.ref_id = sc.ref_id WHERE points = top GROUP BY 1),
 a AS (SELECT ref_id, ref_id AS target, 0.88::DOUBLE AS confidence, 1 AS s FROM rf WHERE line % 2 = 0 UNION ALL SELECT ref_id, target, least(1.0::DOUBLE, confidence * 1.1), 2 FROM b UNION ALL SELECT ref_id, ref_id, CASE WHEN line % 9 = 0 THEN 0.7 ELSE 0.92 END, 0 FROM rf WHERE line % 3 = 0),
 f AS (SELECT ref_id, min(s) FILTER (confidence >= 0.9) AS sure, max(confidence) AS best FROM a GROUP BY 1) SELECT a.ref_id, a.target, a.confidence, ['framework', 'import', 'name'][a.s + 1] AS resolved_by FROM a JOIN f ON f.ref_id = a.ref_id WHERE a.s = coalesce(f.sure, (SELECT min(x.s) FROM a x WHERE x.ref_id = a.ref_id AND x.confidence = f.best))""")
def resolution_cascade(spark, sf):
    r = _refs(spark, sf)
    fixed = lambda cond, conf: r.where(cond).select("ref_id", F.col("ref_id").alias("target"), F.lit(conf).alias("confidence"))
    named = K.best_candidate(_scores(spark, sf)).select("ref_id", "target", F.least(F.lit(1.0), F.col("confidence") * 1.1).alias("confidence"))
    framework = fixed("line % 3 = 0 and line % 9 <> 0", 0.92).unionByName(fixed("line % 9 = 0", 0.7))
    return K.cascade(framework, fixed("line % 2 = 0", 0.88), named)


@c.query("SELECT * FROM (" + FX.values([("web/routes.js", "GET", "/items/:id"), ("web/routes.js", "POST", "/items"), ("web/routes.js", "DELETE", "/items/:id"), ("web/hooks.js", "GET", "web/hooks.js"), ("api/items.service.ts", "GET", "/health")]) + ") t(path, method, route)")
def http_routes(spark, sf):
    return K.routes(FX.files(spark).where("lang = 'js'"))


@c.query("SELECT * FROM (" + FX.values([("db/schema.prisma", "Item"), ("db/schema.prisma", "Owner"), ("db/drizzle.ts", "orders")]) + ") t(path, model)")
def data_models(spark, sf):
    rows = [("db/schema.prisma", "model Item {\n id Int\n}\nmodel Owner {\n}"), ("db/drizzle.ts", "export const table1 = pgTable('orders', {})"), ("db/none.ts", "const model = 1"), ("db/null.ts", None)]
    return K.models(spark.createDataFrame(rows, "path string, text string"))


@c.query(f"WITH {_F}, cl AS (SELECT path || '::Rows.' || name AS target, s.path, m.m AS method, r.r AS receiver FROM sym s, (VALUES ('push'), ('flush'), ('get')) m(m), (VALUES ('this.queue'), ('Map'), ('rows[0]'), ('allRows.x'), ('bag')) r(r)), k AS (SELECT *, lower(trim(regexp_extract(receiver, '^[^.\\[(]*'))) AS root FROM cl) SELECT target, method, receiver, root <> 'map' AND (method NOT IN ('push', 'get') OR regexp_matches(receiver, '^(this|self)(\\.|$)') OR root = 'rows' OR ends_with('rows', root) OR ends_with(root, 'rows')) AS trusted FROM k")
def member_call_gate(spark, sf):
    s = _symbols(spark, sf).select(F.concat("path", F.lit("::Rows."), "name").alias("target"))
    calls = s.withColumn("method", F.explode(F.array(*map(F.lit, ("push", "flush", "get"))))).withColumn("receiver", F.explode(F.array(*map(F.lit, ("this.queue", "Map", "rows[0]", "allRows.x", "bag")))))
    return calls.withColumn("trusted", K.trusted_member_call(F.col("receiver"), F.col("method"), F.col("target"), F.lit("other.mjs")))


@c.query("""WITH t AS (SELECT doc_id, text || ' ' || text || ' ' || text AS text FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1)) AS name FROM t) SELECT doc_id, name, count(*) AS n FROM p GROUP BY ALL HAVING n >= 3""")
def pascal_mentions(spark, sf):
    d = load(spark, sf, "documents").where("text is not null")
    return K.mentions(d.select("doc_id", F.concat_ws(" ", "text", "text", "text").alias("text")), most=1000).where("kind = 'pascal-case'").select("doc_id", "name", "n")


@c.query()
def entity_mentions(spark, sf):
    return K.mentions(load(spark, sf, "documents").where("text is not null").select("doc_id", "text"))


@c.query()
def extracted_code(spark, sf):
    """Python is parsed; mixed files that don't parse as Python are read line by line as JavaScript."""
    f = _files(spark, sf).withColumn("lang", F.when(F.contains("text", F.lit("export function")), "js").otherwise("py"))
    return K.extract(f)


def _index(spark):
    return K.indexed(K.extract(FX.files(spark)))


_SYMBOLS = [
    ("api/items.service.ts::ItemService", "class", None, 1, 9), ("api/items.service.ts::ItemService.health", "method", "ItemService", 6, 8), ("api/items.service.ts::STORE", "constant", None, 10, 10),
    ("sections/main.liquid::main", "section", None, 1, 3), ("snippets/price.liquid::price", "snippet", None, 1, 2),
    ("site/app.py::ping", "function", None, 2, 3), ("site/app.py::pong", "function", None, 5, 6),
    ("site/views.py::Base", "class", None, 1, 3), ("site/views.py::Base.get", "method", "Base", 2, 3), ("site/views.py::Detail", "class", None, 5, 7), ("site/views.py::Detail.post", "method", "Detail", 6, 7),
    ("site/views.py::home", "function", None, 9, 10), ("site/views.py::render", "function", None, 12, 13),
    ("src/OrderMapper.xml::Orders.cols", "mybatis-statement", "Orders", 2, 2), ("src/OrderMapper.xml::Orders.find", "mybatis-statement", "Orders", 3, 3),
    ("src/Orders.java::Orders", "class", None, 3, 11), ("src/Orders.java::Orders.close", "method", "Orders", 5, 7), ("src/Orders.java::Orders.count", "field", "Orders", 4, 4), ("src/Orders.java::Orders.save", "method", "Orders", 8, 10),
    ("ui/ItemBadge.vue::ItemBadge", "component", None, 1, 2), ("ui/UserCard.vue::UserCard", "component", None, 1, 13), ("ui/UserCard.vue::UserCard.open", "method", "UserCard", 8, 8),
    ("ui/Panel.svelte::Panel", "component", None, 1, 9), ("ui/Panel.svelte::Panel.ready", "method", "Panel", 3, 3), ("ui/Panel.svelte::Panel.title", "variable", "Panel", 2, 2), ("ui/Panel2.svelte::Panel2", "component", None, 1, 2),
    ("web/Card.jsx::Card", "function", None, 2, 5), ("web/Card.jsx::Badge", "function", None, 6, 8), ("web/handlers.js::show", "function", None, 1, 3), ("web/handlers.js::list", "function", None, 4, 6), ("web/handlers.js::load", "function", None, 7, 9),
    ("web/hooks.js::useItem", "function", None, 1, 3), ("web/hooks.js::GET", "function", None, 4, 6),
]
_RELATIONS = [
    ("api/items.service.ts::ItemService.health", "api/items.service.ts::ItemService", "MEMBER_OF", 6),
    ("sections/main.liquid::main", "gone", "RENDERS", 2), ("sections/main.liquid::main", "snippets/price.liquid::price", "RENDERS", 1),
    ("site/app.py::ping", "site/app.py::pong", "CALLS", 3), ("site/urls.py", "site/views.py", "IMPORTS", 1),
    ("site/views.py::Base.get", "site/views.py::render", "CALLS", 3), ("site/views.py::Base.get", "site/views.py::Base", "MEMBER_OF", 2), ("site/views.py::Detail", "site/views.py::Base", "EXTENDS", 5),
    ("site/views.py::Detail.post", "site/views.py::home", "CALLS", 7), ("site/views.py::Detail.post", "site/views.py::Detail", "MEMBER_OF", 6), ("site/views.py::home", "site/views.py::render", "CALLS", 10),
    ("src/OrderMapper.xml::Orders.cols", "src/Orders.java::Orders", "MEMBER_OF", 2), ("src/OrderMapper.xml::Orders.find", "src/Orders.java::Orders", "MEMBER_OF", 3), ("src/OrderMapper.xml::Orders.find", "src/OrderMapper.xml::Orders.cols", "CALLS", 3),
    ("src/Orders.java", "shop.Store", "IMPORTS", 2), ("src/Orders.java::Orders", "site/views.py::Base", "EXTENDS", 3), ("src/Orders.java::Orders", "Closing", "IMPLEMENTS", 3),
    ("src/Orders.java::Orders.close", "src/Orders.java::Orders.save", "CALLS", 6), ("src/Orders.java::Orders.close", "src/Orders.java::Orders", "MEMBER_OF", 5), ("src/Orders.java::Orders.count", "src/Orders.java::Orders", "MEMBER_OF", 4),
    ("src/Orders.java::Orders.save", "src/Orders.java::Orders.count", "CALLS", 9), ("src/Orders.java::Orders.save", "src/Orders.java::Orders", "MEMBER_OF", 8),
    ("ui/Panel.svelte::Panel.ready", "ui/Panel.svelte::Panel", "MEMBER_OF", 3), ("ui/Panel.svelte::Panel.title", "ui/Panel.svelte::Panel", "MEMBER_OF", 2), ("ui/UserCard.vue::UserCard.open", "ui/UserCard.vue::UserCard", "MEMBER_OF", 8),
    ("web/Card.jsx", "web/hooks.js", "IMPORTS", 1), ("web/Card.jsx::Card", "web/hooks.js::useItem", "CALLS", 3), ("web/handlers.js::list", "web/handlers.js::load", "CALLS", 5), ("web/handlers.js::show", "web/handlers.js::load", "CALLS", 2),
    ("web/hooks.js::GET", "web/hooks.js::useItem", "CALLS", 5), ("web/routes.js", "web/handlers.js", "IMPORTS", 1),
]


@c.query("SELECT * FROM (" + FX.values(_SYMBOLS) + ") t(id, kind, parent, line, line_end)")
def indexed_symbols(spark, sf):
    return _index(spark)[0].select("id", "kind", "parent", "line", "line_end")


@c.query("SELECT * FROM (" + FX.values(_RELATIONS) + ") t(src, dst, kind, line)")
def indexed_relations(spark, sf):
    return _index(spark)[1]


_EDGES = [
    ("web/routes.js", "web/handlers.js::show", "CALLS", 2, 0.85, "express"), ("web/routes.js", "web/handlers.js::list", "CALLS", 3, 0.85, "express"),
    ("app/routes.php", "app/UserController.php::UserController.index", "CALLS", 1, 0.88, "laravel"), ("app/routes.php", "resources/views/users/profile.blade.php::profile", "RENDERS", 2, 0.85, "laravel"),
    ("api/items.service.ts::ItemService", "api/items.service.ts::STORE", "CALLS", 2, 0.88, "nestjs"),
    ("web/Card.jsx::Card", "web/Card.jsx::Badge", "RENDERS", 4, 0.92, "react"), ("web/Card.jsx::Card", "web/hooks.js::useItem", "CALLS", 3, 0.88, "react"), ("web/hooks.js::GET", "web/hooks.js::useItem", "CALLS", 5, 0.88, "react"),
    ("ui/UserCard.vue::UserCard", "ui/ItemBadge.vue::ItemBadge", "RENDERS", 2, 0.9, "vue"),
    ("site/urls.py", "site/views.py::home", "CALLS", 2, 0.88, "django"), ("site/urls.py", "site/views.py::Detail", "CALLS", 2, 0.88, "django"), ("site/app.py", "site/app.py::ping", "CALLS", 1, 0.9, "django"),
    ("config/routes.rb", "app/users_controller.rb::UsersController.entry", "CALLS", 1, 0.88, "rails"), ("config/routes.rb", "app/orders_controller.rb::OrdersController", "CALLS", 2, 0.85, "rails"),
    ("ui/Panel.svelte::Panel", "ui/Panel2.svelte::Panel2", "RENDERS", 7, 0.9, "svelte"), ("ui/Panel.svelte::Panel", "ui/Panel.svelte::Panel.ready", "CALLS", 8, 0.85, "svelte"),
    ("sections/main.liquid", "snippets/price.liquid::price", "RENDERS", 1, 0.92, "shopify"),
]
_BY_FILE = {"express": "%.js", "laravel": "%.php", "nestjs": "%.ts", "react": "web/%", "vue": "%.vue", "django": "%.py", "rails": "%.rb", "svelte": "%.svelte", "shopify": "%.liquid"}


def _framework_edges(spark):
    more = spark.createDataFrame(FX.MORE_SYMBOLS, "id string, name string, path string, kind string, parent string, line int, line_end int")
    symbols = _index(spark)[0].select(*more.columns).unionByName(more)
    matches = None
    for name, files in _BY_FILE.items():
        one = K.framework_matches(FX.files(spark).where(F.col("path").like(files)), [name])
        matches = one if matches is None else matches.unionByName(one)
    return K.framework_edges(matches, symbols)


@c.query("SELECT src, dst, kind, line, CAST(confidence AS DOUBLE) AS confidence, 'framework:' || f AS resolved_by FROM (" + FX.values(_EDGES) + ") t(src, dst, kind, line, confidence, f)")
def framework_edges(spark, sf):
    return _framework_edges(spark)


@c.query("SELECT f AS framework, count(*) AS n FROM (" + FX.values(_EDGES) + ") t(src, dst, kind, line, confidence, f) GROUP BY 1")
def framework_counters(spark, sf):
    return K.framework_counts(_framework_edges(spark))


@c.query("""SELECT * FROM (VALUES ('Base.get', 'site/views.py::Base.get', 'member', []), ('useItem', 'web/hooks.js::useItem', 'name', []), ('web/hooks.js::GET', 'web/hooks.js::GET', 'id', []),
 ('orders', NULL, 'part', ['src/OrderMapper.xml::Orders.cols', 'src/OrderMapper.xml::Orders.find', 'src/Orders.java::Orders', 'src/Orders.java::Orders.close', 'src/Orders.java::Orders.count', 'src/Orders.java::Orders.save']), ('badge', NULL, 'part', ['ui/ItemBadge.vue::ItemBadge', 'web/Card.jsx::Badge']), ('e', NULL, 'part', []), ('nowhere', NULL, NULL, NULL)) t(wanted, id, stage, candidates)""")
def scoped_names(spark, sf):
    asked = spark.createDataFrame([(w,) for w in ("Base.get", "useItem", "web/hooks.js::GET", "orders", "badge", "e", "nowhere")], "wanted string")
    return K.scoped_names(_index(spark)[0], asked)


@c.query("""SELECT * FROM (VALUES ('web/hooks.js::useItem', 'framework:react', 2), ('web/handlers.js::show', 'framework:express', 1), ('site/views.py::home', 'framework:django', 1), ('site/views.py::home', 'name', 1)) t(start, resolved_by, n)""")
def caller_provenance(spark, sf):
    calls = _index(spark)[1].where("kind = 'CALLS'").select("src", "dst", F.col("line") + 1000, F.lit(None).cast("string")).toDF("src", "dst", "line", "resolved_by")
    edges = _framework_edges(spark).select("src", "dst", "line", "resolved_by").unionByName(calls)
    targets = spark.createDataFrame([(t,) for t in ("web/hooks.js::useItem", "web/handlers.js::show", "site/views.py::home", "ui/UserCard.vue::UserCard")], "start string")
    return K.provenance(edges, targets)


@c.query(f"WITH {_F} SELECT path, length(text) AS chars, len(string_split(text, chr(10))) AS lines FROM files")
def blanked_comments(spark, sf):
    """Blanking comments keeps every offset and line."""
    f = _files(spark, sf)
    bare = K.without_comments("c")(F.col("text"))
    return f.select("path", bare.alias("b")).select("path", F.length("b").cast("long").alias("chars"), F.size(F.split("b", "\n")).cast("long").alias("lines"))


@c.query("SELECT doc_id, list_sort(list_distinct(list_transform(list_concat(flatten(list_transform(regexp_extract_all(text, '[\\w.-]+(?:/[\\w.-]+)+'), lambda p: string_split(p, '/'))), regexp_extract_all(text, '`([^`\n]+)`', 1), regexp_extract_all(text, '\\b[A-Z]{2,10}:\\w+'), string_split_regex(trim(regexp_replace(text, '^WS+', '')), 'WS+')[1:5]), lambda w: lower(w)))) AS words FROM documents WHERE text IS NOT NULL".replace("WS", _WS))
def prompt_keywords(spark, sf):
    d = load(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.array_sort(K.prompt_keywords(F.col("text"))).alias("words"))


@c.query(f"WITH {_F}, i AS (SELECT regexp_extract(path, '[^/]+$') AS path, min(line) AS depth FROM sym GROUP BY 1), r AS (SELECT id, regexp_extract(path, '[^/]+$') AS path FROM sym) SELECT r.id AS rule_id, min(depth) AS depth FROM r JOIN i ON i.path = r.path GROUP BY 1")
def rules_at_risk(spark, sf):
    s = _symbols(spark, sf).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
    return K.files_at_risk(s.groupBy("path").agg(F.min("line").alias("depth")), s.select("id", "path"))


@c.query(f"""WITH {_F}, x AS (SELECT id, exported, CASE line % 3 WHEN 0 THEN 'app/handlers/a.ts' WHEN 1 THEN 'app/Controllers/b.ts' ELSE 'app/c.ts' END AS path, CASE line % 4 WHEN 0 THEN 'dispatch' WHEN 1 THEN 'boot' ELSE name END AS name, CASE WHEN line % 5 < 2 THEN 'method' ELSE 'function' END AS kind, CASE line % 7 WHEN 0 THEN 'ItemController' WHEN 1 THEN 'Item' END AS parent FROM sym),
 b AS (SELECT *, (path = 'app/handlers/a.ts' AND name IN ('handle', 'run', 'execute', 'process', 'dispatch', 'invoke', 'perform', 'fire', 'trigger', 'exec', 'call', '__invoke')) OR (kind = 'method' AND (path = 'app/Controllers/b.ts' OR coalesce(parent = 'ItemController', false))) AS bound FROM x) SELECT id, bound, exported OR bound OR (kind = 'method' AND parent IS NOT NULL) AS public FROM b""")
def public_symbols(spark, sf):
    """The functions of the test documents, dressed as members of controllers and handlers by their line."""
    n, w = F.col("line"), F.when
    s = _symbols(spark, sf).select("id", "exported", w(n % 3 == 0, "app/handlers/a.ts").when(n % 3 == 1, "app/Controllers/b.ts").otherwise("app/c.ts").alias("path"), w(n % 4 == 0, "dispatch").when(n % 4 == 1, "boot").otherwise(F.col("name")).alias("name"), w(n % 5 < 2, "method").otherwise("function").alias("kind"), w(n % 7 == 0, "ItemController").when(n % 7 == 1, "Item").alias("parent"))
    bound = K.framework_bound(F.col("path"), F.col("name"), F.col("parent"), F.col("kind"))
    return s.select("id", bound.alias("bound"), K.is_public(F.col("exported"), bound, F.col("kind"), F.col("parent")).alias("public"))


@c.query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(fix|bug|error|crash|broken|fail(s|ed|ing)?)\\b') THEN 'bug' WHEN regexp_matches(lower(text), '\\b(add|implement|create|build|feature|support)\\b') THEN 'feature' WHEN regexp_matches(lower(text), '\\b(how|why|what|where|explain|understand|explore|find)\\b') THEN 'exploration' END AS task FROM documents WHERE text IS NOT NULL")
def task_kinds(spark, sf):
    d = load(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", X.task_kind(F.col("text")).alias("task"))


QUERIES, SQL = c.QUERIES, c.SQL
