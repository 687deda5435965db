"""Queries of retrieval and its quality measures, and the quality checks of the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.catalog import fixtures as FX
from quern.catalog.code import _SYMBOLS
from quern.catalog.store import AS_OF, ENT, OBS, REL, SEARCH_TOKENS_SQL, _STOP, entities, first_project, observations, relations
from quern.functions import text as X
from quern.functions import vocab as V
from quern.operators import code as K
from quern.operators import metrics as M
from quern.operators import quality as Q
from quern.operators import retrieval as R
from quern.operators import store as S
from quern.plans.tables import load

c = Catalog()
DIMENSION = 64


def _docs(spark, sf):
    return load(spark, sf, "documents")


def _queries(spark, sf):
    """`query_id, text, terms`: every hundredth document asks for its first three longer words."""
    d = _docs(spark, sf).where("doc_id % 100 = 0 and text is not null")
    words = F.slice(F.array_distinct(F.filter(R.index_words(F.col("text")), lambda w: F.length(w) >= 5)), 1, 3)
    return d.select(F.col("doc_id").alias("query_id"), words.alias("terms")).where("size(terms) > 0")


def _terms(spark, sf):
    return _queries(spark, sf).select("query_id", F.explode("terms").alias("term"))


_Q = """q AS (SELECT doc_id AS query_id, list_distinct_ordered AS terms FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 5) AS w0 FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL),
 LATERAL (SELECT list(w ORDER BY p)[1:3] AS list_distinct_ordered FROM (SELECT w, min(p) AS p FROM (SELECT unnest(w0) AS w, generate_subscripts(w0, 1) AS p) GROUP BY w)) WHERE list_distinct_ordered IS NOT NULL),
qt AS (SELECT query_id, unnest(terms) AS term FROM q)"""
_BM25 = f"""{_Q}, tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS token FROM documents), post AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1),
 st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl), dfs AS (SELECT token, count(*)::DOUBLE AS df FROM post GROUP BY 1),
 s AS (SELECT t.query_id, p.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / avgdl))) AS score, count(*) AS hits FROM qt t JOIN post p ON p.token = t.term JOIN dfs ON dfs.token = t.term JOIN dl USING (doc_id), st GROUP BY ALL),
 bm AS (SELECT s.query_id, doc_id, score, row_number() OVER (PARTITION BY s.query_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, doc_id) AS rank FROM s JOIN q ON q.query_id = s.query_id WHERE hits = len(terms))"""


@c.query(f"WITH {_BM25} SELECT query_id, doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM bm WHERE rank <= 20")
def bm25_search(spark, sf):
    return R.bm25(_docs(spark, sf), _terms(spark, sf), 20).select("query_id", "doc_id", X.rounded(F.col("score"), 6).alias("score"))


@c.query("WITH t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS token FROM documents) SELECT token, count(*) AS df FROM t GROUP BY 1")
def document_frequency(spark, sf):
    return R.postings(_docs(spark, sf)).groupBy("token").agg(F.count("*").alias("df"))


@c.query(f"""WITH {_Q}, p AS (SELECT query_id, substr(term, 1, 4) AS term FROM qt GROUP BY ALL), tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM documents WHERE text IS NOT NULL),
 g AS (SELECT p.term, v.token FROM (SELECT DISTINCT term FROM p) p JOIN (SELECT DISTINCT token FROM tok) v ON starts_with(v.token, p.term)), h AS (SELECT DISTINCT p.query_id, p.term, t.doc_id FROM p JOIN g ON g.term = p.term JOIN tok t ON t.token = g.token), n AS (SELECT query_id, count(*) AS n FROM p GROUP BY 1)
 SELECT h.query_id, h.doc_id FROM h JOIN n ON n.query_id = h.query_id GROUP BY h.query_id, h.doc_id, n.n HAVING count(*) = n.n""")
def prefix_match(spark, sf):
    return R.prefix_match(_docs(spark, sf), _terms(spark, sf).select("query_id", F.substring("term", 1, 4).alias("term")))


def _cards(spark, sf):
    """Entities with their texts joined, as documents."""
    e = S.with_observations(entities(spark, sf).where("lifecycle = 'active'"), observations(spark, sf))
    return e.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "name", "entity_type").alias("name"), F.array_join("observations", " ").alias("text"), "project_id", F.col("name").alias("label"), "observations", "entity_type")


_CARDS = f"{ENT}, {OBS}, ob AS (SELECT entity_id, list(text ORDER BY seq) AS observations FROM obs GROUP BY 1), cards AS (SELECT e.id AS doc_id, e.name || ' ' || e.entity_type AS name, array_to_string(coalesce(ob.observations, []), ' ') AS text, e.project_id, e.name AS label, e.entity_type, coalesce(ob.observations, []) AS observations FROM ent e LEFT JOIN ob ON ob.entity_id = e.id WHERE e.lifecycle = 'active')"


def _prompts(spark, sf):
    o = observations(spark, sf).where("seq % 100 = 0")
    return o.select(F.col("seq").alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 6), " ").alias("text"))


_PROMPTS = "prompts AS (SELECT seq AS query_id, array_to_string(string_split_regex(text, '\\s+')[1:6], ' ') AS text FROM obs WHERE seq % 100 = 0)"
_IDENT = r"(length({w}) >= 3 AND (regexp_matches({w}, '\d{{3}}') OR contains({w}, '_') OR regexp_matches({w}, '\p{{Ll}}\p{{Lu}}') OR regexp_matches({w}, '\p{{Lu}}\p{{Lu}}\p{{Ll}}') OR regexp_matches({w}, '^[\p{{Lu}}\p{{N}}]*\p{{Lu}}[\p{{Lu}}\p{{N}}]*$')))"
_EXACT = f"""{_CARDS}, {_PROMPTS}, w AS (SELECT query_id, unnest(string_split_regex(text, '\\s+')) AS w FROM prompts), qw AS (SELECT query_id, unnest({SEARCH_TOKENS_SQL.format(t='w', stop=_STOP)}) AS term, CASE WHEN {_IDENT.format(w="regexp_extract(w, '[\\p{L}\\p{N}_]+')")} THEN 2 ELSE 1 END AS weight FROM w),
 qq AS (SELECT query_id, term, max(weight) AS weight FROM qw GROUP BY ALL), tk AS (SELECT doc_id, term, max(worth) AS worth FROM (SELECT doc_id, unnest({SEARCH_TOKENS_SQL.format(t='name', stop=_STOP)}) AS term, 5 AS worth FROM cards UNION ALL SELECT doc_id, unnest({SEARCH_TOKENS_SQL.format(t='text', stop=_STOP)}), 2 FROM cards) GROUP BY ALL),
 al AS (SELECT query_id, sum(weight) * 5 AS all_ FROM qq GROUP BY 1), sc AS (SELECT qq.query_id, tk.doc_id, sum(weight * worth) / any_value(all_) AS score FROM qq JOIN tk ON tk.term = qq.term JOIN al ON al.query_id = qq.query_id GROUP BY ALL),
 ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10)"""


def _exact(spark, sf):
    """Over a row for each entity's name and one for each of its texts: their tokens meet by entity, and no list of texts is built."""
    names = entities(spark, sf).where("lifecycle = 'active'").select(F.col("id").alias("doc_id"), F.concat_ws(" ", "name", "entity_type").alias("name"), F.lit("").alias("text"))
    texts = observations(spark, sf).select(F.col("entity_id").alias("doc_id"), F.lit("").alias("name"), "text").join(names.select("doc_id"), "doc_id", "left_semi")
    return R.exact_tokens(names.unionByName(texts), R.query_terms(_prompts(spark, sf)), 10)


@c.query(f"WITH {_EXACT} SELECT query_id, doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score, rank FROM ex")
def exact_token_search(spark, sf):
    return _exact(spark, sf).select("query_id", "doc_id", X.rounded(F.col("score"), 6).alias("score"), "rank")


@c.query(f"WITH {_EXACT}, p AS (SELECT ex.query_id, ex.doc_id, coalesce(project_id = (SELECT min(id) FROM projects), true) AS mine FROM ex JOIN cards USING (doc_id)) SELECT query_id, doc_id, NOT bool_or(mine) OVER (PARTITION BY query_id) AS fallback FROM p QUALIFY mine OR fallback")
def scoped_search(spark, sf):
    hits = _exact(spark, sf).join(entities(spark, sf).select(F.col("id").alias("doc_id"), "project_id"), "doc_id")
    mine = F.coalesce(F.col("project_id") == first_project(spark, sf), F.lit(True))
    return R.scope_first(hits, mine).select("query_id", "doc_id", "fallback")


@c.query("SELECT doc_id, (CASE WHEN contains(lower(text), 'cache') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'session') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'ledger') THEN 1 ELSE 0 END) / 3.0::DOUBLE AS score FROM documents WHERE text IS NOT NULL AND (contains(lower(text), 'cache') OR contains(lower(text), 'session') OR contains(lower(text), 'ledger'))")
def keyword_ratio(spark, sf):
    return _docs(spark, sf).where("text is not null").select("doc_id", R.keyword_ratio(F.col("text"), "cache session ledger a").alias("score")).where("score > 0")


_REC = """n AS (SELECT *, lower(label) AS ln, regexp_replace(lower(label), '[\\s\\-_]', '', 'g') AS flat FROM cards), r0 AS (SELECT doc_id AS id, label AS name, (CASE WHEN contains(ln, 'cache') THEN 5 WHEN len(list_filter(observations, lambda o: contains(lower(o), 'cache'))) > 0 THEN 2 WHEN contains(entity_type, 'cache') THEN 1 ELSE 0 END) + (CASE WHEN contains(ln, 'lease') THEN 5 WHEN len(list_filter(observations, lambda o: contains(lower(o), 'lease'))) > 0 THEN 2 WHEN contains(entity_type, 'lease') THEN 1 ELSE 0 END) AS points,
 CASE WHEN contains(flat, 'tindra') THEN 'match' WHEN contains(flat, 'kernel') OR contains(flat, 'marlow') THEN 'other' ELSE 'neutral' END AS scope FROM n), r1 AS (SELECT id, name, points + CASE scope WHEN 'match' THEN 3 WHEN 'other' THEN -2 ELSE 0 END AS score, scope FROM r0 WHERE points >= 2)"""


@c.query(f"WITH {_CARDS}, {_REC} SELECT * FROM r1 WHERE score >= 2 AND scope <> 'other' ORDER BY score DESC, name, id LIMIT 5")
def recall_scoring(spark, sf):
    cards = _cards(spark, sf).select(F.col("doc_id").alias("id"), F.col("label").alias("name"), "entity_type", "observations")
    return R.recall(cards, ["cache", "lease"], ["tindra"], ["tindra", "kernel", "marlow"])


def _vectors(spark, sf):
    return R.valid_vectors(load(spark, sf, "embeddings"), DIMENSION)


def _near(spark, sf, k=10):
    v = _vectors(spark, sf)
    return R.nearest(v, v.where("vec_id % 100 = 0"), k)


_KNN = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nn AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS similarity FROM v q, v WHERE q.vec_id % 100 = 0), knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM nn)"""


@c.query(f"WITH {_KNN} SELECT query_id, vec_id, rank, floor(similarity * 1e6 + 0.5) / 1e6 AS similarity FROM knn WHERE rank <= 10")
def knn_cosine(spark, sf):
    return _near(spark, sf).select("query_id", "vec_id", "rank", X.rounded(F.col("similarity"), 6).alias("similarity"))


@c.query("SELECT label, count(*) AS n, floor(avg(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) * 1e6 + 0.5) / 1e6 AS length FROM embeddings GROUP BY 1")
def vector_check(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))
    return _vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n"), X.rounded(F.avg(size), 6).alias("length"))


@c.query(f"WITH {_KNN}, d AS (SELECT query_id, vec_id AS doc_id, similarity FROM knn WHERE rank <= 40), s AS (SELECT d.*, floor((0.7::DOUBLE * greatest(0, similarity) + 0.3::DOUBLE * ((CASE WHEN contains(lower(text), 'cache') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'session') THEN 1 ELSE 0 END) / 2.0::DOUBLE)) * 1000 + 0.5) / 1000 AS score FROM d JOIN documents USING (doc_id)) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 0.1 QUALIFY rank <= 20")
def weighted_hybrid(spark, sf):
    near = _near(spark, sf, 40).select("query_id", F.col("vec_id").alias("doc_id"), "similarity")
    both = near.join(_docs(spark, sf).select("doc_id", "text"), "doc_id")
    score = R.weighted(F.col("similarity"), F.coalesce(R.keyword_ratio(F.col("text"), "cache session"), F.lit(0.0)))
    return R.top_k(both.select("query_id", "doc_id", score.alias("score")).where("score >= 0.1"), 20)


_RRF = f"{_KNN}, {_BM25}, lists AS (SELECT query_id, vec_id AS doc_id, rank, 0 AS source FROM knn WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm WHERE rank <= 30)"


def _lists(spark, sf):
    return _near(spark, sf, 30).select("query_id", F.col("vec_id").alias("doc_id"), "rank"), R.bm25(_docs(spark, sf), _terms(spark, sf), 30).select("query_id", "doc_id", "rank")


@c.query(f"WITH {_RRF}, f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, list_sort(list(source)) AS sources FROM lists GROUP BY ALL) SELECT query_id, doc_id, floor(score * 1e9 + 0.5) / 1e9 AS score, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10")
def rrf_fusion(spark, sf):
    out = R.fused(list(_lists(spark, sf)), 60, 10)
    return out.select("query_id", "doc_id", X.rounded(F.col("score"), 9).alias("score"), "sources", "rank")


def _asked(spark, sf):
    """`query_id, text`: every hundredth document asks with its first one to seven words."""
    words = F.slice(R.index_words(F.col("text")), F.lit(1), (F.floor(F.col("doc_id") / 100) % 7 + 1).cast("int"))
    return _docs(spark, sf).where("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.array_join(words, " ").alias("text")).where("text <> ''")


_ASKED = r"asked AS (SELECT doc_id AS query_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:(doc_id // 100) % 7 + 1] AS ws FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL), route AS (SELECT query_id, CASE WHEN len(ws) <= 2 THEN (30 + 120) / 2 WHEN len(ws) >= 5 THEN (120 + 30) / 2 ELSE (60 + 60) / 2 END::INT AS k FROM asked WHERE len(ws) > 0)"


@c.query(f"WITH {_ASKED} SELECT query_id, k FROM route")
def fusion_routing(spark, sf):
    return _asked(spark, sf).select("query_id", R.fusion_k(F.col("text")).alias("k"))


@c.query(f"""WITH {_RRF}, {_ASKED}, f AS (SELECT l.query_id, l.doc_id, sum(1.0::DOUBLE / (r.k + l.rank)) AS score, list_sort(list(l.source)) AS sources FROM lists l JOIN route r ON r.query_id = l.query_id WHERE l.rank <= 30 GROUP BY ALL),
 h AS (SELECT f.*, d.kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f.doc_id) AS rank FROM f JOIN documents d ON d.doc_id = f.doc_id WHERE d.text IS NOT NULL)
 SELECT query_id, doc_id, floor(score * 10000 + 0.5) / 10000 AS score, sources, kind, rank, query_id NOT IN (SELECT query_id FROM lists WHERE source = 0) AS degraded, CASE WHEN query_id NOT IN (SELECT query_id FROM lists WHERE source = 0) THEN 'no vectors' END AS reason FROM h WHERE rank <= 10""")
def hybrid_search(spark, sf):
    near, lex = _lists(spark, sf)
    return R.hybrid(near, lex, _asked(spark, sf), _docs(spark, sf).where("text is not null").select("doc_id", "kind"), 10)


def _scoped(spark, sf):
    """`query_id, term, project_id, global`: every hundredth observation asks with its first two longer words in the project of its entity."""
    o = observations(spark, sf).where("seq % 100 = 0").select("seq", "entity_id", "text")
    e = entities(spark, sf).select(F.col("id").alias("entity_id"), "project_id")
    words = F.slice(F.filter(R.index_words(F.col("text")), lambda w: F.length(w) >= 4), 1, 2)
    return o.join(e, "entity_id", "left").select(F.col("seq").alias("query_id"), F.explode(words).alias("term"), "project_id", (F.col("seq") % 200 == 0).alias("global"))


_SCOPED = r"""sq AS (SELECT o.seq AS query_id, unnest(list_filter(regexp_extract_all(lower(o.text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 4)[1:2]) AS term, e.project_id, o.seq % 200 = 0 AS global FROM obs o LEFT JOIN ent e ON e.id = o.entity_id WHERE o.seq % 100 = 0), st AS (SELECT DISTINCT query_id, term FROM sq), sp AS (SELECT DISTINCT query_id, project_id, global FROM sq), need AS (SELECT query_id, count(*) AS need FROM st GROUP BY 1)"""


@c.query(f"""WITH {ENT}, {OBS}, {_SCOPED}, act AS (SELECT * FROM ent WHERE lifecycle = 'active'), body AS (SELECT id AS doc_id, name AS t FROM act UNION ALL SELECT entity_id, text FROM obs WHERE lifecycle = 'active' AND entity_id IN (SELECT id FROM act)), tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+')) AS term FROM body),
 po AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS dl FROM tk GROUP BY 1), df AS (SELECT term, count(*)::DOUBLE AS df FROM po GROUP BY 1), g AS (SELECT (SELECT count(*) FROM act)::DOUBLE AS n, (SELECT count(*) FROM tk)::DOUBLE / (SELECT count(*) FROM act) AS avgdl),
 s AS (SELECT st.query_id, po.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS hits FROM st JOIN po ON po.term = st.term JOIN df ON df.term = st.term JOIN dl ON dl.doc_id = po.doc_id, g GROUP BY ALL),
 k AS (SELECT s.query_id, s.doc_id, floor(score * 1e9 + 0.5) / 1e9 AS score FROM s JOIN need USING (query_id) JOIN sp USING (query_id) JOIN act ON act.id = s.doc_id WHERE hits = need AND (act.project_id IS NOT DISTINCT FROM sp.project_id OR (sp.global AND act.project_id IS NULL))),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM k) SELECT query_id, doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM r WHERE rank <= 20""")
def scoped_bm25(spark, sf):
    out = R.scoped_bm25(entities(spark, sf), observations(spark, sf), _scoped(spark, sf), 20)
    return out.select("query_id", "doc_id", X.rounded(F.col("score"), 6).alias("score"))


@c.query(f"""WITH {ENT}, {OBS}, {_SCOPED}, gone AS (SELECT * FROM ent WHERE lifecycle = 'archived'), body AS (SELECT id AS doc_id, name AS t FROM gone UNION ALL SELECT entity_id, text FROM obs WHERE entity_id IN (SELECT id FROM gone)), tk AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+')) AS term FROM body),
 h AS (SELECT st.query_id, tk.doc_id, count(*) AS hits FROM st JOIN tk USING (term) GROUP BY ALL) SELECT h.query_id, h.doc_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY h.query_id ORDER BY gone.name, h.doc_id) AS rank FROM h JOIN need USING (query_id) JOIN gone ON gone.id = h.doc_id WHERE hits = need QUALIFY rank <= 20""")
def archived_search(spark, sf):
    return R.archived_search(entities(spark, sf), observations(spark, sf), _scoped(spark, sf), 20)


_CODE_ASKED = [(1, "load list"), (2, "User-card open"), (3, "orders_save x"), (4, "nothing here"), (5, "")]
_CODE_NEAR = [(1, "web/Card.jsx::Card", 0.9), (4, "site/views.py::home", 0.25), (4, "site/views.py::render", 0.2), (1, "web/handlers.js::load", -0.5), (5, "web/hooks.js::GET", 0.5)]


@c.query(f"""WITH sym(id, name) AS (VALUES {', '.join(f"('{i}', '{i.split('::')[1].split('.')[-1]}')" for i, *_ in _SYMBOLS)}), q(query_id, text) AS (VALUES {', '.join(str(a) for a in _CODE_ASKED)}), nr(query_id, id, similarity) AS (VALUES {', '.join(str(a) for a in _CODE_NEAR)}),
 qt AS (SELECT query_id, list_distinct(list_filter(string_split_regex(lower(text), '[\\s_\\-]+'), lambda t: length(t) > 1)) AS ts FROM q), kw AS (SELECT query_id, id, len(list_filter(ts, lambda t: contains(lower(name || ' ' || id), t))) / len(ts)::DOUBLE AS kw FROM qt, sym WHERE len(ts) > 0 AND kw > 0),
 b AS (SELECT coalesce(kw.query_id, nr.query_id) AS query_id, coalesce(kw.id, nr.id) AS id, floor((0.7::DOUBLE * greatest(0, coalesce(similarity, 0)) + 0.3::DOUBLE * coalesce(kw, 0)) * 1000 + 0.5) / 1000 AS score FROM kw FULL JOIN nr ON kw.query_id = nr.query_id AND kw.id = nr.id)
 SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b WHERE score >= 0.15 QUALIFY rank <= 20""")
def code_semantic_search(spark, sf):
    symbols = K.indexed(K.extract(FX.files(spark)))[0].select("id", "name")
    near = spark.createDataFrame(_CODE_NEAR, "query_id int, id string, similarity double")
    return R.code_search(symbols, spark.createDataFrame(_CODE_ASKED, "query_id int, text string"), near)


@c.query("SELECT * FROM (VALUES ('web/hooks.js::useItem', 'useItem function hooks.js called-by web/Card.jsx::Card, web/hooks.js::GET'), ('web/hooks.js::GET', 'GET function hooks.js calls web/hooks.js::useItem'), ('site/views.py::render', 'render function views.py called-by site/views.py::Base.get, site/views.py::home'), ('site/views.py::home', 'home function views.py called-by site/views.py::Detail.post calls site/views.py::render')) t(id, text)")
def symbol_texts(spark, sf):
    symbols, rel = K.indexed(K.extract(FX.files(spark)))
    calls = rel.where("kind = 'CALLS'")
    ins = calls.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("callers"))
    outs = calls.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("callees"))
    none = F.array().cast("array<string>")
    s = symbols.where(F.col("id").isin("web/hooks.js::useItem", "web/hooks.js::GET", "site/views.py::render", "site/views.py::home")).join(ins, "id", "left").join(outs, "id", "left")
    return s.select("id", R.embed_text(F.col("name"), F.col("kind"), F.col("path"), F.coalesce("callers", none), F.coalesce("callees", none)).alias("text"))


@c.query(f"WITH {_RRF}, l AS (SELECT query_id, source, doc_id, 1 - (rank - 1) / count(*) OVER (PARTITION BY query_id, source)::DOUBLE AS score FROM lists), r AS (SELECT query_id, CASE source WHEN 0 THEN 'code' ELSE 'knowledge' END AS source, CAST(doc_id AS VARCHAR) AS doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE source WHEN 0 THEN 'code' ELSE 'knowledge' END, CAST(doc_id AS VARCHAR)) AS rank FROM l) SELECT * FROM r WHERE rank <= 20")
def unified_search(spark, sf):
    near, lex = _lists(spark, sf)
    return R.united({"code": near, "knowledge": lex}).withColumn("score", X.rounded(F.col("score"), 6))


@c.query("WITH s AS (SELECT doc_id, replace(lower(source), '-', ' ') AS n, lower(kind || ' ' || coalesce(lang, '')) AS t, lower(text) AS d FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, list_sum(list_transform(['session', 'incident', 'cache'], lambda w: CASE WHEN contains(n, w) THEN 5 WHEN contains(t, w) THEN 3 WHEN contains(d, w) THEN 1 ELSE 0 END)) AS p FROM s) SELECT doc_id, floor(p / 15.0::DOUBLE * 100 + 0.5) / 100 AS score FROM p WHERE floor(p / 15.0::DOUBLE * 100 + 0.5) / 100 >= 0.1 ORDER BY score DESC, doc_id LIMIT 5")
def skill_search(spark, sf):
    d = _docs(spark, sf).where("text is not null")
    terms = ["session", "incident", "cache"]
    scored = d.select("doc_id", R.skill_score(F.col("source"), F.array_compact(F.array("kind", "lang")), F.col("text"), terms).alias("score")).where("score >= 0.1")
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(5)


_NDCG = f"""{_KNN}, res AS (SELECT k.query_id, k.vec_id, rank - 1 AS rank, v.label = q.label AS hit FROM knn k JOIN v ON v.vec_id = k.vec_id JOIN v q ON q.vec_id = k.query_id WHERE rank BETWEEN 2 AND 11), n AS (SELECT q.vec_id AS query_id, least(count(*), 10) AS n FROM v q JOIN v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1)"""


@c.query(f"WITH {_NDCG}, h AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, 1 / min(rank) AS mrr FROM res WHERE hit GROUP BY 1) SELECT n.query_id, floor(coalesce(dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))), 0) * 1e6 + 0.5) / 1e6 AS ndcg, floor(coalesce(mrr, 0) * 1e6 + 0.5) / 1e6 AS mrr FROM n LEFT JOIN h USING (query_id)")
def ndcg_mrr(spark, sf):
    v = _vectors(spark, sf)
    near = _near(spark, sf, 11).where("rank > 1").withColumn("rank", F.col("rank") - 1)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = q.join(v.select("vec_id", "label"), "label").where("vec_id <> query_id").select("query_id", "vec_id")
    out = M.ranked_quality(near, relevant, 10, key="vec_id")
    return out.select("query_id", X.rounded(F.col("ndcg"), 6).alias("ndcg"), X.rounded(F.col("mrr"), 6).alias("mrr"))


@c.query(f"WITH {_KNN} SELECT query_id, count(*) FILTER (v.label = q.label) / 10.0::DOUBLE AS recall FROM knn k JOIN v ON v.vec_id = k.vec_id JOIN v q ON q.vec_id = k.query_id WHERE rank <= 10 GROUP BY 1")
def recall_at_k(spark, sf):
    """How much of the exact neighbours a search among vectors of the query's label alone would find."""
    v = _vectors(spark, sf).select("vec_id", "label")
    same = _near(spark, sf, 30).join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q")), "query_id").where("label = q")
    again = R.top_k(same.select("query_id", "vec_id", "similarity"), 10, key="vec_id", score="similarity")
    return M.recall_at_k(again, _near(spark, sf, 10), 10, key="vec_id")


@c.query(f"WITH one AS ({c.SQL['ndcg_mrr']}) SELECT e.label AS tier, count(*) AS queries, floor(avg(ndcg) * 1e5 + 0.5) / 1e5 AS ndcg, floor(avg(mrr) * 1e5 + 0.5) / 1e5 AS mrr FROM one JOIN embeddings e ON e.vec_id = one.query_id GROUP BY 1")
def ndcg_by_tier(spark, sf):
    tiers = _vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("label").alias("tier"))
    out = ndcg_mrr(spark, sf).join(tiers, "query_id").groupBy("tier")
    return out.agg(F.count("*").alias("queries"), X.rounded(F.avg("ndcg"), 5).alias("ndcg"), X.rounded(F.avg("mrr"), 5).alias("mrr"))


# --- quality ---


@c.query(f"WITH {OBS} SELECT entity_name, count(*) AS texts, max(datediff('day', try_cast(obs_date AS DATE), DATE '{AS_OF}')) AS oldest FROM obs WHERE datediff('day', try_cast(obs_date AS DATE), DATE '{AS_OF}') > 180 GROUP BY 1")
def stale_report(spark, sf):
    return Q.stale_report(observations(spark, sf), AS_OF).withColumn("oldest", F.col("oldest").cast("long"))


@c.query(f"WITH {ENT} SELECT lower(name) AS key, count(*) AS n FROM ent GROUP BY 1 HAVING n > 1")
def duplicate_names(spark, sf):
    return Q.duplicate_names(entities(spark, sf))


@c.query(f"WITH {ENT}, {REL} SELECT id, name FROM ent WHERE lifecycle = 'active' AND name NOT IN (SELECT from_name FROM rel WHERE from_name IS NOT NULL UNION SELECT to_name FROM rel WHERE to_name IS NOT NULL)")
def orphan_entities(spark, sf):
    return Q.orphans(entities(spark, sf).where("lifecycle = 'active'"), relations(spark, sf)).select("id", "name")


@c.query(f"WITH {ENT}, {REL}, s AS (SELECT name, bool_or(lifecycle <> 'archived') AS alive FROM ent GROUP BY 1), d AS (SELECT r.id, list_filter([CASE WHEN a.name IS NULL THEN 'from_name missing' WHEN NOT a.alive THEN 'from_name archived' END, CASE WHEN b.name IS NULL THEN 'to_name missing' WHEN NOT b.alive THEN 'to_name archived' END], lambda x: x IS NOT NULL) AS reasons FROM rel r LEFT JOIN s a ON a.name = r.from_name LEFT JOIN s b ON b.name = r.to_name) SELECT * FROM d WHERE len(reasons) > 0")
def dangling_relations(spark, sf):
    return Q.dangling(relations(spark, sf), entities(spark, sf)).select("id", "reasons")


@c.query(f"WITH {REL} SELECT relation_type, count(*) AS n FROM rel WHERE relation_type NOT IN ({', '.join(repr(t) for t in V.RELATION_TYPES)}) GROUP BY 1")
def relation_vocabulary(spark, sf):
    return Q.unknown_types(relations(spark, sf))


def _full(spark, sf):
    return S.with_observations(entities(spark, sf).where("lifecycle = 'active'"), observations(spark, sf))


_RULES = ", ".join(f"('{t}', {p.split()!r}, {n}, {k.split()!r})" for t, (p, n, k) in V.ENTITY_RULES.items())


@c.query(f"""WITH {ENT}, {OBS}, rules(t, prefixes, least, req) AS (VALUES {_RULES}), o AS (SELECT entity_id, list(text) AS o FROM obs GROUP BY 1), e AS (SELECT e.id, e.name, e.entity_type, coalesce(o.o, []) AS o, r.* FROM ent e LEFT JOIN o ON o.entity_id = e.id LEFT JOIN rules r ON r.t = e.entity_type WHERE e.lifecycle = 'active'),
 m AS (SELECT *, list_sort(list_filter(req, lambda k: NOT list_contains(list_transform(o, lambda x: regexp_extract(regexp_replace(x, '^\\[[^\\]]*\\]\\s*', ''), '^([A-Z][A-Z0-9_]{{1,24}})\\s*:', 1)), k))) AS missing FROM e),
 p AS (SELECT id, CASE WHEN t IS NULL THEN ['type'] ELSE list_filter([CASE WHEN NOT list_contains(prefixes, upper(trim(split_part(name, ':', 1)))) THEN 'prefix' END, CASE WHEN len(o) < least THEN 'few' END, CASE WHEN len(missing) > 0 THEN 'missing ' || array_to_string(missing, ',') END], lambda x: x IS NOT NULL) END AS problems FROM m) SELECT * FROM p WHERE len(problems) > 0""")
def schema_conformance(spark, sf):
    return Q.schema_problems(_full(spark, sf)).select("id", "problems")


_QSTOP = "[" + ", ".join(f"'{w}'" for w in V.QUALITY_STOP) + "]"
_MODS = "['arch', 'code', 'int', 'integration', 'decision', 'person', 'config', 'stack', 'biz', 'tech', 'rule', 'flow', 'entity', 'incident', 'gotcha']"
# entities that share rare words, written down here since those of the test tables share none: two pairs that go together, one of them linked, and one of another scope
_ALIKE = [("fx-1", "BIZ:Zanzibar:Harbour", "biz-domain"), ("fx-2", "RULE:zan-zibar:Mooring", "biz-rule"), ("fx-3", "FLOW:Zanzibar:Docking", "biz-flow"), ("fx-4", "RULE:Elsewhere:Mooring", "biz-rule")]
_ALIKE_TEXTS = [("fx-1", "first"), ("fx-1", "quay bollardxx"), ("fx-1", "third"), ("fx-1", "hawserxx capstanxx"), ("fx-2", "bollardxx and hawserxx"), ("fx-3", "capstanxx, bollardxx!"), ("fx-4", "bollardxx hawserxx")]
_MISSING = f"""al AS (SELECT id, name, entity_type FROM ent WHERE lifecycle = 'active' UNION ALL {FX.values(_ALIKE)}), said AS (SELECT id, name AS t FROM al UNION ALL SELECT entity_id, text FROM obs WHERE entity_id IN (SELECT id FROM al) UNION ALL {FX.values(_ALIKE_TEXTS)}),
 sg AS (SELECT id, name, entity_type, list_filter(list_transform(list_filter(list_transform(string_split(name, ':'), lambda p: trim(p)), lambda p: p <> '')[2:], lambda p: regexp_replace(lower(p), '[\\s\\-_]', '', 'g')), lambda p: NOT list_contains({_MODS}, p))[1] AS scope FROM al),
 tk AS (SELECT DISTINCT id, unnest(list_filter(string_split_regex(regexp_replace(lower(t), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains({_QSTOP}, w))) AS token FROM said),
 rare AS (SELECT token, count(*) AS df FROM tk GROUP BY 1 HAVING df BETWEEN 2 AND 5 AND df <= greatest(2, floor((SELECT count(*) FROM al) * 0.05))), rt AS (SELECT sg.*, tk.token, df FROM tk JOIN rare USING (token) JOIN sg ON sg.id = tk.id WHERE scope IS NOT NULL),
 prs AS (SELECT a.id AS a, b.id AS b, a.name AS an, b.name AS bn, count(*) AS shared, least(1.0::DOUBLE, sum(1.0::DOUBLE / a.df)) AS confidence FROM rt a JOIN rt b ON a.token = b.token AND a.scope = b.scope AND a.id < b.id WHERE least(a.entity_type, b.entity_type) || '|' || greatest(a.entity_type, b.entity_type) IN ({', '.join(repr(t) for t in V.TYPE_PAIRS)}) GROUP BY ALL HAVING shared >= 2),
 lk AS (SELECT from_name AS f, to_name AS t FROM rel UNION ALL SELECT 'FLOW:Zanzibar:Docking', 'BIZ:Zanzibar:Harbour'), alike AS (SELECT *, EXISTS (SELECT 1 FROM lk WHERE (f = an AND t = bn) OR (f = bn AND t = an)) AS related FROM prs)"""


def _alike(spark, sf):
    e = entities(spark, sf).where("lifecycle = 'active'").select("id", "name", "entity_type").unionByName(spark.createDataFrame(_ALIKE, "id string, name string, entity_type string"))
    texts = observations(spark, sf).select(F.col("entity_id").alias("id"), "text").unionByName(spark.createDataFrame(_ALIKE_TEXTS, "id string, text string"))
    links = relations(spark, sf).select("from_name", "to_name").unionByName(spark.createDataFrame([("FLOW:Zanzibar:Docking", "BIZ:Zanzibar:Harbour")], "from_name string, to_name string"))
    return Q.alike_pairs(e, texts, links)


@c.query(f"WITH {ENT}, {OBS}, {REL}, {_MISSING} SELECT a, b, shared, floor(confidence * 1e6 + 0.5) / 1e6 AS confidence FROM alike WHERE NOT related")
def missing_relations(spark, sf):
    return _alike(spark, sf).where("not related").select("a", "b", "shared", X.rounded(F.col("confidence"), 6).alias("confidence"))


def _checks(spark, sf):
    e, o, r = entities(spark, sf), observations(spark, sf), relations(spark, sf)
    active = e.where("lifecycle = 'active'")
    one = lambda name, df, bad, total: df.agg(F.coalesce(bad, F.lit(0)).cast("long").alias("violations"), F.coalesce(total, F.lit(0)).cast("long").alias("total")).select(F.lit(name).alias("check"), "violations", "total")
    n = F.count("*")
    counted = lambda name, part, whole: part.agg(n.alias("violations")).crossJoin(whole.agg(n.alias("total"))).select(F.lit(name).alias("check"), "violations", "total")
    parts = [
        one("stale", Q.stale_texts(o, AS_OF), F.count_if("stale"), n),
        Q.duplicate_names(e).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).crossJoin(e.agg(n.alias("total"))).select(F.lit("duplicates").alias("check"), "violations", "total"),
        counted("orphans", Q.orphans(active, r), active),
        one("low_confidence", o.where("confidence is not null"), F.count_if(F.col("confidence") < Q.LOW), n),
        _alike(spark, sf).agg(F.count_if(~F.col("related")).alias("violations"), n.alias("total")).select(F.lit("missing_relations").alias("check"), "violations", "total"),
        counted("schema", Q.schema_problems(_full(spark, sf)), active),
        counted("dangling", Q.dangling(r, e), r),
        Q.unknown_types(r).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).crossJoin(r.agg(n.alias("total"))).select(F.lit("vocabulary").alias("check"), "violations", "total"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return Q.report(rows)


_SCHEMA = c.SQL["schema_conformance"].split("WITH ", 1)[1].rsplit("SELECT * FROM p", 1)[0]
_CHECKS = f"""{REL}, {_SCHEMA}, {_MISSING}, st AS (SELECT name, bool_or(lifecycle <> 'archived') AS alive FROM ent GROUP BY 1), dated AS (SELECT datediff('day', try_cast(obs_date AS DATE), DATE '{AS_OF}') AS age FROM obs WHERE try_cast(obs_date AS DATE) IS NOT NULL),
 ends AS (SELECT from_name AS name FROM rel UNION SELECT to_name FROM rel), act AS (SELECT * FROM ent WHERE lifecycle = 'active'),
 ck("check", violations, total, weight, least) AS (SELECT 'stale', (SELECT count(*) FROM dated WHERE age > 180), (SELECT count(*) FROM dated), 0.2::DOUBLE, 0.05::DOUBLE UNION ALL SELECT 'duplicates', (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM ent GROUP BY lower(name))), (SELECT count(*) FROM ent), 0.25, 0
 UNION ALL SELECT 'orphans', (SELECT count(*) FROM act WHERE NOT EXISTS (SELECT 1 FROM ends WHERE ends.name = act.name)), (SELECT count(*) FROM act), 0.2, 0.1 UNION ALL SELECT 'low_confidence', (SELECT count(*) FROM obs WHERE confidence < 0.3), (SELECT count(*) FROM obs WHERE confidence IS NOT NULL), 0.2, 0.15
 UNION ALL SELECT 'schema', (SELECT count(*) FROM p WHERE len(problems) > 0), (SELECT count(*) FROM act), 0.1, 0.2 UNION ALL SELECT 'dangling', (SELECT count(*) FROM rel r LEFT JOIN st a ON a.name = r.from_name LEFT JOIN st b ON b.name = r.to_name WHERE a.name IS NULL OR b.name IS NULL OR NOT a.alive OR NOT b.alive), (SELECT count(*) FROM rel), 0.15, 0
 UNION ALL SELECT 'missing_relations', (SELECT count(*) FROM alike WHERE NOT related), (SELECT count(*) FROM alike), 0, NULL UNION ALL SELECT 'vocabulary', (SELECT count(*) FROM rel WHERE relation_type NOT IN ({', '.join(repr(t) for t in V.RELATION_TYPES)})), (SELECT count(*) FROM rel), 0, NULL),
 rep AS (SELECT "check", violations::BIGINT AS violations, total, weight, total = 0 AS skipped, least IS NULL OR total = 0 OR CASE WHEN least = 0 THEN violations = 0 ELSE violations / total::DOUBLE < least END AS passed FROM ck)"""


@c.query(f"WITH {_CHECKS} SELECT * FROM rep")
def health_checks(spark, sf):
    return _checks(spark, sf)


@c.query(f"WITH {_CHECKS} SELECT CAST(floor((1 - sum(CASE WHEN NOT passed THEN weight * least(2 * violations / total::DOUBLE, 1) ELSE 0 END)) * 100 + 0.5) AS BIGINT) AS score FROM rep")
def health_score(spark, sf):
    return Q.health_score(_checks(spark, sf))


@c.query(f"""WITH {OBS}, r AS (SELECT id, entity_id, nullif(lower(regexp_extract(text, '^(\\w+):', 1)), '') AS prefix, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[\\t-\\r ]+'), lambda w: w <> ''))) AS words FROM obs WHERE entity_id IS NOT NULL), s AS (SELECT entity_id, prefix, words, min(id) AS id FROM r WHERE prefix IS NOT NULL GROUP BY ALL),
 p AS (SELECT a.entity_id, a.prefix, a.id AS a, b.id AS b, len(list_intersect(a.words, b.words)) / greatest(len(a.words), len(b.words))::DOUBLE AS overlap FROM s a JOIN s b ON a.entity_id = b.entity_id AND a.prefix = b.prefix AND a.id < b.id) SELECT * FROM p WHERE overlap > 0.5 AND overlap < 1""")
def contradictions(spark, sf):
    return Q.contradictions(observations(spark, sf))


@c.query(f"""WITH {OBS}, f AS (SELECT DISTINCT entity_id, nullif(regexp_extract(text, '^([A-Z]{{2,10}}):', 1), '') AS cat FROM obs WHERE seq % 7 = 0 AND nullif(regexp_extract(text, '^([A-Z]{{2,10}}):', 1), '') IS NOT NULL) SELECT o.id, f.cat IS NOT NULL AS archived FROM obs o LEFT JOIN f ON f.entity_id = o.entity_id AND f.cat = regexp_extract(o.text, '^([A-Z]{{2,10}}):', 1) WHERE o.seq % 7 <> 0""")
def superseded_observations(spark, sf):
    o = observations(spark, sf)
    return Q.superseded(o.where("seq % 7 <> 0").drop("category"), o.where("seq % 7 = 0")).select("id", "archived")


@c.query(f"WITH {ENT}, {OBS}, g AS (SELECT lower(name) AS key, min(id) AS keep_id, count(*) AS merged FROM ent GROUP BY 1 HAVING merged > 1), t AS (SELECT lower(e.name) AS key, count(DISTINCT o.text) AS texts FROM ent e JOIN obs o ON o.entity_id = e.id GROUP BY 1) SELECT g.*, coalesce(t.texts, 0) AS texts FROM g LEFT JOIN t USING (key)")
def consolidation(spark, sf):
    return Q.consolidated(entities(spark, sf), observations(spark, sf))


@c.query(f"""WITH {ENT}, {REL}, m AS (SELECT id, min(id) OVER (PARTITION BY lower(name)) AS keep_id FROM ent), r AS (SELECT r.id, coalesce(a.keep_id, r.from_entity_id) AS f, coalesce(b.keep_id, r.to_entity_id) AS t, relation_type FROM rel r LEFT JOIN m a ON a.id = r.from_entity_id LEFT JOIN m b ON b.id = r.to_entity_id)
 SELECT id, CASE WHEN f = t THEN 'self' WHEN id <> min(id) OVER (PARTITION BY f, t, relation_type) THEN 'duplicate' ELSE 'kept' END AS outcome FROM r""")
def relation_repoint(spark, sf):
    e = entities(spark, sf)
    merges = e.select("id", F.lower("name").alias("key")).join(e.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("keep_id")), "key").select("id", "keep_id")
    return Q.repointed(relations(spark, sf), merges).select("id", "outcome")


QUERIES, SQL = c.QUERIES, c.SQL
