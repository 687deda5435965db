"""The operators of the store, retrieval, graph, ledger, code and streams on small fixtures: nulls, ties, repeats, empty tables."""

import datetime as dt
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import code as K
from quern.operators import graph as G
from quern.operators import ledger as E
from quern.operators import logs as LG
from quern.operators import metrics as M
from quern.operators import quality as Q
from quern.operators import retrieval as R
from quern.operators import store as S
from quern.operators import sync as Y
from quern.sources import lines as L
from quern.streaming import folds
from quern.streaming.run import run_once

T0 = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
ENT = "project_id string, name string, entity_type string, lifecycle string, observations array<string>"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    t = F.col("t")
    assert tuple(one(spark, X.parse_observation(t), t="[0.95|2025-01-02] RULE: x")) == (0.95, "2025-01-02", "RULE: x")
    assert tuple(one(spark, X.parse_observation(t), t="[9.5] y")) == (1.0, None, "y") and tuple(one(spark, X.parse_observation(t), t="z"))[0] == 0.8
    assert set(one(spark, X.search_tokens(t), t="the getUserName HTTPServer v2 is ok")) >= {"getusername", "user", "name", "httpserver", "http", "server"}
    assert one(spark, X.search_tokens(t), t=None) is None and one(spark, X.search_tokens(t), t="") == []
    assert one(spark, X.resolve_module(F.col("a"), F.col("b")), a="src/lib/x.ts", b="../util/./y") == "src/util/y" and one(spark, X.resolve_module(F.col("a"), F.col("b")), a="x.ts", b="react") is None
    assert one(spark, X.shared_segments(F.col("a"), F.col("b")), a="a/b/c.ts", b="a/b/d.ts") == 2 and one(spark, X.shared_segments(F.col("a"), F.col("b")), a="a", b="a") == 1
    assert one(spark, X.error_fingerprint(t), t="ok\nError: ENOENT /srv/a/b.js at 12 deadbeef99") == "Error: ENOENT <path> at <n> <hash>"
    assert one(spark, X.error_marker(t), t="fine") is None and one(spark, X.error_marker(t), t="  Error: x") == "Error:"
    assert one(spark, X.hmac_sha256(b"k" * 70, t), t="é") == hmac.new(b"k" * 70, "é".encode(), hashlib.sha256).hexdigest()
    assert one(spark, X.output_text(t), t='{"content": [{"text": "a"}, {"text": "b"}]}') == "a\nb" and one(spark, X.output_text(t), t="{broken") == "{broken"
    assert one(spark, X.capped_output(t, 10), t="123456789\nabcdef") == "123456789" and one(spark, X.capped_output(t, 10), t="x" * 20) == "x" * 10
    assert one(spark, X.write_problems(F.lit("RULE:A:b"), F.array(F.lit("[2.0] x")))) == ["confidence"] and one(spark, X.write_problems(F.lit("x"), F.array(F.lit("y")))) == ["name", "tier"]
    assert one(spark, X.recall_gate(t), t="fix parseConfig") == "code token" and one(spark, X.recall_gate(t), t=" ") == "empty" and one(spark, X.recall_gate(t), t="hello there") == "short"
    assert one(spark, X.normal_message(t), t='token=abc "quoted" 3.5 https://a.b/c') == "<secret> <quoted> <number> <url>"


def test_store_merges_and_moves(spark):
    old = spark.createDataFrame([(None, "A:B:c", "tech-stack", "candidate", ["x"]), ("p", "A:B:c", "tech-stack", "active", ["x"]), ("p", "K:L:m", "biz-rule", "active", [])], ENT)
    new = spark.createDataFrame([(None, "A:B:c", "tech-stack", "active", ["x", "y", "y"]), ("p", "A:B:c", "biz-rule", "active", ["z"]), ("q", "N:O:p", "biz-flow", "active", ["o", "o"])], ENT)
    got = {(r["project_id"], r["name"]): (r["outcome"], r["lifecycle"], r["observations"]) for r in S.merge_entities(old, new).collect()}
    assert got == {(None, "A:B:c"): ("merged", "candidate", ["x", "y"]), ("p", "A:B:c"): ("conflict", "active", ["x"]), ("p", "K:L:m"): ("kept", "active", []), ("q", "N:O:p"): ("created", "active", ["o"])}
    assert S.merge_entities(old.limit(0), new.limit(0)).count() == 0
    ids = spark.createDataFrame([("1", "candidate"), ("2", "rejected")], "id string, lifecycle string")
    ask = spark.createDataFrame([("1", "active"), ("2", "active"), ("2", "rejected"), ("9", "active")], "id string, to string")
    assert sorted(tuple(r)[-1] for r in S.transition(ids, ask).collect()) == ["illegal", "missing", "moved", "same"]
    lines = spark.createDataFrame([(1, '{"type":"entity","name":"a","entityType":"t","observations":["x"]}'), (2, "{broken"), (3, ""), (4, '{"type":"entity","name":"a","entityType":"u","observations":null}'), (5, '{"type":"relation","from":"a","to":"b"}'), (6, "[1]")], "n int, value string")
    p = L.parsed_lines(lines)
    assert tuple(L.line_counts(p).first()) == (5, 2, 2, 1, 1)
    assert [tuple(r)[:2] for r in L.last_entities(p, "n").collect()] == [("a", "u")]
    assert tuple(L.line_counts(p.limit(0)).first()) == (0, 0, 0, 0, 0)
    h = one(spark, S.append_history(F.array(*[F.lit(i) for i in range(60)]), F.lit(99)))
    assert len(h) == 50 and h[-1] == 99 and h[0] == 11


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("---\nname: X\ntags: [one, two]\n---\nbody")
    (tmp_path / "a" / ".hidden").write_text("no")
    (tmp_path / "big.md").write_bytes(b"0" * 600_000)
    files = L.read_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in files.collect()] == ["x.md"]
    page = L.frontmatter(files.select(F.col("content").cast("string").alias("text"))).first()
    assert page["name"] == "X" and page["tags"] == ["one", "two"] and page["description"] == ""
    assert L.digest(L.manifest(files)).first()["files"] == 1
    L.write_lines(L.as_lines(spark.createDataFrame([("n", "t", ["o"])], "name string, entity_type string, observations array<string>"), spark.createDataFrame([], "from_name string, to_name string, relation_type string")), str(tmp_path / "out"))
    assert L.line_counts(L.parsed_lines(L.read_lines(spark, str(tmp_path / "out")))).first()["entities"] == 1


def test_retrieval_edges(spark):
    docs = spark.createDataFrame([(1, "cache of the cache"), (2, "cache session"), (3, None), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([("a", "cache"), ("a", "cache"), ("b", "cache"), ("b", "session"), ("c", "nothing")], "query_id string, term string")
    got = {(r["query_id"], r["doc_id"]) for r in R.bm25(docs, q).collect()}
    assert got == {("a", 1), ("a", 2), ("b", 2)}
    assert R.bm25(docs.limit(0), q).count() == 0 and R.bm25(docs, q.limit(0)).count() == 0
    assert {(r["query_id"], r["doc_id"]) for r in R.prefix_match(docs, spark.createDataFrame([("x", "ca"), ("y", "sess"), ("y", "cac")], "query_id string, term string")).collect()} == {("x", 1), ("x", 2), ("y", 2)}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (6, None), (7, [float("nan"), 1.0])], "vec_id long, embedding array<float>")
    ok = R.valid_vectors(v, 2)
    assert sorted(r["vec_id"] for r in ok.collect()) == [1, 2, 3, 4, 5]
    assert [(r["vec_id"], r["rank"]) for r in R.nearest(ok, ok.where("vec_id = 1"), 3).orderBy("rank").collect()] == [(1, 1), (5, 2), (3, 3)]
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id long, rank int")
    assert [(r["doc_id"], r["sources"]) for r in R.fused([a, a.where("doc_id = 2").withColumn("rank", F.lit(1))]).orderBy("rank").collect()] == [(2, [0, 1]), (1, [0])]
    m = M.ranked_quality(a, spark.createDataFrame([("q", 2), ("z", 1)], "query_id string, doc_id long")).collect()
    assert {r["query_id"]: round(r["mrr"], 3) for r in m} == {"q": 0.5, "z": 0.0}


def test_nearest_recall_against_brute_force(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in R.nearest(v, v.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q in (0, 100, 200):
        assert got[q] == {i for i, _ in sorted(rows, key=lambda r: (-cos(rows[q][1], r[1]), r[0]))[:10]}


def test_traversal_against_python(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)]
    df, starts = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n1",), ("n2",), ("absent",)], "start string")
    both = {}
    for a, b in edges:
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    want = set()
    for s in ("n1", "n2", "absent"):
        seen, front = {s}, {s}
        for d in (1, 2, 3):
            front = {y for x in front for y in both.get(x, ())} - seen
            seen |= front
            want |= {(s, y, d) for y in front}
    assert {tuple(r) for r in G.related(df, starts, 3).select("start", "node", "depth").collect()} == want
    sym = spark.createDataFrame([("n1", "run", "src/app.ts", "function", True), ("n3", "x", "a/b.ts", "function", False)], "id string, name string, file string, kind string, exported boolean")
    chain = G.processes(sym, spark.createDataFrame([("n1", "n3"), ("n3", "n1"), ("n1", "gone")], "src string, dst string"), most=1).collect()
    assert [(r["start"], r["steps"], r["label"]) for r in chain] == [("n1", ["n1", "n3"], "Run")]
    assert G.impact_counts(df.limit(0), starts).where("d1 > 0 or risk <> 'LOW'").count() == 0


def test_merge_three_matrix(spark):
    side = lambda **k: spark.createDataFrame([(n, "t", o) for n, o in k.items() if o is not None], "name string, entity_type string, observations array<string>")
    base = side(same=["a"], ours=["a"], theirs=["a"], both=["a"], tie=["a"], gone=["a"], fought=["a"], nobody=["a"])
    ours = side(same=["a"], ours=["a", "b"], theirs=["a"], both=["b"], tie=["b"], gone=["a"], fought=["z"], new=["n"])
    theirs = side(same=["a"], ours=["a"], theirs=["c", "a"], both=["c", "d"], tie=["c"])
    got = {r["name"]: (r["outcome"], r["conflict"]) for r in Y.merge_three(base, ours, theirs).collect()}
    assert got == {"same": ("ours", False), "ours": ("ours", False), "theirs": ("theirs", False), "both": ("theirs", True), "tie": ("ours", True), "gone": ("deleted", False), "fought": ("ours", True), "new": ("ours", False), "nobody": ("deleted", False)}
    s = spark.createDataFrame([("a", "x", 1), ("A", "y", 2), (" ", "z", 3), ("b", None, 4)], "name string, command string, position int")
    assert {r["position"]: r["error"] for r in Y.valid_settings(s).collect()} == {1: None, 2: "duplicate", 3: "no name", 4: "no command"}


def _events(rng, n):
    kinds = ["occurrence", *E.STATES, "nonsense"]
    return [(rng.choice(["f", "g", None]), T0 + dt.timedelta(hours=rng.randrange(200)), f"e{i:04d}", rng.choice(kinds)) for i in range(n)]


def test_fault_states_batch_stream_and_python_agree(spark, tmp_path):
    rows = _events(random.Random(3), 400)
    df = spark.createDataFrame(rows, "fingerprint_id string, at timestamp, id string, event string")
    want = {}
    for f in ("f", "g"):
        state, again, total = None, 0, 0
        for _, _, _, ev in sorted((r for r in rows if r[0] == f), key=lambda r: (r[1], r[2])):
            state, back = E.next_state(state, ev)
            again, total = again + back, total + (ev == "occurrence")
        want[f] = (state, total, again)
    assert {r["fingerprint_id"]: (r["state"], r["total"], r["regressions"]) for r in E.fault_states(df).collect()} == want
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    for i in range(4):
        spark.createDataFrame(ordered[i * 100 : (i + 1) * 100], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in")).where("fingerprint_id is not null")
    out = S.latest(run_once(folds.fault_states(stream), "update"), ["fingerprint_id"], [F.col("batch_id")])
    assert {r["fingerprint_id"]: (r["state"], r["total"], r["regressions"]) for r in out.collect()} == want
    assert E.fault_states(df.limit(0)).count() == 0


def test_session_stream(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", at(0), "start"), ("a", at(5), "heartbeat"), ("a", at(50), "start"), ("b", at(0), "start"), ("b", at(9), "end")]
    spark.createDataFrame(rows, "key string, at timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run_once(folds.session_states(spark.readStream.schema("key string, at timestamp, kind string").parquet(str(tmp_path / "in"))), "update", one_batch=True)
    assert {(r["key"], r["status"]) for r in out.collect()} == {("a", "ABANDONED"), ("a", "OPEN"), ("b", "CLOSED")}


def test_ledger_limits(spark):
    rows = [("f", T0 + dt.timedelta(minutes=i), f"{99 - i:02d}", 1000 if i == 7 else i) for i in range(30)] + [("g", T0, "00", None)]
    df = spark.createDataFrame(rows, "fingerprint_id string, at timestamp, id string, duration_ms long")
    got = {(r["fingerprint_id"], r["id"], r["why"]) for r in E.bounded_sample(df).collect()}
    assert got == {("f", "99", "first"), ("f", "70", "last"), ("f", "92", "slowest"), ("f", "71", "newest"), ("f", "72", "newest"), ("g", "00", "first")}
    calls = spark.createDataFrame([("s", i, ok) for i, ok in enumerate([False, False, True, False, False, False, False, True, False, False])], "session string, at int, ok boolean").withColumn("at", F.timestamp_seconds("at"))
    assert [r["failures"] for r in LG.breaker_openings(calls, "session", ["at"]).collect()] == [4]
    assert E.health(spark.createDataFrame([(0, 0), (3, 1)], "successes long, failures long")).select("score").collect()[0][0] == 100


# source, name and owner of the target, kind of its symbol, and where the edge starts
SOURCES = {
    "express": ("router.get('/a', show)", "show", None, "function", "f.x::top"),
    "laravel": ("[UserController::class, 'index']", "index", "UserController", "method", "f.x"),
    "nestjs": ("@Inject(TOKEN)", "TOKEN", None, "constant", "f.x::top"),
    "react": ("<UserCard id=1 />", "UserCard", None, "function", "f.x::top"),
    "vue": ("<user-card />", "UserCard", None, "component", "f.x::top"),
    "django": ("path('a/', views.home)", "home", None, "function", "f.x"),
    "rails": ("get '/a' => 'users#show'", "show", "UsersController", "method", "f.x"),
    "svelte": ("{#if ready(x)}", "ready", None, "function", "f.x::top"),
    "shopify": ("{% render 'card.liquid' %}", "card", None, "snippet", "f.x::top"),
}
SYMBOL = "id string, name string, path string, parent string, kind string, line int, line_end int"


@pytest.mark.parametrize("name", SOURCES)
def test_frameworks(spark, name):
    text, target, owner, kind, start = SOURCES[name]
    files = spark.createDataFrame([("f.x", "\n\n" + text + "\n" + text, "js"), ("empty", None, "js")], "path string, text string, lang string")
    got = {(r["name"], r["parent"], r["line"]) for r in K.framework_matches(files, [name]).collect()}
    assert {(target, owner, 3), (target, owner, 4)} <= got
    symbols = spark.createDataFrame([("f.x::top", "top", "f.x", None, "function", 1, 9), (f"g::{target}", target, "g", owner, kind, 1, 2), (f"a::{target}", target, "a", owner, "no kind" if kind not in ("method", "constant", "snippet") else kind, 1, 2)][: 3 if kind not in ("method", "constant", "snippet") else 2], SYMBOL)
    edges = {(r["src"], r["dst"], r["line"]) for r in K.framework_edges(K.framework_matches(files, [name]), symbols).collect()}
    assert edges == {(start, f"g::{target}", 3), (start, f"g::{target}", 4)}
    assert K.framework_edges(K.framework_matches(files.limit(0), [name]), symbols).count() == 0


def test_frameworks_leave_out_what_is_their_own(spark):
    php = "Cache::get('x');\nview('users.profile');\nroute('users.edit')\nApp::run()"
    py = "@app.route('/p')\ndef ping(): pass\n@router.get('/q')\nasync def query(): pass\n"
    files = spark.createDataFrame([("r.php", php, "php"), ("a.py", py, "py"), ("s.svelte", "{#each list() as x}{$state(1)}{each(x)}", "svelte")], "path string, text string, lang string")
    symbols = [("v", "profile", "resources/views/users/profile.blade.php", None, "component", 1, 9), ("e", "edit", "c.php", "C", "method", 1, 2), ("g", "get", "c.php", "Cache", "method", 1, 2), ("a.py::ping", "ping", "a.py", None, "function", 2, 2), ("b.py::query", "query", "b.py", None, "function", 1, 1), ("l", "list", "l.js", None, "function", 1, 1), ("x", "each", "l.js", None, "function", 1, 1)]
    edges = K.framework_edges(K.framework_matches(files, ["laravel", "django", "svelte"]), spark.createDataFrame(symbols, SYMBOL)).collect()
    assert {(r["src"], r["dst"], r["confidence"]) for r in edges} == {("r.php", "v", 0.85), ("r.php", "e", 0.65), ("a.py", "a.py::ping", 0.9), ("s.svelte", "l", 0.85)}
    assert {(r["framework"], r["n"]) for r in K.framework_counts(K.framework_edges(K.framework_matches(files, ["laravel", "django"]), spark.createDataFrame(symbols, SYMBOL))).collect()} == {("laravel", 2), ("django", 1)}
    K.register_framework("own", r"\bcall_me\s*\(\s*(\w+)", kinds="function")
    own = spark.createDataFrame([("o.x", "call_me(list)", "own")], "path string, text string, lang string")
    assert [(r["dst"], r["resolved_by"]) for r in K.framework_edges(K.framework_matches(own, ["own"]), spark.createDataFrame(symbols, SYMBOL)).collect()] == [("l", "framework:own")]
    K._ADDED.clear()


def test_sure_strategies_end_the_cascade(spark):
    part = lambda *rows: spark.createDataFrame(rows, "ref_id string, target string, confidence double")
    got = K.cascade(part(("a", "fw", 0.92), ("b", "fw", 0.7)), part(("b", "im", 0.88), ("c", "im", 0.88)), part(("a", "nm", 1.0), ("b", "nm", 0.95), ("c", "nm", 0.88), ("d", "nm", 0.1)))
    assert {r["ref_id"]: (r["target"], r["resolved_by"]) for r in got.collect()} == {"a": ("fw", "framework"), "b": ("nm", "name"), "c": ("im", "import"), "d": ("nm", "name")}
    bound = spark.createDataFrame([("a/handlers/x.js", "dispatch", None, "function"), ("a/handlers/x.js", "boot", None, "function"), ("handlers/x.js", "run", None, "function"), ("a/x.js", "y", "UserController", "method"), ("a/x.js", "y", "UserController", "function"), ("a/controllers/x.js", "y", None, "method"), ("a/controllers/x.js", "y", None, "class")], "path string, name string, parent string, kind string")
    assert [r[0] for r in bound.select(K.framework_bound(*map(F.col, bound.columns))).collect()] == [True, False, False, True, False, True, False]


def test_index_in_two_passes(spark):
    java = 'class A {\n  // { not a brace\n  static String s = "{";\n  void run() {\n    if (x) { call(); }\n  }\n  void call() { }\n}\nclass B {\n  void run() { call(); }\n}\n'
    found = K.extract(spark.createDataFrame([("p/A.java", java, "java"), ("m.xml", '<mapper namespace="p.A"><select id="one"><include refid="cols"/></select></mapper>', "mybatis"), ("no.xml", '<select id="two"/>', "mybatis"), ("e.py", None, "py")], "path string, text string, lang string"))
    symbols, relations = K.indexed(found)
    assert {(r["id"], r["line"], r["line_end"]) for r in symbols.where("kind in ('class', 'method', 'mybatis-statement')").collect()} == {("p/A.java::A", 1, 8), ("p/A.java::A.run", 4, 6), ("p/A.java::A.call", 7, 7), ("p/A.java::B", 9, 11), ("p/A.java::B.run", 10, 10), ("m.xml::A.one", 1, 1)}
    rel = {(r["src"], r["dst"], r["kind"]) for r in relations.collect()}
    assert {("p/A.java::A.run", "p/A.java::A.call", "CALLS"), ("m.xml::A.one", "p/A.java::A", "MEMBER_OF"), ("p/A.java::B.run", "p/A.java::B", "MEMBER_OF")} <= rel
    s, r = K.indexed(found.limit(0))
    assert s.count() == 0 and r.count() == 0


def test_scoped_entities_search(spark):
    ents = spark.createDataFrame([("e1", "A:one", "p", "active"), ("e2", "A:two", None, "active"), ("e3", "A:three", "q", "active"), ("e4", "A:four", "p", "archived"), ("e5", "A:five", "p", "candidate")], "id string, name string, project_id string, lifecycle string")
    obs = spark.createDataFrame([(e, "shared words here", "active") for e in ("e1", "e2", "e3", "e4", "e5")] + [("e1", "hidden", "archived"), (None, "shared", "active"), ("e1", None, "active")], "entity_id string, text string, lifecycle string")
    ask = spark.createDataFrame([("mine", "shared", "p", False), ("mine", "words", "p", False), ("both", "shared", "p", True), ("none", "shared", None, False), ("gone", "hidden", "p", True)], "query_id string, term string, project_id string, global boolean")
    got = {(r["query_id"], r["doc_id"]) for r in R.scoped_bm25(ents, obs, ask).collect()}
    assert got == {("mine", "e1"), ("both", "e1"), ("both", "e2"), ("none", "e2")}
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in R.archived_search(ents, obs, ask.where("query_id = 'mine'")).collect()] == [("mine", "e4", 1.0)]
    assert R.scoped_bm25(ents.limit(0), obs, ask).count() == 0 and R.scoped_bm25(ents, obs, ask.limit(0)).count() == 0
    e = spark.createDataFrame([("x", None)], "id string, project_id string").withColumn("lifecycle", F.lit("active"))
    assert S.visible(e, S.UNRESOLVED, True).count() == 0 and S.visible(e, None).count() == 1 and S.visible(e, "p", True).count() == 1


def test_nearest_in_chunks_of_queries(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"k{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    whole = {tuple(r) for r in R.nearest(v, v.where("vec_id like '%0'"), 3).collect()}
    monkeypatch.setattr(R, "QUERY_VALUES", 8)
    assert {tuple(r) for r in R.nearest(v, v.where("vec_id like '%0'"), 3).collect()} == whole and len(whole) == 18
    assert R.nearest(v, v.limit(0), 3).count() == 0 and R.nearest(v.limit(0), v, 3).count() == 0
    assert R.nearest(v, v.where("vec_id = 'k1'"), 3, floor=2.0).count() == 0


def test_hybrid_of_one_list_and_stale_hits(spark):
    ranks = lambda *rows: spark.createDataFrame(rows, "query_id int, doc_id int, rank int")
    asked = spark.createDataFrame([(1, "one two three"), (2, "x")], "query_id int, text string")
    got = R.hybrid(ranks((1, 10, 1), (1, 11, 2)), ranks((1, 11, 1), (2, 12, 1), (2, 99, 2)), asked, spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "doc_id int, kind string")).collect()
    assert {(r["query_id"], r["doc_id"], r["rank"], tuple(r["sources"]), r["degraded"], r["score"]) for r in got} == {(1, 11, 1, (0, 1), False, round(1 / 62 + 1 / 61, 4)), (1, 10, 2, (0,), False, round(1 / 61, 4)), (2, 12, 1, (1,), True, round(1 / 76, 4))}


def test_names_and_parts_of_ids(spark):
    s = spark.createDataFrame([("a.js::Run", "Run", None), ("b.js::K.go", "go", "K"), ("c.js::L.go", "go", "L")], "id string, name string, parent string")
    ask = spark.createDataFrame([(w,) for w in ("K.go", "go", "run", "js::l", "", None, "zz")], "wanted string")
    got = {r["wanted"]: (r["id"], r["stage"], r["candidates"]) for r in K.scoped_names(s, ask).collect()}
    assert got["K.go"] == ("b.js::K.go", "member", []) and got["go"] == (None, "name", ["b.js::K.go", "c.js::L.go"]) and got["run"] == ("a.js::Run", "part", []) and got["js::l"] == ("c.js::L.go", "part", [])
    assert got["zz"][1] is None and got[""][1] is None


def test_relations_around_by_type_and_case(spark):
    e = spark.createDataFrame([("A", "b", "uses"), ("B", "C", "uses"), ("c", "d", "owns"), ("A", "A", "uses")], "src string, dst string, kind string")
    got = {tuple(r) for r in G.related_typed(e, spark.createDataFrame([("a",)], "start string"), 9, "uses").select("start", "node", "depth").collect()}
    assert got == {("a", "B", 1), ("a", "C", 2)}
    sym = spark.createDataFrame([("A",), ("b",), ("B",)], "id string")
    assert {(r["node"], r["depth"]) for r in G.blast_radius(e, sym, spark.createDataFrame([("A",)], "start string"), "downstream").collect()} == {("b", 1)}
    assert tuple(G.impact_counts(e, spark.createDataFrame([("d",)], "start string"), kinds=["uses"]).first())[1:] == (0, 0, 0, "LOW")


def test_sessions_and_samples_look_at_all_that_follows(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("1", "p", "a", "stable", at(0), at(1), None), ("2", "p", "a", "stable", at(20), at(20), None), ("3", "p", "a", "process", at(60), at(60), None), ("4", None, "a", "stable", at(0), at(0), None), ("5", None, "a", "stable", at(90), at(90), None), ("6", "p", "b", "stable", at(0), at(0), at(5)), ("7", "p", "a", "stable", at(31), at(31), None)]
    s = spark.createDataFrame(rows, "id string, project_id string, agent string, kind string, started_at timestamp, heartbeat_at timestamp, ended_at timestamp")
    assert {r["id"]: r["status"] for r in E.abandoned(s).collect()} == {"1": "ABANDONED", "2": "ABANDONED", "3": "OPEN", "4": "OPEN", "5": "OPEN", "6": "CLOSED", "7": "OPEN"}
    assert E.abandoned(s.limit(0)).count() == 0
    rows = spark.createDataFrame([("f", at(i), f"{50 - i:02d}", i) for i in range(20)], "fingerprint_id string, at timestamp, id string, duration_ms long")
    back = spark.createDataFrame([("f", at(7)), ("f", at(12))], "fingerprint_id string, at timestamp")
    assert {(r["id"], r["why"]) for r in E.bounded_sample(rows, back).collect()} == {("50", "first"), ("31", "last"), ("43", "first since regression"), ("32", "newest"), ("33", "newest")}
    assert {r["fingerprint_id"]: (r["total"], r["detailed"]) for r in E.within_budget(rows.unionByName(rows.withColumn("fingerprint_id", F.lit("g"))), 1).collect()} == {"f": (20, True), "g": (20, False)}


def test_key_blocks_are_masked(spark):
    t = F.col("t")
    assert one(spark, X.normal_message(t), t="a -----BEGIN KEY-----\nabc 12\n-----END KEY----- x\nb 3") == "a <secret> b <number>"
    assert one(spark, X.normal_message(t), t="-----BEGIN KEY-----\nabc") == "<secret>"
    m = spark.createDataFrame([("p", "h1"), ("q", "h2")], "path string, hash string")
    assert L.digest(m).first() == L.digest(m.orderBy(F.col("path").desc())).first() != L.digest(m.limit(1)).first()
    assert L.digest(m.unionByName(m)).first()["digest"] != L.digest(m.limit(0)).first()["digest"]
    assert tuple(one(spark, X.call_outcome(t), t='{"Err": "no"}')) == (False, "no") and tuple(one(spark, X.call_outcome(t), t="{")) == (None, None)


def test_extraction(spark):
    py = "import os\nfrom .a import b\nclass C(D):\n    def m(self):\n        return b(os.x())\n    def __h(self): pass\ndef f(): pass\ndef _p(): pass\n"
    js = "import { a } from './a';\nexport class K extends L {\n  run(x) {\n    return helper(x);\n  }\n}\nexport async function go() {}\n"
    java = "import java.util.List;\npublic class A extends B implements I {\n  private int n = 1;\n  public void run() {\n    call();\n  }\n}\n"
    files = spark.createDataFrame([("a.py", py, "py"), ("bad.py", "def (", "py"), ("a.js", js, "js"), ("A.java", java, "java"), ("m.xml", '<mapper namespace="x.A">\n<select id="one">\n<include refid="cols"/>', "mybatis"), ("n.xml", '<select id="two"/>', "mybatis"), ("c/Card.vue", "name: 'card'", "vue"), ("snippets/x.liquid", "{% render 'y' %}", "liquid"), ("n", None, "js"), ("u", "x", "cobol")], "path string, text string, lang string")
    rows = K.extract(files).collect()
    sym = {(r["path"], r["kind"], r["name"]) for r in rows if r["part"] == "symbol"}
    rel = {(r["path"], r["kind"], r["target"]) for r in rows if r["part"] == "relation"}
    assert {("a.py", "class", "C"), ("a.py", "method", "m"), ("a.py", "function", "f"), ("a.js", "class", "K"), ("a.js", "method", "run"), ("a.js", "function", "go"), ("A.java", "class", "A"), ("A.java", "field", "n"), ("A.java", "method", "run"), ("m.xml", "mybatis-statement", "one"), ("c/Card.vue", "component", "Card"), ("snippets/x.liquid", "snippet", "x")} <= sym
    assert ("a.py", "function", "_p") not in sym and ("a.py", "method", "__h") not in sym
    assert {("a.py", "IMPORTS", ".a"), ("a.py", "EXTENDS", "D"), ("a.py", "CALLS", "b"), ("a.js", "IMPORTS", "./a"), ("a.js", "EXTENDS", "L"), ("a.js", "CALLS", "helper"), ("A.java", "IMPLEMENTS", "I"), ("m.xml", "CALLS", "cols"), ("snippets/x.liquid", "RENDERS", "y")} <= rel
    assert [r["path"] for r in rows if r["part"] == "error"] == ["bad.py"]
    for style, src in (("c", 'a = "//no" /* x\ny */ // z'), ("py", "s = '#no' # yes\n'''# keep'''"), ("rb", "x = '#no' # yes"), ("php", "$a = '#'; # yes")):
        out = K.blank_comments(src, style)
        assert len(out) == len(src) and out.count("\n") == src.count("\n") and "no" in out + "no" and "yes" not in out and " z" not in out
    assert K.blank_comments(None, "c") is None
    d = spark.createDataFrame([(1, "`RULE:A:b` and UserCard UserCard UserCard OnceOnly; we chose Redis"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r["name"], r["kind"], r["n"]) for r in K.mentions(d).collect()} == {("RULE:A:b", "explicit", 1), ("UserCard", "pascal-case", 3), ("Redis", "tech-decision", 1)}


def test_quality(spark):
    obs = spark.createDataFrame([("1", "e", "RULE: a b c d"), ("2", "e", "RULE: a b c x"), ("3", "e", "RULE: a b c d"), ("4", "f", "RULE: a b c x"), ("5", "e", "no prefix"), ("6", None, "RULE: a")], "id string, entity_id string, text string")
    got = Q.contradictions(obs).collect()
    assert [(r["a"], r["b"], round(r["overlap"], 2)) for r in got] == [("1", "2", 0.8)]
    assert Q.contradictions(obs.limit(0)).count() == 0
    rel = spark.createDataFrame([("r1", "a", "b", "uses"), ("r2", "a", "b", "uses"), ("r3", "a", "c", "uses"), ("r4", None, "b", "uses")], "id string, from_entity_id string, to_entity_id string, relation_type string")
    out = {r["id"]: r["outcome"] for r in Q.repointed(rel, spark.createDataFrame([("c", "a")], "id string, keep_id string")).collect()}
    assert out == {"r1": "kept", "r2": "duplicate", "r3": "self", "r4": "kept"}
    counts = spark.createDataFrame([("stale", 5, 10), ("duplicates", 0, 10), ("orphans", 0, 0)], "check string, violations long, total long")
    assert Q.health_score(Q.report(counts)).first()["score"] == 80
    assert Q.health_score(Q.report(counts.limit(0))).first()["score"] == 100
