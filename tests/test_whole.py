"""Queries over small tables that hold what an earlier version left out: every row in the domain gets its result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern.catalog import ops
from quern.operators import hierarchy as H

T0 = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def run(spark, tmp_path):
    """`run(query, documents=[(doc_id, text, kind)], ...)`: the rows of a query over tables of its own."""

    def over(query, documents=(), entities=(), observations=(), relations=()):
        tables = {
            "documents": (documents, "doc_id long, text string, kind string"),
            "entities": (entities, "id string, name string, entity_type string, project_id string, lifecycle string"),
            "observations": (observations, "id string, entity_id string, content string, seq long"),
            "relations": (relations, "id string, from_name string, to_name string, relation_type string"),
        }
        for name, (rows, schema) in tables.items():
            df = spark.createDataFrame(list(rows), schema)
            if name == "documents":
                df = df.withColumn("source", F.lit("s"))
            if name == "observations":
                df = df.withColumn("raw_text", F.lit(None).cast("string"))
            df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return entry.queries()[query](spark, str(tmp_path)).collect()

    return over


def test_prompts_beyond_ascii(run):
    docs = [(1, "fixé: a bug in naïve", "note"), (2, "créez", "note"), (3, "\n\tadd RULE:x to café/Menu", "note"), (4, "find it", "note"), (5, None, "note"), (6, "UserCardé – what", "note")]
    assert {r["doc_id"]: r["task"] for r in run("task_kinds", docs)} == {1: "bug", 2: None, 3: "feature", 4: "exploration", 6: "exploration"}
    assert {(r["doc_id"], r["name"], r["n"]) for r in run("pascal_mentions", docs)} == {(6, "UserCard", 3)}
    got = {r["doc_id"]: set(r["words"]) for r in run("prompt_keywords", [*docs, (7, "　một hai　ba", "note")])}
    assert got[3] == {"add", "rule:x", "to", "café/menu"} and got[7] == {"một", "hai", "ba"} and set(got) == {1, 2, 3, 4, 6, 7}


def _said(*texts, of="e1"):
    return [(f"{of}-o{i}", of, t, i) for i, t in enumerate(texts)]


def test_missing_relations_reads_every_text(run):
    ents = [("e1", "A:Scope:one", "biz-domain", None, "active"), ("e2", "A:Scope:two", "biz-rule", None, "active"), ("e3", "A:Scope:three", "biz-rule", None, "archived")]
    obs = [*_said("p", "q", "r", "zirconium", "palladium zirconium"), *_said("s", "t", "u", "zirconium", "palladium", of="e2"), *_said("zirconium", of="e3")]
    assert ("e1", "e2") in {(r["a"], r["b"]) for r in run("missing_relations", entities=ents, observations=obs)}
    known = [("r", "A:Scope:two", "A:Scope:one", "uses")]
    assert [(r["a"], r["shared"]) for r in run("missing_relations", entities=ents, observations=obs, relations=known) if r["a"] == "e1"] == []


def test_search_indexes_every_text(run):
    ents = [("e1", "A:B:c", "tech-stack", None, "active"), ("e2", "D:E:f", "tech-stack", None, "archived")]
    obs = [*_said("one", "two", "three", "four", "five", "zirconium"), *_said("zirconium", of="e2"), ("ask", None, "zirconium", 100)]
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in run("exact_token_search", entities=ents, observations=obs) if r["query_id"] == 100] == [(100, "e1", 0.4)]


def test_merge_and_scan_hold_every_text(run):
    ents = [("d0", "A:B:c", "tech-stack", "p", "active")]  # on both sides, with a note more on the right
    obs = _said("one", "two", "three", of="d0")
    assert [(r["observations"], r["outcome"]) for r in run("entity_merge", entities=ents, observations=obs)] == [(["NOTE: more", "one", "three", "two"], "merged")]
    line = run("jsonl_scan", entities=ents, observations=obs, relations=[("r1", "A:B:c", "D", "uses"), ("r2", "D", "A:B:c", "uses")])[0]
    assert (line["entities"], line["relations"], line["observations"], line["bad_lines"]) == (1, 2, 3, 0)


def test_every_symbol_is_a_reference(run):
    code = [(1, "\n".join(f"function f{i}() {{}}" for i in range(12)), "code_file"), (2, "function f0() {}", "code_file")]
    ids = {f"src/s/1.mjs::f{i}" for i in range(12)} | {"src/s/2.mjs::f0"}
    for query in ("best_candidates", "import_resolution", "resolution_cascade"):
        assert {r["ref_id"] for r in run(query, code)} == ids
    assert {(r["ref_id"], r["target"]) for r in run("candidate_scores", code)} == {(i, i) for i in ids} | {("src/s/1.mjs::f0", "src/s/2.mjs::f0"), ("src/s/2.mjs::f0", "src/s/1.mjs::f0")}


def test_processes_of_every_entry_point_up_to_fifty(spark, monkeypatch):
    symbols = spark.createDataFrame([(f"n{i:02d}", f"run{i}", "src/app.ts", "function", True) for i in range(60)] + [("x", "helper", "src/app.ts", "function", False)], "id string, name string, file string, kind string, exported boolean")
    monkeypatch.setattr(ops, "_symbols", lambda *_: symbols)
    monkeypatch.setattr(ops, "_edges", lambda *_: symbols.where("id <> 'x'").select(F.col("id").alias("src"), F.lit("x").alias("dst")))
    assert {r["start"] for r in ops.process_detection(spark, "").collect()} == {f"n{i:02d}" for i in range(50)}


def test_descendants_in_and_below_rings(spark):
    up = {"r1": "r2", "r2": "r3", "r3": "r1", "b": "r2", "c": "b", "d": "c", "self": "self", "s1": "self", "s2": "s1", "top": None, "t1": "top", "t2": "T1 "}
    up |= {f"x{i}": f"x{i - 1}" for i in range(1, 40)} | {"x0": "x20", "y": "x3"}  # a ring of 21 with a tail of 19
    rows = spark.createDataFrame([(k, v, T0) for k, v in up.items()], "id string, parent_id string, created_at timestamp")
    links = H.pointers(rows)
    got = [tuple(r) for r in H.descendants(H.hierarchy(rows, True, links), links).select("op_id", "descendant_id", "distance").collect()]
    want = set()
    for node in up:
        cur, seen = up[node], []
        while cur and (cur := cur.strip().lower()) in up and cur != node and cur not in seen:
            seen.append(cur)
            cur = up[cur]
        want |= {(a, node, n + 1) for n, a in enumerate(seen)}
    assert len(got) == len(set(got)) and set(got) == want
    none = rows.where("id like 't%'")
    links = H.pointers(none)
    assert H.descendants(H.hierarchy(none, True, links), links).count() == 3


def test_texts_with_errors_marks_and_rarer_blanks(run):
    docs = [(1, "start\nError: ENOENT /srv/a/b.js at 12", "note"), (2, "Traceback (most recent call last)", "note"), (3, "é\U0001f600 ‍️", "note"), (4, " hello　there ", "note"), (5, "  ", "note"), (6, "# head\r\n---\r\n**b** > q", "note"), (7, "fine", "note")]
    assert {r["doc_id"]: r["fingerprint"] for r in run("error_fingerprints", docs)} == {1: "Error: ENOENT <path> at <n>", 2: docs[1][1], 3: docs[2][1], 4: docs[3][1], 5: docs[4][1], 6: "# head\r", 7: "fine"}
    assert {r["doc_id"]: r["shown"] for r in run("capped_texts", [*docs, (8, "\U0001f600" * 1499 + "é", "note")])} == {i: t for i, t, _ in docs} | {8: "\U0001f600" * 1499 + "e"}
    assert {r["doc_id"]: r["gate"] for r in run("recall_gates", docs)} | {1: "", 2: "", 6: ""} == {1: "", 2: "", 3: "short", 4: "short", 5: "empty", 6: "", 7: "short"}
    assert {r["doc_id"]: r["plain"] for r in run("markdown_stripped", docs)}[6] == "head\r\n\r\nb q"
    code = "a // ́\U0001f600\n\U0001f600 /* x\ny */"
    assert [tuple(r) for r in run("blanked_comments", [(1, code, "code_file")])] == [("src/s/1.mjs", len(code), 3)]
