"""Searches and joins whose pairs grow with the square of the input: equal to brute force, and the pairs themselves are not shuffled."""

from quern.operators import graph as G
from quern.operators import quality as Q
from quern.operators import retrieval as R


def shuffled(df) -> int:
    """Rows written to shuffles by the plan of `df`, which is run."""
    df.collect()

    def walk(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().get("shuffleRecordsWritten")
        below = node.children()
        return (own.get().value() if own.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_exact_tokens(spark, monkeypatch):
    docs = [(f"d{i:03d}", f"gamma{i % 7} name", f"alpha beta{i % 5} alpha") for i in range(300)] + [("d001", "", "delta alpha"), ("d002", "", None), (None, "alpha", "")]
    asked = [(q, t, 1 + (q + len(t)) % 2) for q in range(100) for t in ("alpha", f"beta{q % 6}", f"gamma{q % 8}", "delta")] + [(None, "alpha", 1), (500, None, 1), (501, "nowhere", 2)]
    d, q = spark.createDataFrame(docs, "doc_id string, name string, text string").repartition(3), spark.createDataFrame(asked, "query_id long, term string, weight int")
    held = {}
    for key, name, text in docs:
        for words, worth in ((text or "", 2), (name, 5)):
            for w in words.split():
                held.setdefault(key, {})[w] = max(worth, held.get(key, {}).get(w, 0))
    want = set()
    for i in range(100):
        terms = {t: w for n, t, w in asked if n == i}
        sums = {k: sum(w * h.get(t, 0) for t, w in terms.items()) for k, h in held.items()}
        best = sorted((-s, k or "", k) for k, s in sums.items() if s)[:10]
        want |= {(i, k, -s / (5 * sum(terms.values())), n + 1) for n, (s, _, k) in enumerate(best)}
    got = R.exact_tokens(d, q, 10)
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in got.collect()} == want
    assert shuffled(got) < 10_000  # 30,000 pairs share a term
    monkeypatch.setattr(R, "QUERY_TERMS", 60)
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in R.exact_tokens(d, q, 10).collect()} == want
    assert R.exact_tokens(d, q.limit(0), 10).count() == 0 and R.exact_tokens(d.limit(0), q, 10).count() == 0


def test_prefix_match(spark, monkeypatch):
    docs = [(i, f"alpha beta{i % 5} \U0001d7d8x{i % 7}y common{i}") for i in range(300)] + [(1, "delta"), (1, None), (None, "alpha")]
    asked = [(q, t) for q in range(100) for t in ("alp", f"beta{q % 6}", "c" if q % 2 else f"\U0001d7d8x{q % 8}")] + [(0, "alp"), (None, "alp"), (500, None), (501, ""), (502, "alp"), (502, ""), (503, "de"), (503, "common1"), (504, "none")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, term string")
    words = {}
    for key, text in docs:
        words.setdefault(key, []).extend((text or "").split())
    want = set()
    for i in {n for n, _ in asked if n is not None}:
        terms = {t for n, t in asked if n == i}
        if all(terms):
            want |= {(i, k) for k, ws in words.items() if k is not None and all(any(w.startswith(t) for w in ws) for t in terms)}
    got = R.prefix_match(d, q)
    rows = [(r["query_id"], r["doc_id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and (503, 1) in want and len(want) > 2000
    assert shuffled(got) < 2000
    monkeypatch.setattr(R, "QUERY_TERMS", 60)
    assert {(r["query_id"], r["doc_id"]) for r in R.prefix_match(d, q).collect()} == want
    assert R.prefix_match(d, q.limit(0)).count() == 0 and R.prefix_match(d.limit(0), q).count() == 0


def test_contradictions(spark):
    rows = [(f"{i:03d}", "e" if i % 10 else "f", "RULE: " + " ".join(f"w{j}_{i * (2 * j + 1) // (j + 1) % 12}" for j in range(7))) for i in range(300)] + [("x", "e", "RULE: w0_1 only"), ("y", "g", "RULE: alone")]
    sets = {}
    for i, e, t in rows:
        ws = frozenset(t.lower().split())
        sets[e, ws] = min(i, sets.get((e, ws), i))
    want = {(e, *sorted((i, j)), len(a & b) / max(len(a), len(b))) for (e, a), i in sets.items() for (f, b), j in sets.items() if e == f and i < j and len(a & b) > max(len(a), len(b)) / 2}
    got = Q.contradictions(spark.createDataFrame(rows, "id string, entity_id string, text string"))
    found = [(r["entity_id"], r["a"], r["b"], r["overlap"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 10
    assert shuffled(got) < 5 * len(want) + 3000  # some 20,000 pairs share a word


def test_blast_radius(spark, monkeypatch):
    edges = [(f"n{i}", f"n{i * 7 % 150}") for i in range(150)] + [("hub", f"n{i}") for i in range(0, 150, 2)] + [("n3", "unknown"), ("unknown", "n4"), ("n5", "n5"), ("n5", "n6"), ("n5", "n6")]
    e = spark.createDataFrame(edges, "src string, dst string")
    symbols = spark.createDataFrame([(f"n{i}",) for i in range(150)] + [("hub",)], "id string")
    targets = spark.createDataFrame([(f"n{i}",) for i in range(150)] + [("unknown",), ("far",), (None,), ("n1",)], "start string")
    both = {(a, b) for x, y in edges for a, b in ((x, y), (y, x)) if a != b and b != "unknown"}
    want = set()
    for s in [f"n{i}" for i in range(150)] + ["unknown"]:
        seen, now = {s}, {s}
        for d in (1, 2, 3):
            now = {b for a, b in both if a in now} - seen
            seen |= now
            want |= {(s, x, d) for x in now}
    got = G.blast_radius(e, symbols, targets, "both")
    rows = [(r["start"], r["node"], r["depth"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 5000
    assert shuffled(got) < 1000
    monkeypatch.setattr(G, "GRAPH_EDGES", 0)
    assert {(r["start"], r["node"], r["depth"]) for r in G.blast_radius(e, symbols, targets, "both").collect()} == want
    assert G.blast_radius(e.limit(0), symbols, targets).count() == 0
    monkeypatch.setattr(G, "GRAPH_EDGES", 10)
    assert G.blast_radius(e.limit(0), symbols, targets).count() == 0 and G.blast_radius(e.limit(5), symbols, targets.limit(0)).count() == 0
