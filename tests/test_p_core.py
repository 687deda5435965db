"""p1, p2, p3 and p5 against brute force, with nulls, ties, repeats, hot keys, clashing columns and empty tables."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import bitmaps as bm
from quern.operators import hierarchy as H
from quern.operators import intervals, references, rolling
from quern.plans import skew

T0 = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
REF = "id string, name string, created_at timestamp, lifecycle string, key string, src int, n int"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, bm.SIZE - 1), max_size=400), st.sets(st.integers(0, bm.SIZE - 1), max_size=400), st.integers(0, bm.SIZE - 3000))
def test_bitmaps_hold_and_subtract(a, b, start):
    a, b = a | set(range(start, start + 2500)), b | set(range(start + 100, start + 2400, 3))
    x, y = bm.pack(np.array(sorted(a))), bm.pack(np.array(sorted(b)))
    assert set(bm.unpack(x).tolist()) == a and set(bm.unpack(y).tolist()) == b
    assert set(bm.unpack(bm.and_not(x, y)).tolist()) == a - b
    assert bm.unpack(bm.pack(np.array([], dtype=int))).size == 0 and bm.unpack(None).size == 0


def _refs(rng, n, hot):
    names = [f"N{i}" for i in range(30)] + [None, "", " \t"]
    dress = lambda s: None if s is None else rng.choice(["", " ", "\t"]) + rng.choice([s, s.lower()]) + rng.choice(["", "\t "])
    at = lambda: None if rng.random() < 0.1 else T0 + dt.timedelta(days=rng.randrange(120))
    rows = [(f"r{i}", dress("hot" if rng.random() < hot else rng.choice(names)), at(), "x", "k", 1, 2) for i in range(n)]
    ents = [(f"e{i}", rng.choice(names[:25]), at(), rng.choice(["active", "candidate", "archived", "rejected"]), "k", 3, 4) for i in range(25)]
    ents += [("m", "N3", dt.datetime(2025, 2, 1, tzinfo=dt.timezone.utc), "active", "", 0, 0)]
    return rows + rows[:5], ents


def _orphans(rows, ents):
    out = set()
    norm = lambda s: s.strip(" \t").lower() if s else ""
    for r in rows:
        if norm(r[1]) and not any(norm(e[1]) == norm(r[1]) and e[3] in ("active", "candidate") and (e[2] is None or r[2] is None or e[2] <= r[2]) for e in ents):
            out.add(r[0])
    return out


@pytest.mark.parametrize("hot_rows", [20_000, 10])
def test_references(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rows, ents = _refs(random.Random(1), 400, 0.3)
    df, e = spark.createDataFrame(rows, REF), spark.createDataFrame(ents, REF)
    got = references.orphan_references([(df, "t", "name")], e, F.col("lifecycle").isin("active", "candidate")).collect()
    assert len(got) == len({r["ref_id"] for r in got}) and {r["ref_id"] for r in got} == _orphans(rows, ents)
    none = spark.createDataFrame([], REF)
    assert references.orphan_references([(none, "t", "name")], e, F.lit(True)).count() == 0
    assert references.orphan_references([(df, "t", "name")], none, F.lit(True)).count() == len({r[0] for r in rows if (r[1] or "").strip(" \t")})
    report = {r["month"]: r["orphans"] for r in references.orphan_report(references.orphan_references([(df, "t", "name")], e, F.col("lifecycle").isin("active", "candidate"))).collect()}
    assert sum(report.values()) == len(got) and any(m is None for m in report)


NODE = "id string, parent_id string, created_at timestamp, root string, v int, path string"


def _tree(rng, n, kind):
    rows = []
    for i in range(n):
        p = {"chain": f"n{i - 1:04d}" if i else None, "random": f"n{rng.randrange(n):04d}" if rng.random() < 0.95 else None, "star": "n0000" if i else None, "tree": f"n{rng.randrange(i):04d}" if i and rng.random() < 0.97 else None}[kind]
        rows.append((f"n{i:04d}", rng.choice(["", " "]) + p.upper() if p else rng.choice([None, "", "absent"]), T0 + dt.timedelta(minutes=i), "x", 1, "y"))
    rows += [(r[0], "n0001", r[2] + dt.timedelta(days=1), "x", 1, "y") for r in rows[:10]] + rows[:3] + [(None, "n0001", T0, "", 0, ""), ("self", "self", None, "", 0, "")]
    rng.shuffle(rows)
    return rows


def _solve(rows):
    best = {}
    for i, p, at, *_ in rows:
        if i is not None and (i not in best or ((at is None, at or T0) < best[i][0])):
            best[i] = ((at is None, at or T0), p)
    up = {i: (p or "").strip().lower() for i, (_, p) in best.items()}
    out = {}
    for i in up:
        path, x = [i], i
        while up[x] in up and up[x] not in path:
            x = up[x]
            path.append(x)
        if up[x] in up:
            ring = path[path.index(up[x]) :]
            out[i] = (min(ring), -1, None)
        else:
            out[i] = (x, len(path) - 1, path[::-1])
    return out


@pytest.mark.parametrize("kind, hot_rows", [("chain", 20_000), ("random", 20_000), ("star", 10), ("tree", 20_000), ("random", 10)])
def test_hierarchy(spark, monkeypatch, kind, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(H, "HOT_ROWS", hot_rows)
    rows = _tree(random.Random(kind), 150, kind)
    got = {r["op_id"]: (r["root_id"], r["depth"], r["path"]) for r in H.hierarchy(spark.createDataFrame(rows, NODE), with_path=True).collect()}
    assert got == _solve(rows)
    if kind == "tree":
        pairs = {(r["op_id"], r["descendant_id"], r["distance"]) for r in H.descendants(H.hierarchy(spark.createDataFrame(rows, NODE), True)).collect()}
        assert pairs == {(a, i, d - k) for i, (_, d, p) in got.items() if p for k, a in enumerate(p[:-1])}


def test_hierarchy_with_splitterless_ring_and_branches(spark):
    """A ring none of whose nodes is a splitter, with a long tail below it that holds splitters."""
    names = [f"k{i}" for i in range(400)]
    split = {r["id"]: r["s"] for r in spark.createDataFrame([(n,) for n in names], "id string").select("id", (F.pmod(F.xxhash64("id"), F.lit(H.SPLIT)) == 0).alias("s")).collect()}
    ring = [n for n in names if not split[n]][:3]
    tail = [n for n in names if n not in ring][:60]
    rows = [(a, b, T0, "", 0, "") for a, b in zip(ring, ring[1:] + ring[:1])] + [(a, b, T0, "", 0, "") for a, b in zip(tail, [ring[1], *tail])] + [("root", None, T0, "", 0, ""), ("leaf", "root", T0, "", 0, "")]
    got = {r["op_id"]: (r["root_id"], r["depth"]) for r in H.hierarchy(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {i: v[:2] for i, v in _solve(rows).items()} and any(split[t] for t in tail)
    assert H.hierarchy(spark.createDataFrame([], NODE), True).count() == 0


def test_a_stray_day_makes_no_array(spark):
    df = spark.createDataFrame([(0, 1), (2_147_483, 2), (2_147_483_000, 3)], "day int, failures long")
    series = rolling.daily_series(df.where("day < 2147483000").withColumn("k", F.lit("k")), ["k"], "day", ["failures"], None)
    assert tuple(series.agg(F.count("*"), F.sum("failures"), F.max("day"), F.count_distinct("day")).first()) == (2_147_484, 3, 2_147_483, 2_147_484)
    assert series.schema["day"].dataType.simpleString() == "int"


def test_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch, tmp_path):
    from quern.plans import tables

    assert [tables.one_machine(m) for m in ("local", "local[8]", "local[*]", "local-cluster[3,2,1000]", "yarn", "spark://h:7077", "k8s://h")] == [True] * 3 + [False] * 4
    monkeypatch.setattr(tables, "one_machine", lambda m: False)
    monkeypatch.setattr(tables, "named_folder", lambda s: None)
    with pytest.raises(RuntimeError):
        tables.shared_root(spark)
    monkeypatch.setattr(tables, "named_folder", lambda s: f"file://{tmp_path}/")
    kept = tables.written(spark.range(3), "kept")
    assert kept._written_to.startswith(f"file://{tmp_path}/quern/") and kept.count() == 3
    tables.discard(kept)
    assert not list(tmp_path.glob("quern/*/kept-*"))


def test_rolling(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(100, 140), 200]), rng.choice(["a", "b", ""]), rng.choice(["x", None]), rng.choice([None, 1, 5]), rng.choice([None, 2]), None if rng.random() < 0.1 else f"i{n}", 7) for n in range(200)]
    df = spark.createDataFrame(rows + [r for r in rows[:20] if r[5]], "day int, scope string, component string, failures long, successes long, import_id string, _day int")
    got = rolling.trailing_totals(rolling.daily_series(df, ["scope", "component"], "day", ["failures", "successes"], "import_id"), ["scope", "component"], "day", ["failures", "successes"], [1, 7, 30, 11]).collect()
    day = {}
    for r in rows:
        if r[0] is not None and r[2] is not None:
            day.setdefault((r[1], r[2]), {}).setdefault(r[0], []).append((r[3] or 0, r[4] or 0))
    want = {}
    for k, days in day.items():
        for d in range(min(days), max(days) + 1):
            want[(*k, d)] = [sum(v[i] for x in range(d - n + 1, d + 1) for v in days.get(x, [])) for i in (0, 1) for n in (1, 7, 30, 11)]
    assert {(r["scope"], r["component"], r["day"]): [r[f"{v}_{n}d"] for v in ("failures", "successes") for n in (1, 7, 30, 11)] for r in got} == want
    assert all(abs(r["failures_30d_avg"] - r["failures_30d"] / 30) < 1e-9 for r in got)
    assert rolling.daily_series(df.limit(0), ["scope"], "day", ["failures"], None).count() == 0


def _periods(rows):
    out, by = set(), {}
    for p, a, s, e in rows:
        if None not in (p, a, s, e) and s <= e:
            by.setdefault((p, a), []).append((s, e))
    for k, spans in by.items():
        spans.sort()
        cur = list(spans[0])
        for s, e in spans[1:]:
            if s > cur[1]:
                out |= {(*k, "period", *cur), (*k, "gap", cur[1], s)}
                cur = [s, e]
            cur[1] = max(cur[1], e)
        out.add((*k, "period", *cur))
    return out


@pytest.mark.parametrize("blocks", [(3_600_000, 1 << 14), (7, 3)])
def test_intervals(spark, monkeypatch, blocks):
    monkeypatch.setattr(intervals, "BLOCK_MS", blocks[0])
    monkeypatch.setattr(intervals, "BLOCK_RANKS", blocks[1])
    rng = random.Random(5)
    rows = [(rng.choice(["p", "q", None]), rng.choice(["a", "a", "a", None]), s, None if rng.random() < 0.05 else s + rng.choice([0, 0, 1, 5, 20, -2])) for s in (rng.randrange(600) for _ in range(300))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + rows[:9]], "project_id string, agent string, st long, en long, s int, e int")
    got = intervals.periods_and_gaps(df, ["project_id", "agent"], F.col("st"), F.col("en")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == _periods(rows)
    assert intervals.periods_and_gaps(df.limit(0), ["project_id", "agent"], F.col("st"), F.col("en")).count() == 0


def test_salted_join_meets_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 97).cast("string")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = skew.hot_keys(right, "k")
    assert len(hot) == 1
    out = skew.salted_join(left, right.union(spark.createDataFrame([("hot", -1)], "k string, n long")), "k", hot, F.col("id"))
    assert out.count() == 1000 + 334 and out.select("id").distinct().count() == 1000
