"""Bounded traversal of relations and calls.

Every hop is one join on the frontier, whose result is written, so plans stay short and a
lost executor costs one hop.  Starts come as a DataFrame: many traversals run at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import process_label, rounded
from quern.plans.tables import with_ids, written

#: Up to so many edges are sent to every worker whole (4 bytes each, and the names of their nodes); a larger graph is joined hop by hop.
GRAPH_EDGES = 4_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    """`src, dst` in either direction, each once, without loops."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int, passable: DataFrame | None = None) -> DataFrame:
    """`start, node, depth`: nodes reached from each start (`start`) along `src, dst` in at most `depth` hops, at their least depth.

    The start is left out.  With `passable` (`node`) only those nodes are reported and passed through.
    """
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    parts, frontier = [], seen
    for hop in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        if passable is not None:
            step = step.join(passable, "node", "left_semi")
        step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(hop))
        frontier = written(step, "hop") if hop < depth else step
        parts.append(frontier)
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, parts)


def reach_sent(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """`reach` for distinct edges, at most GRAPH_EDGES of them: each start is followed in one task, and no pair of start and node is shuffled."""
    kinds, spark = dict(edges.dtypes) | dict(starts.dtypes), edges.sparkSession
    names = with_ids(edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct(), "names", "v")
    ends = edges.join(names.select(F.col("name").alias("src"), F.col("v").alias("a")), "src").join(names.select(F.col("name").alias("dst"), F.col("v").alias("b")), "dst").select("a", "b").toArrow()
    named = names.toArrow().sort_by("v")
    a, b = (np.searchsorted(named["v"].to_numpy(), ends[c].to_numpy()) for c in "ab")
    order, counts = np.argsort(a, kind="stable"), np.bincount(a, minlength=len(named))
    sent = spark.sparkContext.broadcast((named["name"].combine_chunks(), np.append(0, np.cumsum(counts)).astype(np.int64), b[order].astype(np.int32)))
    asked = starts.select("start").distinct()
    # a few starts a task, since what each reaches may be much
    return asked.repartition(min(1000, 1 + asked.count() // 50), "start").mapInArrow(partial(_reached, sent, depth), f"start {kinds['start']}, node {kinds['dst']}, depth int")


def _reached(sent, depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, first, after = sent.value
    seen, out, n = np.zeros(len(names), bool), [], 0

    def rows() -> pa.RecordBatch:
        sizes = [len(nodes) for _, nodes, _ in out]
        start = names.take(pa.array(np.repeat([s for s, _, _ in out], sizes)))
        return pa.RecordBatch.from_arrays([start, names.take(pa.array(np.concatenate([x for _, x, _ in out]))), pa.array(np.repeat([d for _, _, d in out], sizes), pa.int32())], ["start", "node", "depth"])

    for batch in batches:
        for s in pc.index_in(batch.column(0), value_set=names).drop_null().to_numpy().tolist():
            frontier, met = np.array([s]), [np.array([s])]
            seen[s] = True
            for hop in range(1, depth + 1):
                many = first[frontier + 1] - first[frontier]
                at = np.arange(many.sum()) + np.repeat(first[frontier] - np.cumsum(many) + many, many)
                frontier = np.unique(after[at][~seen[after[at]]])
                seen[frontier] = True
                met.append(frontier)
                if len(frontier):
                    out.append((s, frontier, hop))
                    n += len(frontier)
                if n >= 50_000:
                    yield rows()
                    out, n = [], 0
            seen[np.concatenate(met)] = False
    if out:
        yield rows()


def related(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """Nodes around each start, whatever the direction and whether or not they are known elsewhere."""
    return reach(both_ways(edges), starts, depth)


def related_typed(edges: DataFrame, starts: DataFrame, depth: int = 1, kind: str | None = None) -> DataFrame:
    """`start, node, depth`: names around each start in at most `depth` (1 to 5) hops along relations (`src, dst, kind`) of one kind, whatever their direction and letter case.

    Names are compared in lower case and reported as they are written first (the smallest spelling); archived ends are not left out.
    """
    if kind is not None:
        edges = edges.where(F.col("kind") == kind)
    ends = edges.select(F.col("src").alias("n")).unionByName(edges.select(F.col("dst").alias("n")))
    spelled = ends.groupBy(F.lower("n").alias("node")).agg(F.min("n").alias("_n"))
    low = edges.select(F.lower("src").alias("src"), F.lower("dst").alias("dst"))
    hit = related(low, starts.select(F.lower("start").alias("start")).distinct(), max(1, min(5, depth)))
    return hit.join(spelled, "node").select("start", F.col("_n").alias("node"), "depth")


def upstream(edges: DataFrame) -> DataFrame:
    """Edges turned round: from what is used to what uses it."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src <> dst").distinct()


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as they are followed: 'upstream' to what uses a node, 'downstream' to what it uses, 'both' either way."""
    if direction == "both":
        return both_ways(edges)
    return upstream(edges) if direction == "upstream" else edges.select("src", "dst").where("src <> dst").distinct()


def blast_radius(edges: DataFrame, symbols: DataFrame, targets: DataFrame, direction: str = "upstream") -> DataFrame:
    """`start, node, depth, confidence`: what lies within three hops of each target; ids without a symbol end the way."""
    known = symbols.select(F.col("id").alias("node"))
    near = written(directed(edges, direction).join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
    hit = reach_sent(near, targets, 3) if near.count() <= GRAPH_EDGES else reach(near, targets, 3, known)
    return hit.withColumn("confidence", rounded(0.95 * F.pow(F.lit(0.9), F.col("depth") - 1), 2))


def impact_counts(edges: DataFrame, targets: DataFrame, direction: str = "upstream", kinds: list[str] | None = None) -> DataFrame:
    """`start, d1, d2, d3, risk`: numbers of ids within one, two and three hops, those without a symbol included; targets without any have zeros.

    `kinds`: only edges of these kinds (`src, dst, kind`), as a quick check that follows calls alone does.
    """
    hit = reach(directed(edges.where(F.col("kind").isin(kinds)) if kinds else edges, direction), targets, 3)
    n = hit.groupBy("start").agg(*[F.count_if(F.col("depth") == d).alias(f"d{d}") for d in (1, 2, 3)])
    out = targets.select("start").distinct().join(n, "start", "left").fillna(0, ["d1", "d2", "d3"])
    return out.withColumn("risk", F.when(F.col("d1") > 5, "HIGH").when(F.col("d1") > 0, "MEDIUM").otherwise("LOW"))


def incident_relations(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """`start, side, node, kind`: direct callers and callees of each target by relation (`src, dst, kind`)."""
    t = targets.select("start").distinct()
    ins = edges.join(t, edges["dst"] == t["start"]).select("start", F.lit("caller").alias("side"), F.col("src").alias("node"), "kind")
    outs = edges.join(t, edges["src"] == t["start"]).select("start", F.lit("callee").alias("side"), F.col("dst").alias("node"), "kind")
    return ins.unionByName(outs).where("start <> node").distinct()


def symbol_context(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """`start, callers, callees`: numbers of direct neighbours on either side."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    ins = e.groupBy(F.col("dst").alias("start")).agg(F.count("*").alias("callers"))
    outs = e.groupBy(F.col("src").alias("start")).agg(F.count("*").alias("callees"))
    return targets.select("start").distinct().join(ins, "start", "left").join(outs, "start", "left").fillna(0, ["callers", "callees"])


def without_files(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (`id, file`) and edges (`src, dst`) without the given files (`file`)."""
    gone = symbols.join(files, "file", "left_semi").select("id")
    kept = edges.join(gone, edges["src"] == gone["id"], "left_anti").join(gone, edges["dst"] == gone["id"], "left_anti")
    return symbols.join(files, "file", "left_anti"), kept


def one_hop(edges: DataFrame, starts: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` neighbours of each start, the smallest names."""
    w = Window.partitionBy("start").orderBy("node")
    return related(edges, starts, 1).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("start", "node")


def entry_score(name: Column, file: Column, exported: Column, callers: Column, callees: Column) -> Column:
    """How much a symbol looks like an entry point."""
    n, f = F.lower(name), F.lower(file)
    # Points for what a name or file shows.
    rules = [
        (exported, 1),
        (callers == 0, 2),
        (n.rlike("^(handle|on)"), 2),
        (n.rlike("^(register|setup|init)"), 2),
        (n.rlike("^(run|start|main)"), 3),
        (n.rlike("^(process|execute)"), 1),
        (n.rlike("route|endpoint|handler"), 2),
        (n.rlike("middleware|plugin"), 1),
        (f.rlike(r"(index|main|app)\."), 1),
        (f.rlike(r"(server|cli)\.|handler"), 1),
        (callees >= 3, 1),
    ]
    return sum((F.when(c, p).otherwise(0) for c, p in rules), F.lit(0))


def entry_points(symbols: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """`id, name, score` of the functions and methods most like entry points."""
    ctx = symbol_context(edges, symbols.select(F.col("id").alias("start")))
    rows = symbols.where(F.col("kind").isin("function", "method")).join(ctx, symbols["id"] == ctx["start"])
    return rows.select("id", "name", entry_score(F.col("name"), F.col("file"), F.col("exported"), F.col("callers"), F.col("callees")).alias("score")).where("score > 0").orderBy(F.col("score").desc(), "id").limit(most)


def _preorder(start: str, edges: pd.DataFrame, depth: int) -> list[str]:
    after: dict[str, list[str]] = {}
    for a, b in zip(edges["src"], edges["dst"]):
        after.setdefault(a, []).append(b)
    out, seen, stack = [], set(), [(start, 0)]
    while stack:
        node, d = stack.pop()
        if d > depth or node in seen:
            continue
        seen.add(node)
        out.append(node)
        stack += [(n, d + 1) for n in sorted(after.get(node, []), reverse=True)]
    return out


def processes(symbols: DataFrame, edges: DataFrame, depth: int = 10, most: int = 50) -> DataFrame:
    """`start, label, steps, areas`: the chain of calls from each entry point in preorder (callees by name), longest first.

    Only what lies within `depth` calls of an entry point is gathered, for each of at most `most` entry points.
    """
    calls = edges.join(symbols.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    starts = written(entry_points(symbols, edges, most), "entries")
    near = reach(calls, starts.select(F.col("id").alias("start")), depth).select("start", "node").unionByName(starts.select(F.col("id").alias("start"), F.col("id").alias("node")))
    mine = near.join(calls, near["node"] == calls["src"]).select("start", "src", "dst").distinct()

    def chain(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"start": [key[0]], "steps": [_preorder(key[0], group, depth)]})

    chains = mine.groupBy("start").applyInPandas(chain, "start string, steps array<string>").where("size(steps) >= 2")
    files = symbols.select(F.col("id").alias("step"), F.try_element_at(F.split("file", "/"), F.lit(-2)).alias("area"))
    areas = chains.select("start", F.explode("steps").alias("step")).join(files, "step").groupBy("start").agg(F.array_sort(F.collect_set("area")).alias("areas"))
    return chains.join(starts.select(F.col("id").alias("start"), process_label(F.col("name")).alias("label")), "start").join(areas, "start", "left").select("start", "label", "steps", "areas")
