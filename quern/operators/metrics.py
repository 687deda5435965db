"""Quality of ranked results and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked_quality(results: DataFrame, relevant: DataFrame, k: int = 10, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """`query_id, ndcg, mrr` at `k`; `results` has `rank` from 1, `relevant` one row for each relevant key of a query.

    Queries without results have 0; a query without relevant keys is left out.
    """
    best = relevant.select(query, key).distinct()
    hits = results.where(F.col("rank") <= k).join(best, [query, key], "left_semi").groupBy(query).agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), (1 / F.min("rank")).alias("mrr"))
    n = best.groupBy(query).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return n.join(hits, query, "left").select(query, F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"))


def recall_at_k(results: DataFrame, exact: DataFrame, k: int = 10, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """`query_id, recall`: share of the exact first `k` that the results hold among their first `k`."""
    a = results.where(F.col("rank") <= k).select(query, key)
    b = exact.where(F.col("rank") <= k).select(query, key)
    n = b.groupBy(query).agg(F.count("*").alias("n"))
    return n.join(b.join(a, [query, key], "left_semi").groupBy(query).agg(F.count("*").alias("h")), query, "left").select(query, (F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"))


def nearest_rank(value: str, p: float) -> Column:
    """The ceil(p n)-th smallest value."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def bench_percentile(value: Column, p: float) -> Column:
    """The value at index floor(p n) of the sorted values, from 0; for groups of bounded size."""
    s = F.array_sort(F.collect_list(value))
    return F.element_at(s, F.least(F.floor(F.size(s) * p).cast("int") + 1, F.size(s)))


def run_difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`keys, before, after, change_pct, is_new` of two bench runs; a change from 0 has no percentage."""
    b = before.select(*keys, F.col(value).alias("before"))
    out = after.select(*keys, F.col(value).alias("after")).join(b, keys, "left")
    return out.select(*keys, "before", "after", F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100).alias("change_pct"), F.col("before").isNull().alias("is_new"))
