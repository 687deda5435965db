"""Continuous periods and gaps of overlapping intervals.

Starts and ends are ranked independently for each entity.  Between rank k and k+1 there
is a gap exactly if the next start comes after the k-th end; the ends and starts around the
gaps are the boundaries of the periods.  Ranks are local to an entity and a
block of time plus the count of earlier blocks, so an entity with a third of all rows
is still sorted in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.tables import written

#: Width of a block of time for ranking, and of ranks for pairing.
BLOCK_MS = 3_600_000
BLOCK_RANKS = 1 << 14


def _ranked(points: DataFrame, keys: list[str]) -> DataFrame:
    """`points` (`keys, side, at`, a written table) with `rank`, from 1 on, in the order of `at` within `keys` and `side`."""
    by = [*keys, "side", "_block"]
    blocks = points.withColumn("_block", F.floor(F.col("at") / BLOCK_MS))
    before = Window.partitionBy(*keys, "side").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = blocks.withColumn("_local", F.row_number().over(Window.partitionBy(*by).orderBy("at")))
    return local.join(counts, by).select(*keys, "side", "at", (F.col("_local") + F.col("_before")).alias("rank"))


def _next_in_key(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """`lead(value)` by `order` over a written table, in blocks; the first value of the next block comes from a table of blocks."""
    rows = rows.withColumn("_block", F.floor(F.col(order) / BLOCK_RANKS))
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    heads = rows.groupBy(*keys, "_block").agg(F.min_by(value, order).alias("_head"))
    heads = heads.withColumn("_after", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_head")
    led = rows.withColumn("_lead", F.lead(value).over(w)).withColumn("_last", F.lead(order).over(w).isNull())
    return led.join(heads, [*keys, "_block"]).withColumn(out, F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_lead"))).drop("_block", "_lead", "_last", "_after")


def periods_and_gaps(rows: DataFrame, keys: list[str], start_ms: Column, end_ms: Column) -> DataFrame:
    """Rows `keys, kind, start_ms, end_ms`: 'period' for each longest covered stretch, 'gap' between two of them.

    Intervals that touch belong together, start = end is allowed.  Rows with a null
    key, start or end, and rows that end before they start, do not count; repeated
    rows change nothing; an empty table gives no rows.
    """
    spans = rows.select(*keys, start_ms.alias("s"), end_ms.alias("e")).where(" and ".join(f"`{k}` is not null" for k in keys)).where("s is not null and e is not null and s <= e")
    # equal intervals add nothing: one of each is enough, and partial aggregation drops them before the shuffle
    spans = spans.distinct()
    # starts and ends are the two sides of one written table, which the ranks and the counts of blocks read
    points = written(spans.select(*keys, F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("s").alias("at")), F.struct(F.lit("e").alias("side"), F.col("e").alias("at")))).alias("_p")).select(*keys, "_p.*"), "points")
    ranked = _ranked(points, keys).withColumn("k", F.when(F.col("side") == "s", F.col("rank") - 1).otherwise(F.col("rank")))
    pairs = ranked.groupBy(*keys, "k").agg(F.max(F.when(F.col("side") == "s", F.col("at"))).alias("s"), F.max(F.when(F.col("side") == "e", F.col("at"))).alias("e"))
    # k = 0 has only the first start, the last k only the last end
    bounds = written(pairs.where("s is null or e is null or s > e"), "bounds")
    bounds = _next_in_key(bounds, keys, "k", "e", "period_end")
    period = F.when(F.col("s").isNotNull(), F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("period_end").alias("end_ms")))
    gap = F.when(F.col("s").isNotNull() & F.col("e").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("e").alias("start_ms"), F.col("s").alias("end_ms")))
    return bounds.select(*keys, F.explode(F.array_compact(F.array(period, gap))).alias("r")).select(*keys, "r.*")
