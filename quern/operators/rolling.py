"""Totals over trailing days by binary doubling.

Sums of 1, 2, 4, 8 ... days are built from each other (the sum of 2w days is that of
w days plus the same shifted by w); a window of any length is the sum of the
blocks of its binary digits, each shifted past the blocks before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of a block that missing days are made in.
BLOCK_DAYS = 8192


def daily_series(rows: DataFrame, keys: list[str], day: str, values: list[str], identity: str | None) -> DataFrame:
    """One row for each key and each day from its first to its last: `keys, day, values`.

    Rows with one `identity` count once (rows without identity are all kept), null
    values are 0, rows without day or key are left out.  Partial sums run before the
    shuffle; after it a key has at most one row for a day, however hot it is.
    """
    rows = rows.where(" and ".join(f"`{c}` is not null" for c in [*keys, day]))
    if identity:
        row = F.struct(*[F.col(c) for c in [*keys, day, *values]])
        apart = rows.select(F.col(identity).alias("_id"), F.when(F.col(identity).isNull(), F.monotonically_increasing_id()).alias("_row"), row.alias("r"))
        rows = apart.groupBy("_id", "_row").agg(F.min("r").alias("r")).select("r.*")
    daily = rows.groupBy(*keys, day).agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(v) for v in values])
    w = Window.partitionBy(*keys).orderBy(day)
    nxt = F.greatest(F.col(day), F.coalesce(F.lead(day).over(w) - 1, F.col(day)))
    spans = daily.withColumn("_to", nxt.cast("long")).withColumn("_day", F.col(day).cast("long"))
    # days without activity come in blocks, so that a stray day far away makes rows but no array without bound
    starts = F.explode(F.sequence(F.col("_day"), F.col("_to"), F.lit(BLOCK_DAYS).cast("long")))
    spans = spans.withColumn("_from", starts).select(*keys, "_day", *values, F.explode(F.sequence("_from", F.least(F.col("_to"), F.col("_from") + (BLOCK_DAYS - 1)))).alias("_d")).select(*keys, "_day", *values, F.col("_d").cast(rows.schema[day].dataType).alias(day))
    return spans.select(*keys, day, *[F.when(F.col(day) == F.col("_day"), F.col(v)).otherwise(F.lit(0)).cast("long").alias(v) for v in values])


def trailing_totals(series: DataFrame, keys: list[str], day: str, values: list[str], lengths: list[int]) -> DataFrame:
    """`series` (from `daily_series`) with `<value>_<n>d` and `<value>_<n>d_avg` for each of `lengths`.

    The average is the total divided by n, also where the series is shorter.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    shifted = lambda c, by: F.coalesce(F.lag(c, by).over(w), F.lit(0)) if by else F.col(c)
    out = series.withColumns({f"_{v}_1": F.col(v) for v in values})
    size = 1
    while size * 2 <= max(lengths):
        out = out.withColumns({f"_{v}_{size * 2}": F.col(f"_{v}_{size}") + shifted(f"_{v}_{size}", size) for v in values})
        size *= 2
    totals = {}
    for n in lengths:
        for v in values:
            total, past = F.lit(0).cast("long"), 0
            for bit in range(n.bit_length() - 1, -1, -1):
                if n >> bit & 1:
                    total, past = total + shifted(f"_{v}_{1 << bit}", past), past + (1 << bit)
            totals[f"{v}_{n}d"] = total
    out = out.withColumns(totals).withColumns({f"{c}_avg": F.col(c) / F.lit(int(c.rsplit("_", 1)[1][:-1])) for c in totals})
    return out.select(*keys, day, *values, *totals, *[f"{c}_avg" for c in totals])
