"""Joins whose left side may have a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key counts as hot from this many rows on, and if it has more than 1/HOT_SHARE of all rows;
#: so at most HOT_SHARE keys are hot, whatever the size of the data.
HOT_ROWS = 20_000
HOT_SHARE = 500
SALTS = 64


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> list[int]:
    """Hashes of the hot keys of a table with one row and count for each key: at most HOT_SHARE longs."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_SHARE + 1)
    if total < HOT_ROWS:
        return []
    return [r[0] for r in counts.where(F.col(n) >= least).select(F.xxhash64(key)).distinct().collect()]


def hot_in(rows: DataFrame, key: str, total: int) -> list[int]:
    """The same for `rows` themselves, whose number is known; too few rows have no hot key and are not looked at."""
    if total < HOT_ROWS:
        return []
    least = max(HOT_ROWS, total // HOT_SHARE + 1)
    return [r[0] for r in rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.xxhash64(key)).distinct().collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list[int], spread: Column, how: str = "inner") -> DataFrame:
    """`left` joined with `right` (few rows for each key) on `key`; rows of hot keys are spread over SALTS parts.

    `spread` is an expression over `left` that tells its rows apart.  Every row of
    `left` meets every row of `right` with its key exactly once.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.xxhash64(F.col(key)).isin(hot)
    a = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0))
    b = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "_salt"], how).drop("_salt")
