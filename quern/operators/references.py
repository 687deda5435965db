"""References to records that do not exist.

Keys are dictionary-encoded as integers; for each range of 32,768 keys and each
month there is one compressed bitmap of the keys referred to and one of the keys
that have a target from the first moment of that month on.  Reference AND-NOT
parent leaves the suspects; only their rows are looked at again, with exact times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import bitmaps as bm
from quern.plans.skew import hot_keys, salted_join
from quern.plans.tables import utc_month, with_ids

ANY_TIME = 999_999
ALWAYS = -(1 << 62)


def name_key(name: Column) -> Column:
    """A name without blanks and tabs at both ends, letter case ignored; null for blank names."""
    key = F.lower(F.btrim(name, F.lit(" \t")))
    return F.when(key != "", key)


def reference_rows(fields: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """`(table, table name, field)` as rows `src, ref_id, key, at, period`; tables need `id` and `created_at`.

    `src` is the position in `fields`; rows with a null or blank name are no references.
    """
    parts = [
        df.select(F.lit(i).alias("src"), F.col("id").alias("ref_id"), name_key(F.col(field)).alias("key"), F.unix_micros("created_at").alias("at"), F.coalesce(utc_month(F.col("created_at")), F.lit(ANY_TIME)).alias("period"))
        for i, (df, _, field) in enumerate(fields)
    ]
    return reduce(DataFrame.unionByName, parts).where(F.col("key").isNotNull())


def first_valid(targets: DataFrame, valid: Column) -> DataFrame:
    """`key, first`: from when on (microseconds) a name has a target; a target without time was always there."""
    return targets.where(valid).select(name_key(F.col("name")).alias("key"), F.coalesce(F.unix_micros("created_at"), F.lit(ALWAYS)).alias("at")).where("key is not null").groupBy("key").agg(F.min("at").alias("first"))


def orphan_references(fields: list[tuple[DataFrame, str, str]], targets: DataFrame, valid: Column) -> DataFrame:
    """One row `ref_table, ref_field, ref_id, period` for each reference without a target.

    A reference has a target if a row of `targets` for which `valid` holds has its
    name (outer blanks and tabs removed, case ignored) and a `created_at` that is
    null or not after the reference's; for a reference without `created_at` any time
    will do.  Null and blank names are no references; a row that occurs several times
    counts once; a null id stays as null; empty tables give an empty result.  `period` is months since
    the year 0, null for a reference without time.  Other columns play no role.
    """
    refs = reference_rows(fields)
    code = F.col("src") * F.lit(2_000_000) + F.col("period")
    named = refs.groupBy("key").agg(F.collect_set(code).alias("codes"), F.count("*").alias("n"))
    words = with_ids(named.join(first_valid(targets, valid), "key", "left"), "names")
    words = words.withColumn("range", F.shiftright("kid", bm.RANGE_BITS)).withColumn("low", F.col("kid").bitwiseAND(bm.SIZE - 1))

    referred = words.select("range", "low", F.explode("codes").alias("code")).groupBy("range", "code").agg(F.bitmap_construct_agg(F.col("low")).alias("bits"))
    referred = referred.select("range", (F.col("code") / 2_000_000).cast("int").alias("src"), (F.col("code") % 2_000_000).alias("period"), bm.compress("bits").alias("refs"))
    ts = F.timestamp_micros("first")
    from_month = F.when(F.col("first") == ALWAYS, 0).otherwise(utc_month(ts) + F.when(F.trunc(ts, "month").cast("timestamp") == ts, 0).otherwise(1))
    added = words.where("first is not null").select("range", "low", from_month.alias("period")).groupBy("range", "period").agg(F.bitmap_construct_agg(F.col("low")).alias("bits"))
    # what has a target by the start of each period: bitmaps of all periods up to it
    there = referred.select("range", "period", "src", "refs", F.lit(None).cast("binary").alias("bits")).unionByName(added.select("range", "period", F.lit(None).cast("int").alias("src"), F.lit(None).cast("binary").alias("refs"), "bits"))
    upto = Window.partitionBy("range").orderBy("period").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    there = there.withColumn("parents", F.bitmap_or_agg(F.col("bits")).over(upto)).where("src is not null").withColumn("parents", bm.compress("parents"))
    left = there.select("range", "src", "period", F.explode(bm.bitmap_positions(bm.bitmap_and_not("refs", "parents"))).alias("low"))
    left = left.withColumn("low", F.col("low").cast("long"))

    # Spark's size estimate doesn't count what the bitmaps explode to, so it must not choose a broadcast here
    suspects = left.hint("merge").join(words.select("range", "low", "key", "first"), ["range", "low"]).select("key", "src", "period", "first")
    suspects = suspects.groupBy("key", "first").agg(F.collect_set(F.struct("src", "period")).alias("where"))
    hot = hot_keys(words.select("key", "n"), "key")
    rows = salted_join(refs, suspects, "key", hot, F.struct("src", "ref_id"))
    rows = rows.where(F.array_contains("where", F.struct("src", "period")) & (F.col("first").isNull() | F.coalesce(F.col("at") < F.col("first"), F.lit(False))))
    tables = F.array(*[F.lit(t) for _, t, _ in fields])
    names = F.array(*[F.lit(f) for _, _, f in fields])
    return rows.select("src", "ref_id", "period").distinct().select(tables[F.col("src")].alias("ref_table"), names[F.col("src")].alias("ref_field"), "ref_id", F.when(F.col("period") != ANY_TIME, F.col("period")).alias("period"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted for each table, field and month (`yyyy-MM`, null for references without time)."""
    month = F.format_string("%04d-%02d", (F.col("period") / 12).cast("int"), F.col("period") % 12 + 1)
    return orphans.groupBy("ref_table", "ref_field", F.when(F.col("period").isNotNull(), month).alias("month")).agg(F.count("*").alias("orphans"))
