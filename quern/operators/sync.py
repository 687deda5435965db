"""Comparing, merging and staging versions of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(observations: Column) -> Column:
    return F.array_sort(F.transform(observations, lambda o: F.lower(F.trim(o))))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """`name, outcome` of two stores (`name, entity_type, observations`): 'missing in a', 'missing in b' or 'drifted' (texts compared trimmed, in any case and order); equal ones are left out."""
    x = a.select("name", F.col("entity_type").alias("ta"), _plain(F.col("observations")).alias("oa"))
    y = b.select("name", F.col("entity_type").alias("tb"), _plain(F.col("observations")).alias("ob"))
    both = x.join(y, "name", "full_outer")
    return both.select("name", F.when(F.col("oa").isNull(), "missing in a").when(F.col("ob").isNull(), "missing in b").when((F.col("oa") != F.col("ob")) | (F.col("ta") != F.col("tb")), "drifted").alias("outcome")).where("outcome is not null")


def relation_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """`from_name, to_name, relation_type, side` of triples that only one side has."""
    t = ["from_name", "to_name", "relation_type"]
    both = a.select(*t, F.lit("a").alias("side")).unionByName(b.select(*t, F.lit("b").alias("side")))
    return both.groupBy(*t).agg(F.min("side").alias("side"), F.max("side").alias("_last")).where("side = _last").drop("_last")


def rebuild_needed(a: DataFrame, b: DataFrame, most: int = 20_000) -> DataFrame:
    """One row `a, b, rebuild`: the counts differ and the store is small enough to rebuild the mirror."""
    n = F.count("*")
    return a.agg(n.alias("a")).crossJoin(b.agg(n.alias("b"))).withColumn("rebuild", (F.col("a") != F.col("b")) & (F.col("a") <= most))


def merge_three(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """`name, entity_type, observations, outcome, conflict` of a three-way merge (all `name, entity_type, observations`).

    A side counts as changed if its type or sorted texts differ from the base.  One change wins; of two different ones the
    side with more texts (ours if equal) with a conflict; what one side dropped goes unless the other changed it.
    """
    mark = lambda: F.concat_ws("\u0001", "entity_type", F.array_join(F.array_sort("observations"), "\u0001"))
    side = lambda df, s: df.select("name", F.col("entity_type").alias(f"t{s}"), F.col("observations").alias(f"o{s}"), mark().alias(f"m{s}"))
    j = side(base, "b").join(side(ours, "o"), "name", "full_outer").join(side(theirs, "t"), "name", "full_outer")
    b, o, t = (F.col(c).isNotNull() for c in ("mb", "mo", "mt"))
    same_o, same_t = F.col("mo") == F.col("mb"), F.col("mt") == F.col("mb")
    outcome = (
        F.when(o & t & (F.col("mo") == F.col("mt")), "ours").when(o & t & b & same_o, "theirs").when(o & t & b & same_t, "ours")
        .when(o & t, F.when(F.size("ot") > F.size("oo"), "theirs").otherwise("ours"))
        .when(o & b & same_o, "deleted").when(t & b & same_t, "deleted").when(o, "ours").when(t, "theirs").otherwise("deleted")
    )
    conflict = (o & t & (F.col("mo") != F.col("mt")) & ~F.coalesce(b & (same_o | same_t), F.lit(False))) | (o & ~t & b & ~same_o) | (t & ~o & b & ~same_t)
    out = j.select("name", outcome.alias("outcome"), F.coalesce(conflict, F.lit(False)).alias("conflict"), *[F.col(c) for c in ("to", "oo", "tt", "ot")])
    pick = lambda x, y: F.when(F.col("outcome") == "ours", F.col(x)).when(F.col("outcome") == "theirs", F.col(y))
    return out.select("name", pick("to", "tt").alias("entity_type"), pick("oo", "ot").alias("observations"), "outcome", "conflict")


def merged_relations(ours: DataFrame, theirs: DataFrame, merged: DataFrame) -> DataFrame:
    """The union of both sides' triples between entities that survive; what one side deleted comes back."""
    t = ["from_name", "to_name", "relation_type"]
    both = ours.select(*t).unionByName(theirs.select(*t)).distinct()
    alive = merged.where("outcome <> 'deleted'").select("name")
    return both.join(alive.withColumnRenamed("name", "from_name"), "from_name", "left_semi").join(alive.withColumnRenamed("name", "to_name"), "to_name", "left_semi")


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """`path, change` ('added', 'changed', 'removed') between two manifests (`path, hash`)."""
    j = before.select("path", F.col("hash").alias("h1")).join(after.select("path", F.col("hash").alias("h2")), "path", "full_outer")
    return j.select("path", F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").when(F.col("h1") != F.col("h2"), "changed").alias("change")).where("change is not null")


def scan_preview(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """`name, outcome`: what committing drafts (`name, entity_type, lifecycle, observations`) would do: 'created', 'updated', 'unchanged' or 'conflict'.

    `existing` also has `scanned`: whether a scan made the entity and all its texts; any other is not overwritten.
    """
    new = drafts.select("name", F.col("entity_type").alias("nt"), F.col("lifecycle").alias("nl"), F.col("observations").alias("no"))
    j = new.join(existing, "name", "left")
    clash = ~F.col("scanned") | (F.col("entity_type") != F.col("nt")) | (F.col("lifecycle") != F.col("nl"))
    return j.select("name", F.when(F.col("entity_type").isNull(), "created").when(clash, "conflict").when(F.col("observations") != F.col("no"), "updated").otherwise("unchanged").alias("outcome"))


def committable(preview: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """One row `ok, conflicts, moved`: no conflict in the preview and the manifests (`path, hash`) still equal."""
    return preview.agg(F.count_if(F.col("outcome") == "conflict").alias("conflicts")).crossJoin(manifest_changes(before, now).agg(F.count("*").alias("moved"))).withColumn("ok", (F.col("conflicts") == 0) & (F.col("moved") == 0))


def vectors_to_make(texts: DataFrame, vectors: DataFrame, model: str, dimension: int) -> DataFrame:
    """`id, hash, text`: texts without a vector for their content, model and dimension."""
    want = texts.select("id", F.sha2("text", 256).alias("hash"), "text")
    have = vectors.where((F.col("model") == model) & (F.col("dimension") == dimension)).select("id", "hash")
    return want.join(have, ["id", "hash"], "left_anti")


def cached_vectors(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """`id, name, vector, source`: from a cache (`key, vector`) by id, then by name; null for those still to be made."""
    a = cache.select(F.col("key").alias("id"), F.col("vector").alias("v1"))
    b = cache.select(F.col("key").alias("name"), F.col("vector").alias("v2"))
    return wanted.join(a, "id", "left").join(b, "name", "left").select("id", "name", F.coalesce("v1", "v2").alias("vector"), F.when(F.col("v1").isNotNull(), "id").when(F.col("v2").isNotNull(), "name").alias("source"))


def new_texts(existing: DataFrame, learned: DataFrame) -> DataFrame:
    """`name, added`: texts of `learned` (`name, observations`) that candidates of `existing` lack, brackets at the start ignored."""
    bare = lambda c: F.transform(c, lambda o: F.regexp_replace(o, r"^\[[^\]]*\]\s*", ""))
    j = learned.select("name", bare(F.col("observations")).alias("n")).join(existing.where("lifecycle = 'candidate'").select("name", bare(F.col("observations")).alias("o")), "name")
    return j.select("name", F.array_except("n", "o").alias("added")).where("size(added) > 0")


def valid_settings(entries: DataFrame) -> DataFrame:
    """Entries (`name, command, position`) with `error`: 'no name', 'no command' or 'duplicate' (the first valid one holds)."""
    fine = (F.trim("name") != "") & (F.trim("command") != "")
    first = entries.where(fine).groupBy(F.lower("name").alias("_k")).agg(F.min("position").alias("_p"))
    j = entries.join(first, F.lower("name") == F.col("_k"), "left")
    return j.select("name", "command", "position", F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name").when(F.coalesce(F.trim("command"), F.lit("")) == "", "no command").when(F.col("position") != F.col("_p"), "duplicate").alias("error"))
