"""Quality checks of the knowledge store, duplicates and contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import vocab as V
from quern.plans.tables import with_ids, written

# Weight of each check, and the share of violations from which it fails (0: any; null: informational).
CHECKS = {
    "stale": (0.20, 0.05),
    "duplicates": (0.25, 0.0),
    "orphans": (0.20, 0.10),
    "low_confidence": (0.20, 0.15),
    "missing_relations": (0.0, None),
    "schema": (0.10, 0.20),
    "dangling": (0.15, 0.0),
    "vocabulary": (0.0, None),
}
STALE_DAYS, LOW = 180, 0.3


def stale_texts(observations: DataFrame, as_of: str) -> DataFrame:
    """Dated observations with `age`, those over STALE_DAYS marked."""
    age = F.datediff(F.lit(as_of).cast("date"), F.expr("try_cast(obs_date as date)"))
    return observations.withColumn("age", age).where("age is not null").withColumn("stale", F.col("age") > STALE_DAYS)


def stale_report(observations: DataFrame, as_of: str) -> DataFrame:
    """`entity_name, texts, oldest`: stale observations of each entity and the largest age."""
    return stale_texts(observations, as_of).where("stale").groupBy("entity_name").agg(F.count("*").alias("texts"), F.max("age").alias("oldest"))


def duplicate_names(entities: DataFrame) -> DataFrame:
    """`key, n`: names that several entities have, letter case ignored."""
    return entities.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities that no relation names."""
    ends = relations.select(F.col("from_name").alias("name")).union(relations.select("to_name")).where("name is not null").distinct()
    return entities.join(ends, "name", "left_anti")


def dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with `reasons`: an end that is missing, or there only archived."""
    state = entities.groupBy("name").agg(F.max(F.col("lifecycle") != "archived").alias("alive"))
    out = relations
    for end in ("from_name", "to_name"):
        out = out.join(state.select(F.col("name").alias(end), F.col("alive").alias(f"_{end}")), end, "left")
    why = lambda end: F.when(F.col(f"_{end}").isNull(), f"{end} missing").when(~F.col(f"_{end}"), f"{end} archived")
    return out.withColumn("reasons", F.array_compact(F.array(why("from_name"), why("to_name")))).where(F.size("reasons") > 0).drop("_from_name", "_to_name")


def unknown_types(relations: DataFrame) -> DataFrame:
    """`relation_type, n` of types outside the vocabulary, all of them."""
    return relations.where(~F.col("relation_type").isin(V.RELATION_TYPES)).groupBy("relation_type").agg(F.count("*").alias("n"))


def schema_problems(entities: DataFrame) -> DataFrame:
    """Entities (`id, name, entity_type, observations`) with `problems`; an unknown type is the only problem then."""
    case = lambda pick: F.create_map(*[x for t, r in V.ENTITY_RULES.items() for x in (F.lit(t), pick(r))])[F.col("entity_type")]
    prefixes, least, required = case(lambda r: F.array(*map(F.lit, r[0].split()))), case(lambda r: F.lit(r[1])), case(lambda r: F.array(*map(F.lit, r[2].split())))
    keys = F.array_compact(F.transform("observations", lambda o: X.observation_key(o)))
    missing = F.array_except(required, keys)
    known = F.array_compact(F.array(F.when(~F.array_contains(prefixes, X.name_prefix(F.col("name"))), "prefix"), F.when(F.size("observations") < least, "few"), F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(missing), ","))))) 
    problems = F.when(F.col("entity_type").isin(list(V.ENTITY_RULES)), known).otherwise(F.array(F.lit("type")))
    return entities.withColumn("problems", problems).where(F.size("problems") > 0)


def alike_pairs(entities: DataFrame, texts: DataFrame, relations: DataFrame, most: int = 5) -> DataFrame:
    """`a, b, shared, confidence, related`: pairs of entities (`id, name, entity_type`) that share rare tokens of their names and `texts` (`id, text`, any number of rows each), and whether a relation links them.

    A rare token occurs in two to `most` entities of all (and in no more than 5 %, two at least), so a token makes at most `most`
    squared pairs.  Pairs need one scope that is there, types that go together and two shared tokens.
    """
    nodes = entities.select("id", "name", "entity_type", X.scope_key(F.col("name")).alias("scope"))
    said = nodes.select("id", F.col("name").alias("text")).unionByName(texts.join(nodes.select("id"), "id", "left_semi").select("id", "text"))
    tokens = said.select("id", F.explode(X.quality_tokens(F.col("text"))).alias("token")).distinct()
    total = F.broadcast(entities.agg(F.greatest(F.lit(2), F.floor(F.count("*") * 0.05)).alias("_cap")))  # one row
    rare = tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df").between(2, most)).crossJoin(total).where("df <= _cap").drop("_cap")
    rows = tokens.join(rare, "token").join(nodes.where("scope is not null"), "id")
    a, b = rows.alias("a"), rows.alias("b")
    pair = F.concat_ws("|", F.least("a.entity_type", "b.entity_type"), F.greatest("a.entity_type", "b.entity_type"))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.scope") == F.col("b.scope")) & (F.col("a.id") < F.col("b.id"))).where(pair.isin(V.TYPE_PAIRS))
    pairs = pairs.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name")).agg(F.count("*").alias("shared"), F.least(F.lit(1.0), F.sum(1 / F.col("a.df"))).alias("confidence")).where("shared >= 2")
    there = relations.select(F.col("from_name").alias("a_name"), F.col("to_name").alias("b_name"))
    there = there.unionByName(there.select(F.col("b_name").alias("a_name"), F.col("a_name").alias("b_name"))).distinct().withColumn("related", F.lit(True))
    return pairs.join(there, ["a_name", "b_name"], "left").select("a", "b", "shared", "confidence", F.coalesce("related", F.lit(False)).alias("related"))


def missing_relations(entities: DataFrame, texts: DataFrame, relations: DataFrame, most: int = 5) -> DataFrame:
    """`a, b, shared, confidence`: the pairs of `alike_pairs` that no relation links."""
    return alike_pairs(entities, texts, relations, most).where("not related").drop("related")


def report(counts: DataFrame) -> DataFrame:
    """`counts` (`check, violations, total`) with `weight`, `skipped`, `passed`."""
    table = F.broadcast(counts.sparkSession.createDataFrame([(k, w, t) for k, (w, t) in CHECKS.items()], "check string, weight double, least double"))
    share = F.col("violations") / F.greatest(F.col("total"), F.lit(1))
    skipped = F.col("total") == 0
    passed = F.col("least").isNull() | skipped | F.when(F.col("least") == 0, F.col("violations") == 0).otherwise(share < F.col("least"))
    return counts.join(table, "check").select("check", "violations", "total", "weight", skipped.alias("skipped"), passed.alias("passed"))


def health_score(checks: DataFrame) -> DataFrame:
    """One row `score`: 100 less the weighted violations of failed checks, which may fall under 0 since the weights add up to 1.1."""
    lost = F.sum(F.when(~F.col("passed"), F.col("weight") * F.least(2 * F.col("violations") / F.greatest(F.col("total"), F.lit(1)), F.lit(1.0))).otherwise(0.0))
    return checks.agg(F.floor((1 - F.coalesce(lost, F.lit(0.0))) * 100 + 0.5).alias("score"))


def word_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")))


def contradictions(observations: DataFrame, least: float = 0.5) -> DataFrame:
    """`entity_id, prefix, a, b, overlap`: texts of one entity under one prefix that share more than `least` but not all of their words.

    Overlap is shared words over the larger set.  Equal word sets are one text, named by their smallest id.
    A set's words are ordered by rarity within the entity and prefix; two sets that overlap by more than `least` must share
    one of the first `n - floor(least n)` words of each, so only those are joined, and no group is paired with itself.
    Each row of the join has the words of its sets as integers, so it is measured where it is made and goes on only as a result, at the first word that the two share.
    """
    rows = observations.select("id", "entity_id", X.prefix_word(F.col("text")).alias("prefix"), word_set(F.col("text")).alias("words")).where("prefix is not null and entity_id is not null")
    sets = rows.repartition("entity_id", "prefix").groupBy("entity_id", "prefix", "words").agg(F.min("id").alias("id"))
    # a set that is alone in its group is in no pair
    sets = with_ids(sets.withColumn("_n", F.count("*").over(Window.partitionBy("entity_id", "prefix"))).where("_n > 1").drop("_n"), "sets", "v")
    group = ["entity_id", "prefix", "w"]
    words = sets.select("v", "entity_id", "prefix", F.size("words").alias("n"), F.explode("words").alias("w"))
    freq = with_ids(words.groupBy(*group).agg(F.count("*").alias("df")).where("df > 1"), "words", "wid")
    # words of one set alone, which come first in its order, are left out
    ranked = words.join(freq, group).groupBy("v", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "wid"))), lambda x: x["wid"]).alias("ws"))
    firsts = F.greatest(F.lit(0), (F.size("ws") - F.floor(F.col("n") * least)).cast("int"))
    firsts = written(ranked.select("v", "n", "ws", F.explode(F.slice("ws", F.lit(1), firsts)).alias("w")), "firsts")
    a, b = firsts.select(F.col("v").alias("va"), F.col("n").alias("na"), F.col("ws").alias("wa"), "w"), firsts.select(F.col("v").alias("vb"), F.col("n").alias("nb"), F.col("ws").alias("wb"), F.col("w").alias("_w"))
    shared, larger = F.array_intersect("wa", "wb"), F.greatest("na", "nb")
    # no two sets of a group are equal, so none of these overlaps wholly
    hit = (F.col("w") == F.col("_w")) & (F.col("va") < F.col("vb")) & (F.least("na", "nb") > larger * least) & (F.get(shared, F.lit(0)) == F.col("w")) & (F.size(shared) > larger * least)
    pairs = a.join(b, hit).select("va", "vb", (F.size(shared) / larger).alias("overlap"))
    of = lambda c: sets.select(F.col("v").alias(f"v{c}"), F.col("id").alias(f"_{c}"), *(["entity_id", "prefix"] if c == "a" else []))
    out = pairs.join(of("a"), "va").join(of("b"), "vb")
    return out.select("entity_id", "prefix", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "overlap").where("a < b")


def superseded(observations: DataFrame, incoming: DataFrame) -> DataFrame:
    """Observations with `archived`: true if a new one for the entity (`entity_id, text`) has their category."""
    fresh = incoming.select("entity_id", X.writer_category(F.col("text")).alias("category")).where("category is not null").distinct().withColumn("archived", F.lit(True))
    return observations.withColumn("category", X.writer_category(F.col("text"))).join(fresh, ["entity_id", "category"], "left").withColumn("archived", F.coalesce("archived", F.lit(False)))


def consolidated(entities: DataFrame, observations: DataFrame) -> DataFrame:
    """`key, keep_id, merged, texts`: entities whose names differ in case only as one, with the number of distinct texts."""
    groups = entities.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("keep_id"), F.count("*").alias("merged")).where("merged > 1")
    members = entities.select("id", F.lower("name").alias("key")).join(groups, "key", "left_semi")
    texts = observations.select(F.col("entity_id").alias("id"), "text").join(members, "id").select("key", "text").distinct().groupBy("key").agg(F.count("*").alias("texts"))
    return groups.join(texts, "key", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))


def repointed(relations: DataFrame, merges: DataFrame) -> DataFrame:
    """Relations with their ends moved by `merges` (`id, keep_id`); `outcome` 'kept', 'self' or 'duplicate' (all but the smallest id of a triple)."""
    out = relations
    for end in ("from_entity_id", "to_entity_id"):
        out = out.join(merges.select(F.col("id").alias(end), F.col("keep_id").alias("_k")), end, "left").withColumn(end, F.coalesce("_k", F.col(end))).drop("_k")
    triple = ["from_entity_id", "to_entity_id", "relation_type"]
    first = out.groupBy(*[F.col(c).alias(f"_{c}") for c in triple]).agg(F.min("id").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in triple]
    out = out.join(first, same[0] & same[1] & same[2]).drop(*[f"_{c}" for c in triple])
    return out.withColumn("outcome", F.when(F.col("from_entity_id") == F.col("to_entity_id"), "self").when(F.col("id") != F.col("_first"), "duplicate").otherwise("kept")).drop("_first")
