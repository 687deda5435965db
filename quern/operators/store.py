"""The knowledge store: scopes, lifecycles, idempotent writes and cascades, as DataFrame transformations.

Writes are expressed as new versions of the tables (old keys anti-joined, new rows
united), to be written to a new path and swapped in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vocab as V


def once(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows delivered twice count once; rows without key are left out."""
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key])


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


#: Stands for a project that was asked for but not found: nothing is in its scope, not even global rows.
UNRESOLVED = "\x00unresolved"


def in_scope(project: Column, project_id: str | None, include_global: bool = False) -> Column:
    """Null-safe: no project means global rows only, never everything; an unresolved one means nothing."""
    if project_id == UNRESOLVED:
        return F.lit(False)
    mine = project.eqNullSafe(F.lit(project_id))
    return mine | project.isNull() if include_global else mine


def visible(entities: DataFrame, project_id: str | None, include_global: bool = False, lifecycles: tuple[str, ...] = ("active",)) -> DataFrame:
    return entities.where(in_scope(F.col("project_id"), project_id, include_global) & F.col("lifecycle").isin(*lifecycles))


def active_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations that are active between two active entities."""
    alive = entities.where("lifecycle = 'active'").select("id")
    rel = relations.where("lifecycle = 'active'")
    return rel.join(alive.withColumnRenamed("id", "from_entity_id"), "from_entity_id", "left_semi").join(alive.withColumnRenamed("id", "to_entity_id"), "to_entity_id", "left_semi")


def induced(relations: DataFrame, nodes: DataFrame, key: str = "name") -> DataFrame:
    """Relations with both ends among the nodes."""
    names = nodes.select(F.col(key).alias("_n")).distinct()
    for end in ("from_name", "to_name"):
        relations = relations.join(names, relations[end] == names["_n"], "left_semi")
    return relations


def open_nodes(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """`asked` (one column `wanted`: names in any case, or ids) with the entities they mean; null where there is none."""
    by_name = entities.select(F.lower("name").alias("_k"), "id", "name", "entity_type", "lifecycle")
    by_id = entities.select(F.col("id").alias("_k"), "id", "name", "entity_type", "lifecycle")
    keys = by_name.unionByName(by_id).distinct()
    return asked.join(keys, F.lower("wanted") == F.col("_k"), "left").drop("_k")


def with_observations(entities: DataFrame, observations: DataFrame, first: int | None = None) -> DataFrame:
    """Entities with their texts in order of arrival, at most `first` of them.

    Texts without entity don't count.  With `first` they are ranked before the shuffle, so that only the first few of an entity
    are moved and gathered; without it an entity's row holds all its texts by definition.
    """
    observations = observations.where("entity_id is not null").select("entity_id", "seq", "text")
    if first:
        w = Window.partitionBy("entity_id").orderBy("seq", "text")
        observations = observations.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first).drop("_n")
    texts = observations.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("observations"))
    out = entities.join(texts, entities["id"] == texts["entity_id"], "left").drop("entity_id")
    return out.withColumn("observations", F.coalesce("observations", F.array().cast("array<string>")))


def replace_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert by replacing: rows of `new` instead of those of `old` with their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def merge_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Create entities, idempotently: `project_id, name, entity_type, lifecycle, observations, outcome`.

    Both sides have `project_id, name, entity_type, lifecycle, observations`.  An entity that is there keeps its
    type, lifecycle and order of texts and gets the unseen ones ('merged' or 'unchanged'); another type is a 'conflict' and changes nothing.
    """
    new = incoming.select(*[F.col(c).alias(f"n_{c}") for c in ("project_id", "name", "entity_type", "lifecycle", "observations")])
    both = existing.join(new, F.col("project_id").eqNullSafe(F.col("n_project_id")) & (F.col("name") == F.col("n_name")), "full_outer")
    old, fresh = F.col("name").isNotNull(), F.col("n_name").isNotNull()
    conflict = old & fresh & (F.col("entity_type") != F.col("n_entity_type"))
    union = F.array_distinct(F.concat("observations", "n_observations"))
    outcome = F.when(~old, "created").when(~fresh, "kept").when(conflict, "conflict").when(F.size(union) > F.size("observations"), "merged").otherwise("unchanged")
    texts = F.when(~old, F.array_distinct("n_observations")).when(conflict | ~fresh, F.col("observations")).otherwise(union)
    return both.select(F.when(old, F.col("project_id")).otherwise(F.col("n_project_id")).alias("project_id"), F.coalesce("name", "n_name").alias("name"), F.coalesce("entity_type", "n_entity_type").alias("entity_type"), F.coalesce("lifecycle", "n_lifecycle").alias("lifecycle"), texts.alias("observations"), outcome.alias("outcome"))


def insert_relations(existing: DataFrame, incoming: DataFrame, entities: DataFrame) -> DataFrame:
    """`incoming` (`from_entity_id, to_entity_id, relation_type`) with `outcome`: 'inserted', 'exists' or 'no endpoint'; repeated rows count once."""
    usable = entities.where(F.col("lifecycle").isin("active", "candidate")).select(F.col("id").alias("_e"))
    out = incoming.distinct()
    for end in ("from_entity_id", "to_entity_id"):
        out = out.join(usable.withColumnRenamed("_e", f"_{end}"), F.col(end) == F.col(f"_{end}"), "left")
    there = existing.select("from_entity_id", "to_entity_id", "relation_type").distinct().withColumn("_there", F.lit(True))
    out = out.join(there, ["from_entity_id", "to_entity_id", "relation_type"], "left")
    ends = F.col("_from_entity_id").isNotNull() & F.col("_to_entity_id").isNotNull()
    return out.select("from_entity_id", "to_entity_id", "relation_type", F.when(~ends, "no endpoint").when(F.col("_there"), "exists").otherwise("inserted").alias("outcome"))


def delete_cascade(entities: DataFrame, observations: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the entities named in `gone` (`name`), their observations and the relations that touch them."""
    g = gone.select(F.col("name").alias("_g")).distinct()
    rel = relations.join(g, F.col("from_name") == F.col("_g"), "left_anti").join(g, F.col("to_name") == F.col("_g"), "left_anti")
    return entities.join(g, F.col("name") == F.col("_g"), "left_anti"), observations.join(g, F.col("entity_name") == F.col("_g"), "left_anti"), rel


def archive(rows: DataFrame, hit: Column) -> DataFrame:
    return rows.withColumn("lifecycle", F.when(hit & F.col("lifecycle").isin("active", "candidate"), "archived").otherwise(F.col("lifecycle")))


def archive_cascade(entities: DataFrame, observations: DataFrame, relations: DataFrame, hit: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with the entities for which `hit` holds archived, and with them their observations and the relations that touch them."""
    gone = entities.where(hit & F.col("lifecycle").isin("active", "candidate")).select(F.col("id").alias("_g"), F.lit(True).alias("_hit"))
    with_ = lambda df, key: df.join(gone.select(F.col("_g").alias(key), "_hit"), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    obs = archive(with_(observations, "entity_id"), F.col("_hit")).drop("_hit")
    rel = with_(with_(relations, "from_entity_id").withColumnRenamed("_hit", "_from"), "to_entity_id")
    return archive(entities, hit), obs, archive(rel, F.col("_hit") | F.col("_from")).drop("_hit", "_from")


def archive_texts(observations: Column, targets: list[str]) -> Column:
    """Array of `(text, archived)`: archived where a text holds one of the targets."""
    return F.transform(observations, lambda o: F.struct(o.alias("text"), F.exists(F.array(*[F.lit(t) for t in targets]), lambda t: F.contains(o, t)).alias("archived")))


def transition(entities: DataFrame, requests: DataFrame, moves: dict[str, str] = V.LIFECYCLE_MOVES) -> DataFrame:
    """`requests` (`id, to`) with `from`, and `outcome`: 'moved', 'same', 'illegal' or 'missing'."""
    spark = entities.sparkSession
    table = spark.createDataFrame([(a, b, True) for a, bs in moves.items() for b in bs.split()], "`from` string, `to` string, legal boolean")
    out = requests.join(entities.select("id", F.col("lifecycle").alias("from")), "id", "left").join(F.broadcast(table), ["from", "to"], "left")
    return out.select("id", "from", "to", F.when(F.col("from").isNull(), "missing").when(F.col("from") == F.col("to"), "same").when(F.col("legal"), "moved").otherwise("illegal").alias("outcome"))


def pick(entities: DataFrame, project_id: str | None, names: DataFrame) -> DataFrame:
    """Point lookup by name and project: `names` (one column `wanted`) with the entity of exactly that name in the project (null: global), null where there is none."""
    mine = entities.where(in_scope(F.col("project_id"), project_id)).select(F.col("name").alias("wanted"), "id", "entity_type", "lifecycle")
    return names.join(mine, "wanted", "left")


def among(entities: DataFrame, names: list[str] = (), types: list[str] = ()) -> DataFrame:
    """Entities with one of the names and one of the types, letter case ignored; an empty list asks for nothing."""
    for column, wanted in (("name", names), ("entity_type", types)):
        if wanted:
            entities = entities.where(F.lower(column).isin([w.lower() for w in wanted]))
    return entities


def append_history(history: Column, entry: Column, cap: int = 50) -> Column:
    """The last `cap` entries after adding one."""
    grown = F.concat(F.coalesce(history, F.array()), F.array(entry))
    return F.slice(grown, F.greatest(F.size(grown) - cap + 1, F.lit(1)), cap)


def history_rows(rows: DataFrame, key: str, observations: str, limit: int = 100) -> DataFrame:
    """Flattened histories (`observations` is an array of structs with `content, history`), newest first for each key."""
    flat = rows.select(key, F.posexplode(observations).alias("at", "o")).select(key, "at", F.col("o.content").alias("content"), F.posexplode("o.history").alias("n", "h"))
    w = Window.partitionBy(key).orderBy(F.col("h.changed_at").desc(), "at", "n")
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(key, "rank", "at", "content", "h.*")


def as_structs(observations: Column) -> Column:
    """Plain texts as structs with all fields of the later form; idempotent use is up to the caller's schema."""
    return F.transform(observations, lambda o: F.struct(o.alias("content"), F.lit(None).cast("string").alias("branch"), F.lit(False).alias("archived"), F.array().cast("array<struct<content:string,changed_at:string,reason:string>>").alias("history")))


def keep_newest(rows: DataFrame, order: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    """The newest `n` rows (of each key in `by`).  Without `by` the limit is a distributed top-n, not one big window."""
    if by:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    return rows.orderBy(*order).limit(n)
