"""Line-delimited JSON and files: tolerant readers that count what they skip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = "struct<type:string,name:string,entityType:string,observations:array<string>,_archived:boolean,from:string,to:string,relationType:string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, value`: the lines of text files."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def parsed_lines(lines: DataFrame, schema: str = ENTITY, value: str = "value") -> DataFrame:
    """`lines` with `record` (null for a malformed line) and `bad`; blank lines are left out."""
    record = F.from_json(value, schema, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json(value).isNotNull() & F.trim(F.col(value)).startswith("{")
    return lines.where(F.trim(value) != "").withColumn("bad", ~ok).withColumn("record", F.when(ok, record))


def line_counts(parsed: DataFrame) -> DataFrame:
    """`lines, bad_lines, entities, relations, observations`."""
    kind = F.col("record.type")
    return parsed.agg(F.count("*").alias("lines"), F.count_if("bad").alias("bad_lines"), F.count_if(kind == "entity").alias("entities"), F.count_if(kind == "relation").alias("relations"), F.coalesce(F.sum(F.when(kind == "entity", F.coalesce(F.size("record.observations"), F.lit(0)))), F.lit(0)).alias("observations"))


def last_entities(parsed: DataFrame, order: str, keep_archived: bool = False) -> DataFrame:
    """One row for each entity name, the last line wins; archived ones only if asked for."""
    rows = parsed.where("record.type = 'entity'").groupBy(F.col("record.name").alias("name")).agg(F.max_by("record", order).alias("r"))
    out = rows.select("name", F.col("r.entityType").alias("entity_type"), F.col("r.observations").alias("observations"), F.coalesce("r._archived", F.lit(False)).alias("archived"))
    return out if keep_archived else out.where("not archived")


def as_lines(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities (`name, entity_type, observations`) and relations (`from_name, to_name, relation_type`) as JSON lines, entities first."""
    e = entities.select(F.lit(0).alias("part"), F.to_json(F.struct(F.lit("entity").alias("type"), "name", F.col("entity_type").alias("entityType"), "observations")).alias("value"))
    r = relations.select(F.lit(1).alias("part"), F.to_json(F.struct(F.lit("relation").alias("type"), F.col("from_name").alias("from"), F.col("to_name").alias("to"), F.col("relation_type").alias("relationType"))).alias("value"))
    return e.unionByName(r)


def write_lines(lines: DataFrame, path: str) -> None:
    """As text files; Spark's commit makes the write all or nothing."""
    lines.sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)


def read_files(spark: SparkSession, path: str, most_bytes: int = 500_000, glob: str = "*", modified_after: str | None = None) -> DataFrame:
    """`path, modified, length, content` of files up to `most_bytes`; dot files and folders are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.load(path).where((F.col("length") <= most_bytes) & ~F.col("path").rlike(r"/\.[^/]+")).select("path", F.col("modificationTime").alias("modified"), "length", "content")


def manifest(files: DataFrame) -> DataFrame:
    """`path, hash`: SHA-256 of each file's content."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def digest(files: DataFrame, path: str = "path", hash_: str = "hash") -> DataFrame:
    """One row `files, digest` for a manifest, whatever its order.

    The SHA-256 of each row is cut into eight numbers, which are added up, and the sums are hashed again: no file list is ever
    gathered, equal rows don't cancel, and partial sums run before the shuffle.
    """
    row = F.sha2(F.concat(F.col(path), F.lit("|"), F.col(hash_)), 256)
    part = lambda i: F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = files.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"p{i}") for i in range(8)])
    return sums.select("files", F.sha2(F.concat_ws("|", F.col("files").cast("string"), *[F.col(f"p{i}").cast("string") for i in range(8)]), 256).alias("digest"))


def frontmatter(files: DataFrame, text: str = "text") -> DataFrame:
    """`files` with `name, description, tags` from a `---` block at the start of markdown texts."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    field = lambda k: F.trim(F.regexp_extract(block, rf"(?m)^{k}:\s*(.*)$", 1), F.lit(" \"'"))
    return files.withColumns({"name": field("name"), "description": field("description"), "tags": F.filter(F.transform(F.split(F.regexp_replace(field("tags"), r"[\[\]]", ""), ","), lambda t: F.trim(t)), lambda t: t != "")})


def bounded_lines(lines: DataFrame, most_chars: int = 16_384) -> DataFrame:
    """Session lines with an identity by content (`import_id`), lines that are too long marked; repeated lines of a file count once."""
    return lines.withColumn("import_id", F.sha2(F.concat_ws("|", "file", "value"), 256)).withColumn("too_long", F.length("value") > most_chars).dropDuplicates(["import_id"])


def package_facts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """`path, ecosystem, package_name` of project manifests."""
    base = F.element_at(F.split(path, "/"), -1)
    eco = F.when(base == "package.json", "node").when(base == "pyproject.toml", "python").when(base == "go.mod", "go").when(base == "Cargo.toml", "rust").when(base.rlike(r"^(docker-)?compose\.ya?ml$"), "compose")
    name = F.when(base == "package.json", F.get_json_object(text, "$.name")).when(base.isin("pyproject.toml", "Cargo.toml"), F.regexp_extract(text, r'(?m)^name\s*=\s*"(.+?)"', 1)).when(base == "go.mod", F.element_at(F.split(F.regexp_extract(text, r"(?m)^module\s+(\S+)", 1), "/"), -1))
    return files.select(path, eco.alias("ecosystem"), name.alias("package_name")).where("ecosystem is not null")


def capsules(lines: DataFrame, known: DataFrame, most_files: int = 32, most_chars: int = 16_384) -> DataFrame:
    """`file, id, outcome` of reports left behind by crashes (`file, value`: one JSON object each): 'imported', 'duplicate' (an id that is known
    or occurs in an earlier file), 'too long' or 'invalid' (to be put aside); only the first `most_files` files by name are looked at, the others wait.
    """
    some = lines.orderBy("file").limit(most_files)
    ok = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    rows = some.withColumn("id", F.when(ok, F.get_json_object("value", "$.id"))).withColumn("_long", F.length("value") > most_chars)
    good = rows.where("id is not null and not _long")
    first = good.groupBy("id").agg(F.min("file").alias("_first"))
    out = rows.join(first, "id", "left").join(known.select("id", F.lit(True).alias("_known")).distinct(), "id", "left")
    return out.select("file", "id", F.when(F.col("_long"), "too long").when(F.col("id").isNull(), "invalid").when(F.col("_known") | (F.col("file") != F.col("_first")), "duplicate").otherwise("imported").alias("outcome"))


# Events that a trace may hold.
TRACE_TYPES = ["tool:call", "tool:result", "search:query", "search:fusion", "bridge:forward"]


def trace_tail(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last `n` (one at least) of the events (`type, ts`) that a trace may hold, newest first: a distributed top-n."""
    fine = events.where(F.col("type").isin(TRACE_TYPES) & F.col("ts").isNotNull())
    return fine.orderBy(*[F.col(c).desc() for c in order]).limit(max(1, n))


GRAPH = "struct<_type:string,id:string,kind:string,name:string,file:string,from:string,to:string,line:int,symbols:long,relations:long>"


def graph_lines(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """A code graph (`id, kind, name, path`; `src, dst, kind, line`) as JSON lines: `part, value`, the counts first."""
    s = symbols.select(F.lit(1).alias("part"), F.to_json(F.struct(F.lit("symbol").alias("_type"), "id", "kind", "name", F.col("path").alias("file"))).alias("value"))
    r = relations.select(F.lit(2).alias("part"), F.to_json(F.struct(F.lit("relation").alias("_type"), F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "line")).alias("value"))
    n = symbols.agg(F.count("*").alias("symbols")).crossJoin(relations.agg(F.count("*").alias("relations")))
    meta = n.select(F.lit(0).alias("part"), F.to_json(F.struct(F.lit("meta").alias("_type"), "symbols", "relations")).alias("value"))
    return meta.unionByName(s).unionByName(r)


LINE_SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("value", T.StringType())])
