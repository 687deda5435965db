"""Duplicates hidden by formatting differences.

A text is a multiset of fields, a field a sequence of words.  Field values are
dictionary-encoded: each distinct value is canonicalised once per worker, each distinct canonical value gets
an integer, a record becomes the sorted tuple of its integers, and equal tuples are grouped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.skew import hot_keys, salted_join
from quern.plans.tables import with_ids, written

WORD = re.compile(r"[^\W_]+")
BRACKET = re.compile(r"\s*\[[^\]]*\]")
PIECES = re.compile(r"[;|]")
#: Bounds of a worker's dictionary of canonical values: entries, and characters of a value worth keeping.
CACHE_VALUES, CACHE_CHARS = 200_000, 400


class _Members(list):
    """The members of a JSON object in the order of the text, repeated names included."""


def _words_of(value) -> list[str]:
    """The scalar texts inside a JSON value, in order."""
    if isinstance(value, _Members):
        return [w for k, v in value for w in [k, *_words_of(v)]]
    if isinstance(value, list):
        return [w for v in value for w in _words_of(v)]
    if isinstance(value, str):
        return [value]
    return [json.dumps(value)]


def split_fields(text: str) -> list[str]:
    """A text's fields: members of a JSON object if it is one, else the pieces between `;` and `|`."""
    if text.lstrip()[:1] == "{" and text.rstrip()[-1:] == "}":
        try:
            members = json.loads(text, object_pairs_hook=_Members, parse_int=str, parse_float=str)
            if isinstance(members, _Members):
                return [" ".join([k, *_words_of(v)]) for k, v in members]
        except (ValueError, RecursionError):
            pass
    return PIECES.split(text)


def canonical(value: str) -> str:
    """The words of a field in lower case with one blank between; empty without words."""
    return " ".join(WORD.findall(value.casefold()))


def record_text(content: str | None, raw_text: str | None) -> str | None:
    """`content` if it holds a letter or digit, else `raw_text` without its leading bracket."""
    if content and WORD.search(content):
        return content
    return BRACKET.sub("", raw_text, count=1) if raw_text and BRACKET.match(raw_text) else raw_text


def record_fields(rows: DataFrame, key: str, content: str, raw_text: str, order: str | None) -> DataFrame:
    """Written table `key, at, values`: the canonical fields of each row with words, made in the only Python pass over the rows.

    `at` is the row's `order` (the largest number for null), or a hash of its text if there is no `order`.
    """

    def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, str] = {}
        for batch in batches:
            keys, ats, lists = [], [], []
            for k, n, c, r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = record_text(c, r)
                if k is None or not text:
                    continue
                values = []
                for raw in split_fields(text):
                    value = seen.get(raw)
                    if value is None:
                        value = canonical(raw)
                        if len(raw) <= CACHE_CHARS:
                            if len(seen) >= CACHE_VALUES:
                                seen.clear()
                            seen[raw] = value
                    if value:
                        values.append(value)
                if values:
                    keys.append(k)
                    ats.append(n)
                    lists.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ats, pa.int64()), pa.array(lists, pa.list_(pa.string()))], names=[key, "at", "values"])

    at = F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1)) if order else F.xxhash64(content, raw_text)
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("at", T.LongType()), T.StructField("values", T.ArrayType(T.StringType()))])
    return written(rows.select(key, at.alias("at"), content, raw_text).mapInArrow(fields, schema), "fields")


def field_tuples(rows: DataFrame, key: str, content: str, raw_text: str, order: str | None = None) -> DataFrame:
    """Written table `key, fields`: for each key with words the sorted integers of its fields, repeated ones included.

    If a key has several rows, that with the smallest `order` holds (null last; without `order` that with the smallest hash
    of its text).  Rows of one key and order are one record: a field at the same place counts once.
    """
    values = record_fields(rows, key, content, raw_text, order).select(key, "at", F.posexplode("values").alias("pos", "value"))
    words = with_ids(values.groupBy("value").agg(F.count("*").alias("n")), "values")
    hot = hot_keys(words, "value")
    coded = salted_join(values, words.select("value", "kid"), "value", hot, F.col(key)).select(key, "at", "pos", "kid")
    first: Column = F.array_min("l")["at"]
    tuples = coded.groupBy(key).agg(F.collect_set(F.struct("at", "pos", "kid")).alias("l"))
    return written(tuples.select(key, F.array_sort(F.transform(F.filter("l", lambda x: x["at"] == first), lambda x: x["kid"])).alias("fields")), "tuples")


def distinct_records(tuples: DataFrame, key: str) -> DataFrame:
    """`fields, keep_id, copies`: one row for each distinct text, the smallest key and the number of keys."""
    return tuples.groupBy("fields").agg(F.min(key).alias("keep_id"), F.count("*").alias("copies"))


def formatting_duplicates(rows: DataFrame, key: str = "id", content: str = "content", raw_text: str = "raw_text", order: str | None = None) -> DataFrame:
    """`keep_id, copy_id` for each key but the smallest of every set of keys with the same text.

    Rows without key and texts without words are left out; of several rows with one key the
    first by `order` holds (see `field_tuples`), and a row that occurs again is the same record; unchanged copies under other keys count; an empty table gives no
    rows; other columns play no role.
    """
    tuples = field_tuples(rows, key, content, raw_text, order)
    groups = distinct_records(tuples, key).where("copies > 1").withColumnRenamed("copies", "n")
    groups = written(groups, "copies")
    pairs = salted_join(tuples, groups.drop("n"), "fields", hot_keys(groups, "fields"), F.col(key))
    return pairs.where(F.col(key) != F.col("keep_id")).select("keep_id", F.col(key).alias("copy_id"))
