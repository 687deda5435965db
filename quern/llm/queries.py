"""The queries p4, p6, p7 and p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.duplicates import distinct_records, field_tuples, formatting_duplicates
from quern.llm.encoding import garbled_documents, held_out_quality
from quern.llm.packing import fill_report, pack_check, pack_documents
from quern.llm.sql import SQL
from quern.llm.tokens import token_ids
from quern.plans.tables import load

__all__ = ["QUERIES", "SQL"]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatting_duplicates(load(spark, sf, "observations"), order="seq")


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_records(field_tuples(load(spark, sf, "observations"), "id", "content", "raw_text", "seq"), "id").select("keep_id", "copies")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids(load(spark, sf, "documents"), "doc_id", "text", "byte_bpe_50k")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(load(spark, sf, "documents"), load(spark, sf, "containers"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p7_containers(spark, sf))


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    return pack_check(load(spark, sf, "documents"), load(spark, sf, "containers"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled_documents(load(spark, sf, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled_documents(load(spark, sf, "documents"))


def p8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return held_out_quality(load(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_records, p6_ids, p7_containers, p7_report, p7_check, p8_found, p8_restored, p8_quality)}
