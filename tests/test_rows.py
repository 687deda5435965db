"""Queries that once compared nothing but a row put in for the purpose: they find rows of their own, and their SQL finds the same."""

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["error_markers", "missing_relations", "http_routes", "transcript_capture", "framework_edges", "indexed_relations", "import_endings", "write_validation", "public_symbols", "manifest_digest"])
def test_rows_and_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) == ""
