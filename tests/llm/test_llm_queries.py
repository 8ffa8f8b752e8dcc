"""All queries on training data run over the smallest data folder, with the columns that are promised."""

from __future__ import annotations

from pathlib import Path

import pytest

from codeloom.llm.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")
COLUMNS = {"p1_found": {"id_a", "id_b"}, "p2_found": {"id"}, "p3_found": {"id"}, "p4_found": {"id", "line_no"}, "p6_found": {"id"}, "p7_found": {"doc_id", "item_id"}, "p9_found": {"doc_id_a", "doc_id_b"}}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, str(FOLDER))
    rows = [tuple(map(str, r)) for r in result.collect()]
    if name in COLUMNS:
        assert set(result.columns) == COLUMNS[name]
        assert len(rows) == len(set(rows))
