"""The queries of this subpackage on the smallest tables, where they are there."""

import os

import pytest

from lakeloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(Q.ORACLES) <= set(Q.QUERIES)
    first = {}
    for n in Q.QUERIES:
        first.setdefault(n.split("_")[0], n)
    assert first == {"p1": "p1_found", "p2": "p2_found", "p6": "p6_containers", "p8": "p8_ids", "p9": "p9_found", "p10": "p10_found"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p2_found", "p9_found", "p10_found"])
def test_columns(spark, name):
    want = {"p2_found": ["row_id", "field_name", "kind", "start_pos"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind"]}[name]
    assert Q.QUERIES[name](spark, DATA).columns == want
