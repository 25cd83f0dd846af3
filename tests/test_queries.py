"""Every query has the columns of its check; a sample is compared with it on the smallest data."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect

from colophon.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["read_cells", "build_entries", "topk_inner_product", "merge_results", "html_text", "route_queries", "reading_order", "folder_items"]


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches(spark, name):
    text, _, fine = compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name])
    assert fine, text
