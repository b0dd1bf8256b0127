"""Queries of the subpackage against their SQL on the smallest tables."""

import os

import pytest

from tests import oracle


@pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", ["p2_found", "p2_links", "p4_found", "p6_found", "p7_found", "p7_blocks", "p9_found", "p9_items", "p9_passages", "p8_faults", "p8_instructions_faults", "p4_exact", "p6_faults", "p7_totals", "p10_texts"])
def test_same_rows(spark, name):
    oracle.same_rows(spark, name)
