"""q78: subsets are counted where they are made."""

import os

import pytest

from weftline.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables of the driver")
def test_subsets_are_not_joined(spark):
    plan = QUERIES["q78_deletion_fraction"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")  # printed from the top: subsets are made above the join
