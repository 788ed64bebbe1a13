"""Each pN_found gets its rows through its operator: the optimized plan holds the operator's own step."""

import pytest

from farelode.llm import queries

STEPS = {
    "p1_found": ["MapInPandas"], "p3_found": ["MapInPandas"], "p5_found": ["MapInPandas"], "p6_found": ["MapInPandas"], "p7_found": ["MapInPandas", "LogicalRDD"], "p8_found": ["MapInPandas", "LogicalRDD"],
    "p9_found": ["Relation", "goes_on"],  # the written counts of the ending model
}


@pytest.mark.parametrize("name", STEPS)
def test_the_operator_is_in_the_plan(spark, small, name):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert all(step in plan for step in STEPS[name]), plan
