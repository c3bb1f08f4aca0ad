"""What a query does for a row, and in how many tasks, does not worsen with the number of rows."""

import os

import pyarrow as pa
import pytest

from pgq import catalog_queries as Q
from pgq.operators import evaluation as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def optimized(spark, name):
    return Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["value_typing", "normalize_ir"])
def test_texts_are_read_after_rows_are_dealt_out_and_types_looked_at_once(spark, name):
    plan = optimized(spark, name)
    above, dealt, below = plan.partition("RepartitionByExpression [o_orderkey")
    assert dealt and "parseJson" in above and "parseJson" not in below, plan
    assert plan.count("parseJson") == 1 and plan.count("schemaOfVariant") <= 60, plan.count("schemaOfVariant")


@pytest.mark.parametrize("name", ["agg_expansion", "order_limit_expansion"])
def test_policy_goes_to_large_intents(spark, name):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the intents were too large for it
    try:
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1 and "BuildRight" in plan, plan


JUDGED = {"component_accuracy": "_components", "error_ranking": "_errors", "error_values": "_errors", "field_accuracy": "_fields", "exact_match": "_fields", "schema_diff": "_errors", "error_paths": "_errors"}


@pytest.mark.parametrize("name", sorted(JUDGED))
def test_texts_are_compared_once_in_one_way_after_rows_are_dealt_out(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.count(f"ArrowEvalPython [{JUDGED[name]}(") == 1, plan
    above, dealt, below = plan.partition("hashpartitioning(o_orderkey")
    assert dealt and "ArrowEvalPython" in above and '{"src":"Region"' not in below, plan


def test_branches_that_come_again_are_found_as_a_walk_finds_them(monkeypatch):
    trees = ["1", "1.0", "true", "null", '"1"', "[]", "{}", "no json", '{"a": 1}', '{"a": 1.0}', '{"a": true, "b": [3, 1]}', '{"a": [1, 3], "b": [1, 3]}', '{"a": {"b": [{"c": 1}, {"c": "1"}]}, "": null}',
             '{"a": {"b": [{"c": 1.0}]}, "filters": [{"attribute": "x", "value": 1}, {"attribute": "a"}]}', '{"filters": [{"attribute": "a"}, {"value": 1.0, "attribute": "x"}]}', '{"a": [NaN, 1], "b": {"": {"": 0.0}}}', '{"b": {"": {"": -0.0}}}', '{"a": ' + "[" * 400 + "]" * 400 + "}"]
    pairs = [(a, b) for a in trees for b in trees] * 2
    gold, predicted = (pa.array(x) for x in zip(*pairs, strict=True))
    monkeypatch.setattr(E, "KEPT", 3_000)  # emptied again and again
    errors, parts, fields = E._errors(gold, predicted).to_pylist(), E._components(gold, predicted).to_pylist(), E._fields(gold, predicted).to_pylist()
    for i, (a, b) in enumerate(pairs):
        g, p = E.ordered(E.parsed(a)), E.ordered(E.parsed(b))
        found, total, right = E.differences(g, p)
        assert [tuple(e.values()) for e in errors[i]] == found, (a, b)
        assert [tuple(e.values()) for e in parts[i]] == [(k, 1, ok) for k, ok in E.components(g, p)], (a, b)
        assert fields[i] == {"total": total, "correct": right, "errors": len(found)}, (a, b)
    assert E._of_errors.size <= 3_000 + E.LONGEST and len(E._of_errors.known) > 1
