"""Driver contract: entry runs, every oracle has a query, queries build plans."""

import __spark_entry__ as ent


def test_entry_smoke(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"thread_id", "conv_no", "store_rank"}


def test_oracles_have_queries():
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_core_plans_stay_in_jvm(spark):
    from chatlake.plans import catalog
    for name in ["merge_turns", "filter_reasons", "token_stats", "parse_attributes"]:
        plan = catalog.REGISTRY[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan, name


def test_scan_pushes_projection(spark):
    from chatlake.plans import catalog
    plan = catalog.REGISTRY["sessionize_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution() \
        .executedPlan().toString()
    # Column pruning reaches the scan: the unused ``props`` column is never read.
    assert "ReadSchema: struct<event_id:bigint" in plan
    assert "props" not in plan


def test_plans_of_line_and_subset_queries_stay_small(spark):
    """What is left behind the staged tables: few exchanges, no nested loops, no Python besides Arrow."""
    import re

    for name, most in (("parse_exports", 5), ("speaker_census", 6), ("subset_ladder", 8), ("validation_split", 10)):
        plan = ent.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"(?<![A-Za-z])Exchange ", plan)) <= most, name
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "MapInPandas" not in plan
