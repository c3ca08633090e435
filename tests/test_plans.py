"""Plans of every registered query: no pairing of all rows, no one-task windows, no Python workers."""

import re
from pathlib import Path

import pytest

from oddslake.plans import QUERIES

SF = "/root/testdata/sf0.001"
# An Arrow function named run folds text beyond ASCII; nothing else leaves the JVM.
FORBIDDEN = {
    "cross join": r"CartesianProduct|BroadcastNestedLoopJoin|Cross\b",
    "python worker": r"BatchEvalPython|FlatMapGroupsInPandas|MapInPandas|ArrowEvalPython \[(?!run\()",
    # A window without partition keys gathers all rows in one task first.
    "window over everything": r"Window \[[^\n]*\n(?:[^\n]*(?:Sort|WindowGroupLimit|Project)[^\n]*\n)*[^\n]*Exchange SinglePartition",
}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.name)
def test_plan_scales(spark, query):
    df = query(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for what, pattern in FORBIDDEN.items():
        assert not re.search(pattern, plan), (what, plan)
    assert df.limit(1).count() <= 1


def test_every_query_has_sql_and_a_unique_name():
    names = [q.name for q in QUERIES]
    assert len(names) == len(set(names)) and all(q.sql for q in QUERIES)


def test_filters_and_columns_reach_the_scan(spark):
    from oddslake.plans.snapshot_queries import coverage, snapshot

    plan = snapshot(spark, SF, True)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan
    plan = coverage(True)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)", plan)
    assert any("l_partkey" not in columns for columns in scans), scans


def test_label_filter_does_not_repeat_the_patterns(spark):
    from oddslake.operators.topics import classify, select_topics

    labelled = classify(spark.createDataFrame([("US GDP",)], "t STRING"), "t")
    tree = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert tree(select_topics(labelled)).count("nonfarm") == tree(labelled).count("nonfarm") > 0


@pytest.mark.parametrize("name", ["normalize_kalshi_quotes", "normalize_polymarket_outcomes", "clob_book_levels"])
def test_payload_rows_are_dealt_before_they_are_parsed(spark, name):
    """One row group is one task; only the columns that the payload needs are dealt."""
    from oddslake.plans import normalize_queries

    plan = next(q for q in QUERIES if q.name == name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.rindex("Repartition") :]
    assert "from_json" not in dealt and "get_json_object" not in dealt and "l_comment" not in dealt
    assert normalize_queries.spread_table(spark, SF, "lineitem").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
