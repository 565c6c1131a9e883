"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as entry

from .conftest import TESTDATA


def plan(spark, name):
    df = entry.queries()[name](spark, TESTDATA)
    return spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


#: Queries that meet a bounded, counted side row by row.
BOUNDED = {"claims_later", "idf_select", "month_quota"}


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not re.match(r"p\d+_", n)))
def test_no_cross_joins(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p or name in BOUNDED


@pytest.mark.parametrize("name", ["search_multi", "search_facets", "history_map", "timeline_map", "said_dedup", "sessions_summary", "neighbours_k", "resume_latest", "commit_prefix_join", "digest_unique", "p3_found", "p6_found"])
def test_stay_in_the_jvm(spark, name):
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan(spark, name))


def test_columns_are_pruned_and_filters_pushed(spark):
    p = plan(spark, "timeline_kinds")
    assert "item_text" not in re.search(r"ReadSchema: struct<([^>]*)>", p)[1]
    p = plan(spark, "p6_found")
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(state,done\)", p) and re.search(r"PushedFilters: \[[^]]*EqualTo\(ends_line,true\)", p)


def test_pages_are_top_k(spark):
    for name in ("search_page_asc", "said_page", "sessions_page"):
        assert "TakeOrderedAndProject" in plan(spark, name)


def test_copies_are_folded_before_the_shuffle(spark):
    p = plan(spark, "said_dedup")
    assert p.count("Aggregate") >= 2 and "partial_min" in p and ") Window" not in p
