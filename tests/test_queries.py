"""Every registered query against its SQL on the given tables."""

import os

import pytest

from __spark_entry__ import entry
from tarnseek.plans.registered import all_queries as queries
from tarnseek.plans.registered import all_sql as oracle_sql
from tests.compare import TESTDATA, connect, differences

SF = os.environ.get("TEST_SF", "sf0.001")


# Row-by-row Python, all-pairs joins and windows over everything in one task.
UNWANTED = ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "windowspecdefinition(specified")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con():
    return connect(f"{TESTDATA}/{SF}")


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_as_sql(spark, con, name):
    df = queries()[name](spark, f"{TESTDATA}/{SF}")
    plan = plan_of(df)
    assert not [node for node in UNWANTED if node in plan]
    assert differences(df, con, oracle_sql()[name]) == []


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 15
    assert [r["n_chars"] for r in rows] == sorted((r["n_chars"] for r in rows), reverse=True)
    assert {r["lang"] for r in rows} == {"en"}


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("filter_eq_int", "EqualTo(p_size,11)"),
        ("filter_eq_date", "EqualTo(o_orderdate,1998-10-03T00:00)"),
        ("filter_range_double", "LessThan(l_quantity,5.3)"),
        ("filter_between_int", "GreaterThanOrEqual(p_size,10), LessThanOrEqual(p_size,14)"),
        ("like_prefix", "StringStartsWith(p_name,red)"),
        ("like_glob_string", "StringStartsWith(url,http)"),
        ("text_filter_sort_page", "EqualTo(lang,en)"),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan_of(queries()[name](spark, f"{TESTDATA}/{SF}"))


def test_scans_read_only_what_is_asked(spark):
    plan = plan_of(queries()["filter_range_double"](spark, f"{TESTDATA}/{SF}"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan


def test_hot_groups_are_cut_before_the_shuffle(spark):
    heads = plan_of(queries()["group_head"](spark, f"{TESTDATA}/{SF}"))
    assert heads.index("Final") < heads.index("Exchange") < heads.index("Partial")
    counts = plan_of(queries()["group_count_string"](spark, f"{TESTDATA}/{SF}"))
    assert "partial_count" in counts and "SortAggregate" not in counts
