"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__  # noqa: F401
from checks.registry import QUERIES
from checks import fixtures as fx
from letterloom.operators import stats as S
from letterloom.operators import threads as T

DATA = "/root/testdata/sf0.001"
# These run a stream or write a table before they return, so their plan is a scan.
STREAMS = tuple(n for n in QUERIES if n[0] == "T" and not n.endswith("_batch"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", sorted(set(QUERIES) - set(STREAMS) - {"S6_rebuild_snapshot", "S7_mirror"}))
def test_no_nested_loops_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert word not in plan, word


def test_view_summary_is_one_pass(spark):
    plan = plan_of(S.view_summary(fx.table(spark, DATA, "mail"), fx.AS_OF))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_conversations_combine_before_the_shuffle(spark):
    plan = plan_of(T.conversations(fx.table(spark, DATA, "mail")))
    assert "partial_max_by" in plan and "collect_list" not in plan
    assert plan.count("Exchange") == 1


def test_thread_limits_run_before_the_shuffle(spark):
    plan = plan_of(T.thread_transcript(fx.table(spark, DATA, "mail"), messages=30))
    below = plan.split("Exchange", 1)[1]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_briefing_is_one_scan_with_early_limits(spark):
    from letterloom.operators import briefing as B

    mail = fx.table(spark, DATA, "mail")
    plan = plan_of(B.briefing_sections(mail, fx.AS_OF))
    assert plan.count("FileScan") == plan_of(mail).count("FileScan")
    assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning(section") == 1
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning(section", 1)[1]


def test_contacts_are_one_scan(spark):
    from letterloom.operators import people as P

    mail = fx.table(spark, DATA, "mail")
    assert plan_of(P.address_union(mail)).count("FileScan") == plan_of(mail).count("FileScan")
