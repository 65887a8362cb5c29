"""Registered queries: contract, plans and a sample of the SQL checks."""

import pytest

import __spark_entry__ as contract
from tools.check_oracles import compare, connect

SMALL = "/root/testdata/sf0.001"
CHECKED = (
    "remove_superusers", "thread_structure", "annotation_sample", "html_to_text",
    "normalize_text", "corpus_summary", "moderator_candidates", "lexicon_scores_all",
    "gazetteer_entities", "mask_text", "tfidf_terms", "macro_metrics_by_language",
)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_contract(spark):
    names = set(contract.queries())
    assert set(contract.oracle_sql()) <= names and len(names) > 90
    assert contract.entry(spark).count() >= 0


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    line = compare(
        spark, connect(SMALL), SMALL, name, contract.queries()[name], contract.oracle_sql()[name]
    )
    assert line.startswith("ok") and "types" not in line, line


@pytest.mark.parametrize(
    "name",
    ("remove_moderators", "annotation_sample", "lexicon_scores_all", "tfidf_terms",
     "cap_sensitivity", "cohens_kappa", "confusion_matrix", "messages_per_month"),
)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = plan_of(contract.queries()[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_names_take_one_arrow_scan(spark):
    """Names are looked for by a trie, in batches; no other Python and no join."""
    plan = contract.queries()["mask_names"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "Join"):
        assert bad not in plan


def test_structure_takes_one_shuffle(spark):
    from agoralytics.operators.threads import thread_structure
    from agoralytics.session import cut_lineage
    from agoralytics.sources.views import forum_tables

    messages = cut_lineage(forum_tables(spark, SMALL).messages)
    plan = thread_structure(messages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_cap_limits_before_the_shuffle(spark):
    plan = plan_of(contract.queries()["user_cap_sample"](spark, SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(contract.queries()["user_activity"](spark, SMALL))
    assert "ReadSchema: struct<o_custkey:bigint>" in plan
    assert "IsNotNull(o_custkey)" in plan
