"""Every query against an independent engine on the smallest tables, and the shape of the plans."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

from lingloom import queries as Q  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def alike(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(Q.oracle_sql()[name])
    named = [d[0] for d in rel.description]
    assert sorted(named) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(r[named.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(alike(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


WITH_PYTHON = {"model_score_udf", "cached_completions", "blobs", "pool_mix", "token_offsets", "group_advantage", "batch_advantage", "policy_loss_grpo", "policy_loss_reinforce", "eval_report", "severity_counts", "reward_stats", "pipeline_verdicts", "pipeline_final", "policy_loss_entropy", "rollout_means", "reward_report", "batch_statistics", "severity_means", "training_rows"}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_plan_stays_in_the_engine(spark, name):
    plan = Q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in WITH_PYTHON and not name.startswith("span_"):
        assert "Python" not in plan and "ArrowEval" not in plan and "Pandas" not in plan


def test_segments_and_blobs_are_not_shuffled(spark):
    for name in ("segments", "blobs", "lines_merged"):
        assert "Exchange" not in Q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    plan = Q.queries()["approx_len"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = Q.queries()["cache_hits"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "teacher" not in plan.split("ReadSchema")[1]


def test_top_k_cuts_before_the_shuffle(spark):
    plan = Q.queries()["topk_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in Q.queries()["top_sources"](spark, SF)._jdf.queryExecution().executedPlan().toString()
