"""Trajectory cases: stagnation window, exit reasons, deltas, strict mode (as table rows)."""

import pytest
from pyspark.sql import functions as F

from critica.config import LoopConfig
from critica.functions.critic import verdict_from_score
from critica.operators import trajectory as tj

CFG = LoopConfig(max_iterations=5, min_quality_score=7.0, stagnation_patience=2, min_improvement_delta=0.3)


def runs(spark, spec):
    """spec: {run_id: [(score, hallucinated), ...]}"""
    rows = [(rid, i + 1, float(s), bool(h), False, f"answer {rid}/{i + 1}")
            for rid, its in spec.items() for i, (s, h) in enumerate(its)]
    df = spark.createDataFrame(rows, "run_id long, iteration int, score double, has_hallucination boolean, "
                                     "has_factual_error boolean, answer string")
    return df.withColumn("verdict", verdict_from_score("score"))


def collect(df):
    return {(r["run_id"], r["iteration"]): r for r in df.collect()}


def test_exit_reasons(spark):
    spec = {1: [(8.5, False)], 2: [(5.0, False)] * 3, 3: [(4.0, False), (4.5, False), (5.0, False)]}
    cfg3 = LoopConfig(max_iterations=3, stagnation_patience=5)
    r1 = collect(tj.run_rollup(tj.trajectories(runs(spark, {1: spec[1], 2: spec[2]}), CFG)).withColumn("iteration", F.lit(0)))
    assert r1[(1, 0)]["exit_reason"] == "converged" and r1[(1, 0)]["total_iterations"] == 1
    assert r1[(2, 0)]["exit_reason"] == "stagnated" and r1[(2, 0)]["total_iterations"] == 3
    r3 = tj.run_rollup(tj.trajectories(runs(spark, {3: spec[3]}), cfg3)).first()
    assert r3["exit_reason"] == "exhausted" and r3["total_iterations"] == 3


def test_deltas(spark):
    t = collect(tj.trajectories(runs(spark, {1: [(4.0, False), (6.5, False), (8.5, False)]}), CFG))
    assert t[(1, 1)]["improvement_delta"] == 0.0
    assert t[(1, 2)]["improvement_delta"] == pytest.approx(2.5)


@pytest.mark.parametrize("deltas,stagnated", [
    ([0.1], False), ([0.1, 0.1], True), ([0.1, 0.5], False), ([0.3, 0.3], False), ([-0.5, -0.2], True)])
def test_stagnation_window(spark, deltas, stagnated):
    scores = [1.0]
    for d in deltas:
        scores.append(scores[-1] + d)
    cfg = LoopConfig(max_iterations=10)
    a = collect(tj.annotate(runs(spark, {1: [(s, False) for s in scores]}), cfg))
    assert a[(1, len(scores))]["is_stagnated"] is stagnated


def test_strict_mode(spark):
    t = collect(tj.trajectories(runs(spark, {
        1: [(3.0, True), (3.5, True), (8.5, False)],
        2: [(3.0, True), (6.5, False), (8.5, False)]}), CFG))
    assert [t[(1, i)]["strict_mode"] for i in (1, 2, 3)] == [False, True, False]
    assert [t[(2, i)]["strict_mode"] for i in (1, 2, 3)] == [False, False, False]


def test_one_exit_per_run_and_truncation(spark):
    t = tj.trajectories(runs(spark, {1: [(8.0, False), (2.0, False), (9.0, False)]}), CFG)
    rows = t.collect()
    assert len(rows) == 1 and rows[0]["exit_reason"] == "converged"


def test_fixture_counts(spark):
    """FIXTURES.md: 4,006 runs = 1,119 converged, 861 exhausted, 221 stagnated, 1,805 pending."""
    from critica.sources.fixtures import trajectory_iterations
    from critica.sources.tables import table
    ev = table(spark, "/root/testdata/sf0.01", "events")
    roll = tj.run_rollup(tj.trajectories(trajectory_iterations(ev)))
    got = {r["exit_reason"]: r["count"] for r in roll.groupBy("exit_reason").count().collect()}
    assert got == {"converged": 1119, "exhausted": 861, "stagnated": 221, "pending": 1805}
