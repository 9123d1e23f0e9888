"""The batch loop with the test backend, per-row error capture, and ST1 == batch windows."""

from pyspark.sql import functions as F

import __spark_entry__ as se
from critica.operators import trajectory as tj
from critica.plans import refine as rf
from critica.plans.inference import ColumnBackend, PandasBackend, StoredBackend
from critica.sources import fixtures as fx
from critica.sources.tables import table
from critica.streaming import monitor as sm
from tests.conftest import SF_SMALL


POOR = '{"score": 2, "verdict": "poor", "hallucinations": ["made up"]}'
FINE = '{"score": 9, "verdict": "excellent"}'


class Alternating(ColumnBackend):
    """A fine critique when iteration and key length have the same parity."""

    def completion(self, prompt, system, iteration, key):
        fine = (iteration + F.length(key)) % 2 == 0
        return F.when(F.contains(prompt, F.lit("ANSWER UNDER REVIEW")), F.when(fine, F.lit(FINE)).otherwise(F.lit(POOR))).otherwise(
            F.lit("some text"))


class AlwaysPoor(ColumnBackend):
    def completion(self, prompt, system, iteration, key):
        return F.lit(POOR)


class Counted(PandasBackend):
    """Counts its calls; fails on prompts with a marker."""

    def __init__(self, calls):
        self.calls = calls

    def complete_one(self, client, prompt, system):
        self.calls.add(1)
        if "boom" in prompt:
            raise RuntimeError("no")
        return FINE


def test_refine_loop_exits_follow_the_critiques(spark):
    q = spark.createDataFrame([("a", "odd"), ("bb", "even")], "run_id string, query string")
    runs, its = rf.refine_batch(spark, q, Alternating())
    got = {r["run_id"]: r for r in runs.collect()}
    assert got["a"]["total_iterations"] == 1 and got["a"]["exit_reason"] == "converged"
    assert got["bb"]["total_iterations"] == 2 and got["bb"]["score_history"] == [0.0, 9.0]
    assert its.filter("run_id = 'bb' AND iteration = 1").first()["strict_mode_used"] is False


def test_stagnation_in_loop(spark):
    from critica.config import LoopConfig
    q = spark.createDataFrame([("1", "query")], "run_id string, query string")
    r = rf.refine_batch(spark, q, AlwaysPoor(), LoopConfig(max_iterations=5))[0].first()
    assert r["exit_reason"] == "stagnated" and r["total_iterations"] == 3


def test_errors_are_rows_and_calls_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)
    q = spark.createDataFrame([("1", "boom"), ("2", "ok")], "run_id string, query string").repartition(2)
    out = rf.generate_batch(q, Counted(calls))
    for _ in range(3):
        errs = {r["query"]: r["error"] for r in out.collect()}
    assert errs["boom"].startswith("RuntimeError") and errs["ok"] is None and calls.value == 2
    judged = rf.judge_batch(q.withColumn("final_answer", F.lit("x")), Counted(calls))
    judged.count(), judged.collect()
    assert calls.value == 4


def test_failed_calls_end_runs_with_zeros(spark):
    """Failures in generation, critique and refinement; a run without recorded completions fails too."""
    said = []
    for k in ("gen", "crit", "refine", "fine"):
        said.append((k, "generate", 1, "answer", 1.0, "E: g" if k == "gen" else None))
        for i in (1, 2, 3):
            said.append((k, "critique", i, FINE if k == "fine" else POOR, 1.0, "E: c" if k == "crit" else None))
            said.append((k, "refine", i, "better", 1.0, "E: r" if k == "refine" else None))
    table = spark.createDataFrame(said, "key string, role string, iteration int, completion string, latency_s double, error string")
    q = spark.createDataFrame([(k, "q") for k in ("gen", "crit", "refine", "fine", "none")], "run_id string, query string")
    got = {r["run_id"]: r for r in rf.refine_batch(spark, q, StoredBackend(table))[0].collect()}
    for k, error in (("gen", "E: g"), ("crit", "E: c"), ("refine", "E: r"), ("none", "KeyError: no stored completion")):
        r = got[k]
        assert (r["exit_reason"], r["final_answer"], r["total_iterations"], r["final_score"]) == ("error", f"[ERROR: {error}]", 0, 0.0)
    assert got["fine"]["exit_reason"] == "converged"


def test_checkpoint_folder_is_required_off_local_masters(spark, monkeypatch):
    import pytest

    from critica import session as cs
    assert cs.is_local("local") and cs.is_local("local[8]") and not cs.is_local("local-cluster[2,1,1024]") and not cs.is_local("yarn")

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(RuntimeError):
        cs.checkpoint_dir(type("S", (), {"sparkContext": Context()})())


def test_st1_equals_batch_windows(spark):
    a = se.queries()["st1_stagnation_monitor"](spark, SF_SMALL)
    b = tj.trajectories(fx.trajectory_iterations(table(spark, SF_SMALL, "events")))
    cols = ["run_id", "iteration", "improvement_delta", "is_stagnated", "exit_reason", "strict_mode"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_st1_flags_late_critiques_across_batches(spark, tmp_path):
    """Two micro-batches: the second carries an older critique for run 1 -> flagged late."""
    import datetime as dt
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    t = dt.datetime(2024, 1, 5, 12, 0, 0)
    src = tmp_path / "events"
    spark.createDataFrame([(1, t, 0, "view", 20.0, "{}"), (2, t + dt.timedelta(hours=1), 0, "view", 30.0, "{}")],
                          schema).coalesce(1).write.parquet(str(src / "b1"))
    spark.createDataFrame([(3, t - dt.timedelta(hours=1), 0, "view", 35.0, "{}")],
                          schema).coalesce(1).write.parquet(str(src / "b2"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "b*"))
    mon = sm.stagnation_monitor(sm.critique_events(stream), ttl_ms=None)
    out = sm.run_available_now(spark, mon, str(tmp_path / "out")).orderBy("iteration").collect()
    assert [r["iteration"] for r in out] == [1, 2, 3] and not any(r["after_exit"] for r in out)
    assert [r["late"] for r in out] == [False, False, True]
    assert out[2]["exit_reason"] == "exhausted"       # third critique reaches max_iterations=3
