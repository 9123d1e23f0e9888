"""A run holding a third of all critiques: results equal a brute-force loop, and the plan cuts
the hot run map-side (partial WindowGroupLimit before the exchange)."""

import datetime as dt
import random

from critica.config import LoopConfig
from critica.operators import trajectory as tj
from critica.sources.fixtures import trajectory_iterations


def brute_force(events, cfg):
    """Plain-Python loop over one run's events ordered by (ts, event_id)."""
    prev, deltas, out = None, [], []
    for it, (ts, eid, etype, value) in enumerate(sorted(events)[:cfg.max_iterations], start=1):
        score = min(value / 10.0, 10.0)
        if prev is not None:
            import math
            deltas = (deltas + [math.floor((score - prev) * 1000 + 0.5) / 1000])[-cfg.stagnation_patience:]
        stag = len(deltas) >= cfg.stagnation_patience and max(deltas) < cfg.min_improvement_delta
        band = "excellent" if score >= 8.5 else "good" if score >= 6.5 else "acceptable" if score >= 4 else "poor"
        ok = etype not in ("error", "signup") and score >= cfg.min_quality_score and band in ("good", "excellent")
        ex = "converged" if ok else "stagnated" if stag else "exhausted" if it >= cfg.max_iterations else None
        out.append(ex)
        prev = score
        if ex:
            return it, ex
    return len(out), "pending"


def test_hot_run(spark):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = []
    eid = 0
    for user in range(60):
        n = 3000 if user == 0 else rnd.randint(1, 100)   # user 0 holds about a third of all rows
        for _ in range(n):
            rows.append((eid, t0 + dt.timedelta(hours=rnd.randint(0, 10)), user,
                         rnd.choice(["view", "click", "error", "signup", "purchase"]),
                         round(rnd.uniform(0, 100), 2)))
            eid += 1
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    cfg = LoopConfig(max_iterations=10)
    rows_df = trajectory_iterations(ev.repartition(16), cfg, run_divisor=None)
    roll = {r["run_id"]: r for r in tj.run_rollup(tj.trajectories(rows_df, cfg)).collect()}
    by_user = {}
    for e, ts, u, et, v in rows:
        by_user.setdefault(u, []).append((ts, e, et, v))
    for u, evs in by_user.items():
        n, ex = brute_force(evs, cfg)
        assert (roll[u]["total_iterations"], roll[u]["exit_reason"]) == (n, ex), u
    plan = rows_df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hot_run_is_annotated_in_blocks(spark):
    """W1-W4 and W7 on every critique of a hot run: blocks equal one window, and no run is one task."""
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=rnd.randint(0, 500)), 0 if i % 3 else rnd.randint(1, 40), "view", round(rnd.uniform(0, 100), 2))
            for i in range(3000)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(8)
    every = trajectory_iterations(ev, run_divisor=None, cut=False)
    cols = ["run_id", "iteration", "improvement_delta", "is_stagnated", "recent_deltas", "exit_reason", "progress"]
    whole = tj.annotate(every).select(cols)
    blocks = tj.annotate(every, block=50).select(cols)
    assert sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect()))
    assert every.count() == 3000
    order = {r["event_id"]: r["iteration"] for r in every.filter("run_id = 0").collect()}
    want = sorted((r for r in rows if r[2] == 0), key=lambda r: (r[1], r[0]))
    assert [order[r[0]] for r in want] == list(range(1, len(want) + 1))


def test_pairs_follow_turn_order_with_gaps(spark):
    from critica.sources.io import qa_pairs
    rows = [(1, 1, "user", "a"), (1, 5, "assistant", "b"), (1, 9, "user", "c"), (1, 10, "user", "d"), (1, 12, "assistant", "e"),
            (2, 1, "assistant", "x"), (None, 1, "user", "y"), (None, 3, "assistant", "z")]
    got = qa_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["query"], r["answer"]) for r in got if r["conv_id"] == 1) == [("a", "b"), ("d", "e")]
