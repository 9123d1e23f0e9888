"""S2, S3, D4 and S5 on files; X2 over runs of any length; T1 on hostile pages; resumable calls; the stateful monitor."""

import datetime as dt
import json
import random
import re
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from critica.config import LoopConfig
from critica.functions.html import html_to_text, without_blocks
from critica.operators import trajectory as tj
from critica.operators.ordering import with_position
from critica.operators.training import split_prefix
from critica.plans import refine as rf
from critica.plans.inference import CallLog, PandasBackend
from critica.sources import io
from critica.sources import json_array as ja
from critica.streaming import monitor as sm


# --- S2 ------------------------------------------------------------------------------------------------
def odd_records(n, seed):
    rng = random.Random(seed)
    bits = ['plain', 'quote " inside', 'back\\slash', 'end\\\\', '}', '{', '[1, {"a": "}"}]', 'é日😀', 'new\nline', '', ' ', '\\"}', '"}, {"']
    text = lambda: " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))
    return [{"query": text(), "answer": text() * rng.randrange(1, 4), "feedback": {
        "factual_errors": [text() for _ in range(rng.randrange(3))], "hallucinations": [], "missing_concepts": [text()],
        "logical_flaws": [], "score": i / 10, "verdict": text()}} for i in range(n)]


def as_rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_file_is_read_by_many_tasks(spark, tmp_path, indent):
    records = odd_records(400, 1)
    (tmp_path / "a.json").write_text(" \n" + json.dumps(records, indent=indent, ensure_ascii=False) + "\n")
    size = (tmp_path / "a.json").stat().st_size
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 8 + 1))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        known = ja.ranges(ja.fragments(spark, str(tmp_path / "a.json")))
        assert known.count() >= 8
        assert as_rows(io.read_training(spark, str(tmp_path / "a.json"))) == sorted(json.dumps(r, sort_keys=True) for r in records)
        # records longer than a range
        long = odd_records(3, 2)
        long[1]["answer"] = "x } \" { " * (size // 2)
        (tmp_path / "b.json").write_text(json.dumps(long, indent=indent))
        assert as_rows(io.read_training(spark, str(tmp_path / "b.json"), json_array=True)) == sorted(json.dumps(r, sort_keys=True) for r in long)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_kind_is_told_file_by_file(spark, tmp_path):
    a, b, c = odd_records(20, 3), odd_records(20, 4), odd_records(1, 5)
    (tmp_path / "1.json").write_text(json.dumps(a))
    (tmp_path / "2.json").write_text("\n".join(json.dumps(r) for r in b))
    (tmp_path / "3.json").write_text("\n[\n" + json.dumps(c[0]) + "\n]")
    (tmp_path / "4.json").write_text(" [ ] ")
    (tmp_path / "5.json").write_text("")
    assert as_rows(io.read_training(spark, str(tmp_path))) == sorted(json.dumps(r, sort_keys=True) for r in a + b + c)
    assert as_rows(io.read_training(spark, str(tmp_path / "2.json"))) == sorted(json.dumps(r, sort_keys=True) for r in b)


# --- S3, D4 --------------------------------------------------------------------------------------------
def test_positions_follow_files(spark, tmp_path):
    for part, n in (("a", 70), ("b", 0), ("c", 45)):
        spark.range(n).select(F.lit(part).alias("part"), (F.lit(100) - F.col("id")).alias("v"), F.lit(1).alias("same")).coalesce(1).write.parquet(
            f"{tmp_path}/t/part={part}x")
    df = spark.read.parquet(f"{tmp_path}/t/*")
    want = [("a", 100 - i) for i in range(70)] + [("c", 100 - i) for i in range(45)]
    got = sorted((r["position"], r["part"], r["v"]) for r in with_position(df).collect())
    assert got == [(i, p, v) for i, (p, v) in enumerate(want)]
    assert sorted((r["part"], r["v"]) for r in io.cap_samples(df, 80).collect()) == sorted(want[:80])
    assert [r["v"] for r in io.cap_samples(df, 2, ["v", "part"]).collect()] == [31, 32]
    split = {(r["part"], r["v"]): r["split"] for r in split_prefix(df).collect()}
    assert [split[w] for w in want] == ["train"] * 103 + ["val"] * 12


def test_lines_without_row_index_have_positions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"a{i}" for i in range(500)))
    (tmp_path / "b.txt").write_text("\n".join(f"b{i}" for i in range(30)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        got = [r["value"] for r in with_position(spark.read.text(str(tmp_path))).orderBy("position").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"a{i}" for i in range(500)] + [f"b{i}" for i in range(30)]


def test_one_order_value_is_many_tasks(spark, tmp_path):
    spark.range(4000).select("id", F.lit("en").alias("lang")).coalesce(1).write.parquet(f"{tmp_path}/t")
    out = split_prefix(spark.read.parquet(f"{tmp_path}/t"), "lang")
    assert sorted((r["row_index"], r["id"], r["split"] == "train") for r in out.collect()) == [(i, i, i < 3600) for i in range(4000)]
    dealt = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 4000 / 2


# --- S5 ------------------------------------------------------------------------------------------------
def test_report_is_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    results = spark.createDataFrame([("A", 1), ("B", 2)], "system_name string, v int")
    one = spark.createDataFrame([("A", 0.5)], "system_name string, v double")
    path = str(tmp_path / "report")
    with pytest.raises(Exception):
        io.read_report(spark, path)
    first = io.write_report(results, one, one, path, fmt="parquet")

    class Broken:
        def coalesce(self, n):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        io.write_report(results.limit(1), one.limit(0), Broken(), path, fmt="parquet")
    old = io.read_report(spark, path)
    assert {k: v.count() for k, v in old.items()} == {"results": 2, "summaries": 1, "improvements": 1}
    second = io.write_report(results.limit(1), one, one, path, fmt="json")
    assert second["stamp"] > first["stamp"] and io.read_report(spark, path)["results"].count() == 1
    assert io.read_report(spark, path, stamp=first["stamp"])["results"].count() == 2


# --- X2 ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_streaks_merge_over_blocks(spark, block):
    rng = random.Random(block)
    runs = {r: [rng.random() < p for _ in range(n)] for r, (n, p) in enumerate([(90, .5), (60, .95), (1, 1), (40, 0), (50, 1), (7, .5)])}
    runs[6] = [True] * 7 + [False] + [True] * 14
    rows = [(r, i + 1, h if h or rng.random() < .5 else None) for r, hs in runs.items() for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "run_id long, iteration long, has_hallucination boolean").repartition(4)
    got = {r["run_id"]: (r["longest_streak"], r["n_streaks"]) for r in tj.persistent_hallucination(df, block).collect()}
    want = {}
    for r, hs in runs.items():
        streaks = [len(s) for s in "".join("h" if h else " " for h in hs).split()]
        if streaks and max(streaks) > 1:
            want[r] = (max(streaks), len(streaks))
    assert got == want


# --- T1 ------------------------------------------------------------------------------------------------
LAZY = re.compile(r"(?is)<(script|style)[^>]*>.*?</(script|style)>")


def test_blocks_equal_the_lazy_pattern(spark):
    rng = random.Random(2)
    parts = ["<script>", "</script>", "<STYLE a='b'>", "</Style>", "<script ", "<style", ">", "<", "text", "<p>", "</p>", "\n", "<scr", "ipt>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(3000)] + [None, ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id long, html string")
    out = df.select("id", without_blocks("html").alias("a"), html_to_text("html").alias("t")).collect()
    for r in out:
        page = pages[r["id"]]
        if page is None:
            assert r["a"] is None and r["t"] is None
            continue
        tags = lambda x: re.sub(r"<[^>]+>", " ", x)  # noqa: E731 - an end tag that drops nothing is a tag like others
        assert tags(r["a"]) == tags(LAZY.sub(" ", page)), page
        assert r["t"] == re.sub(r"\s+", " ", tags(LAZY.sub(" ", page))).strip()


def test_unclosed_blocks_take_linear_time(spark):
    hostile = ["<script>" * 130_000, "<script " * 130_000, "<" * 1_000_000, "<script></style>" * 60_000, "</script><style " * 60_000]
    df = spark.createDataFrame([(h,) for h in ["<script>" * 50, *hostile]], "html string").repartition(1)
    df.limit(1).select(F.length(html_to_text("html"))).collect()
    for h in hostile:
        one = spark.createDataFrame([(h,)], "html string")
        began = time.perf_counter()
        one.select(F.length(html_to_text("html"))).collect()
        assert time.perf_counter() - began < 4


# --- I5 ------------------------------------------------------------------------------------------------
class Countdown(PandasBackend):
    """Counts its calls; critiques never please, so every run goes to its last iteration."""

    def __init__(self, calls):
        self.calls = calls

    def complete_one(self, client, prompt, system):
        self.calls.add(1)
        if "ANSWER UNDER REVIEW" in prompt:
            return json.dumps({"score": 2 + len(prompt) % 3, "verdict": "poor", "hallucinations": ["x"]})
        return "better " + prompt[-20:]


@pytest.mark.parametrize("slices", [1, 3])
def test_a_lost_driver_repeats_no_call(spark, tmp_path, monkeypatch, slices):
    cfg = LoopConfig(max_iterations=3, stagnation_patience=5)
    queries = spark.createDataFrame([(f"r{i}", f"question {i}") for i in range(7)], "run_id string, query string")
    whole = spark.sparkContext.accumulator(0)
    log = CallLog(spark, "whole", str(tmp_path), slices)
    want = sorted(map(str, rf.refine_batch(spark, queries, Countdown(whole), cfg, log=log)[0].drop("latency_s").collect()))
    assert whole.value == 7 * (1 + 3 + 2)
    calls, rounds, original = spark.sparkContext.accumulator(0), [], rf.critique_batch

    def dying(*args, **kwargs):
        rounds.append(1)
        if len(rounds) == 2:
            raise KeyboardInterrupt("driver lost after iteration 1")
        return original(*args, **kwargs)

    monkeypatch.setattr(rf, "critique_batch", dying)
    with pytest.raises(KeyboardInterrupt):
        rf.refine_batch(spark, queries, Countdown(calls), cfg, log=CallLog(spark, "cut", str(tmp_path), slices))
    assert calls.value == 7 * 3
    monkeypatch.setattr(rf, "critique_batch", original)
    again = rf.refine_batch(spark, queries, Countdown(calls), cfg, log=CallLog(spark, "cut", str(tmp_path), slices))[0]
    assert sorted(map(str, again.drop("latency_s").collect())) == want
    assert calls.value == whole.value


def test_failed_calls_are_kept_or_asked_again(spark, tmp_path):
    class Failing(PandasBackend):
        def complete_one(self, client, prompt, system):
            raise RuntimeError("busy")

    q = spark.createDataFrame([("a", "x"), ("b", "y")], "run_id string, query string")
    rf.generate_batch(q, Failing(), key="run_id", log=CallLog(spark, "n", str(tmp_path)))
    calls = spark.sparkContext.accumulator(0)
    kept = rf.generate_batch(q, Countdown(calls), key="run_id", log=CallLog(spark, "n", str(tmp_path)))
    assert kept.filter("error LIKE '%busy%'").count() == 2 and calls.value == 0
    retried = rf.generate_batch(q, Countdown(calls), key="run_id", log=CallLog(spark, "n", str(tmp_path), retry_errors=True))
    assert retried.filter("error IS NULL AND answer IS NOT NULL").count() == 2 and calls.value == 2


# --- ST1 -----------------------------------------------------------------------------------------------
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def monitor_rows(spark, src, base):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{src}/b*")
    return sm.run_available_now(spark, sm.stagnation_monitor(sm.critique_events(stream), ttl_ms=None), base)


def test_monitor_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped in the middle and started again: the same rows, after_exit included, as in one go."""
    rng, t0 = random.Random(5), dt.datetime(2024, 1, 5)
    rows = [(i, t0 + dt.timedelta(minutes=i), 0 if i % 3 == 0 else rng.randrange(1, 12), rng.choice(["view", "error", "signup"]),
             round(rng.uniform(0, 100), 2)) for i in range(240)]

    def part(folder, i):
        spark.createDataFrame(rows[i * 60:(i + 1) * 60], EVENTS).coalesce(1).write.parquet(str(tmp_path / folder / f"b{i}"))

    for i in range(4):
        part("one", i)
    for i in range(2):
        part("two", i)
    whole = monitor_rows(spark, tmp_path / "one", str(tmp_path / "run1"))
    monitor_rows(spark, tmp_path / "two", str(tmp_path / "run2"))
    for i in (2, 3):
        part("two", i)
    resumed = monitor_rows(spark, tmp_path / "two", str(tmp_path / "run2"))
    assert whole.count() == 240 and sorted(map(str, resumed.collect())) == sorted(map(str, whole.collect()))
    assert whole.filter("after_exit").count() > 100
    from critica.sources.fixtures import trajectory_iterations
    batch = tj.trajectories(trajectory_iterations(spark.createDataFrame(rows, EVENTS)))
    cols = ["run_id", "iteration", "improvement_delta", "is_stagnated", "exit_reason", "strict_mode"]
    assert sorted(map(str, whole.filter("not after_exit").select(cols).collect())) == sorted(map(str, batch.select(cols).collect()))


class FakeHandle:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.timers, self.ttl = [], {}

    def getValueState(self, name, schema, ttl=None):
        self.ttl[name] = ttl
        box = []
        return SimpleNamespace(get=lambda: box[0] if box else None, update=lambda v: box.__setitem__(slice(None), [v]), clear=box.clear)

    def getListState(self, name, schema, ttl=None):
        self.ttl[name] = ttl
        box = []
        return SimpleNamespace(get=lambda: iter(list(box)), put=lambda v: box.__setitem__(slice(None), v), clear=box.clear)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(list(self.timers))


def test_idle_runs_are_closed_by_a_timer():
    handle, monitor = FakeHandle(), sm.RunMonitor(LoopConfig(max_iterations=3), ttl_ms=1000, idle_ms=500)
    monitor.init(handle)
    assert handle.ttl == {"run": 1000, "deltas": 1000}
    at = lambda ms: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)
    row = lambda i, score: SimpleNamespace(ts=dt.datetime(2024, 1, 1, 0, i), event_id=i, score=score, has_hallucination=False,
                                           has_factual_error=False)
    out = list(monitor.handleInputRows((7,), iter([row(1, 2.0)]), at(100)))
    assert [r.iteration for r in out] == [1] and handle.timers == [600]
    out = list(monitor.handleInputRows((7,), iter([row(2, 4.0)]), at(300)))
    assert out[0].improvement_delta == 2.0 and handle.timers == [800]
    (closed,) = monitor.handleExpiredTimer((7,), at(900), None)
    assert (closed.exit_reason, closed.iteration, closed.score, closed.event_id) == ("pending", 2, 4.0, None)
    # a new run under the same key; it exits, so no timer is left and an expiry says nothing
    out = list(monitor.handleInputRows((7,), iter([row(5, 9.0), row(6, 9.0)]), at(1000)))
    assert [(r.iteration, r.exit_reason, r.after_exit) for r in out] == [(1, "converged", False), (None, None, True)]
    assert handle.timers == [] or handle.timers == [800]
    assert list(monitor.handleExpiredTimer((7,), at(2000), None)) == []


def test_a_hot_run_is_never_held_whole():
    handle, monitor = FakeHandle(), sm.RunMonitor(LoopConfig(max_iterations=3))
    monitor.init(handle)

    def rows():
        for i in range(50_000, 0, -1):
            yield SimpleNamespace(ts=dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), event_id=i, score=1.0, has_hallucination=False,
                                  has_factual_error=False)

    out = monitor.handleInputRows((1,), rows(), None)
    assert next(out).event_id == 50_000  # rows leave while others still come
    rest = list(out)
    kept = [r for r in rest if not r.after_exit]
    assert [r.event_id for r in kept] == [1, 2, 3] and len(rest) == 49_999
