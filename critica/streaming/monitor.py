"""Structured Streaming operators.

ST1 stagnation_monitor: a ``StatefulProcessor`` (``transformWithState``, row by row, RocksDB) keyed by run, with a typed value
state (iteration, previous score, previous hallucination flag, exit flag, last time stamp) and a list state of the last ``patience``
recorded deltas. Each incoming critique gets its iteration number, delta, stagnation flag, exit reason and strict-mode
flag - the streaming twin of W1-W6. A run that exits keeps its small state (so later critiques are not taken as a new
run) until the state's own TTL removes it. Critiques after an exit come out too, with ``after_exit`` set and no
iteration. With ``idle_ms``, a timer closes runs that never exited: one row with exit reason ``pending``.

ST2 score_stream: the stateless Column scorers (M9, C3) on a stream - same expressions as batch.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from critica.config import DEFAULT_LOOP, LoopConfig

OUTPUT_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("iteration", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("improvement_delta", T.DoubleType()),
    T.StructField("is_stagnated", T.BooleanType()),
    T.StructField("exit_reason", T.StringType()),
    T.StructField("strict_mode", T.BooleanType()),
    T.StructField("late", T.BooleanType()),
    T.StructField("after_exit", T.BooleanType()),
])
RUN_STATE = T.StructType([
    T.StructField("iteration", T.LongType()),
    T.StructField("prev_score", T.DoubleType()),
    T.StructField("prev_has_h", T.BooleanType()),
    T.StructField("exited", T.BooleanType()),
    T.StructField("last_ts", T.StringType()),
])
DELTA_STATE = T.StructType([T.StructField("delta", T.DoubleType())])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _round_half_up(x: float, digits: int) -> float:
    s = 10.0 ** digits
    return math.floor(x * s + 0.5) / s


def _band(score: float) -> str:
    if score >= 8.5:
        return "excellent"
    if score >= 6.5:
        return "good"
    if score >= 4.0:
        return "acceptable"
    return "poor"


class RunMonitor(StatefulProcessor):
    """One run's critiques of a micro-batch in time order. At most ``max_iterations`` of them are held: a run exits there at
    the latest, so what falls out of that head came after the exit."""

    def __init__(self, cfg: LoopConfig, ttl_ms: int | None = None, idle_ms: int | None = None):
        self.cfg, self.ttl_ms, self.idle_ms = cfg, ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN_STATE, self.ttl_ms)
        self.deltas = handle.getListState("deltas", DELTA_STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cfg, (run_id,) = self.cfg, key
        kept = self.run.get()
        it, prev, prev_h, exited, last_ts = kept or (0, None, False, False, "")
        deltas = [d for (d,) in self.deltas.get()] if it > 1 and not exited else []
        known, began = len(deltas), it
        room = 0 if exited else max(cfg.max_iterations - it, 0)
        head: list[Row] = []
        for r in rows:
            insort(head, r, key=lambda x: (x.ts, x.event_id))
            if len(head) > room:
                yield self._after(run_id, head.pop(), last_ts)
        for r in head:
            if exited:
                yield self._after(run_id, r, last_ts)
                continue
            ts = str(r.ts)
            it += 1
            delta = None if prev is None else _round_half_up(r.score - prev, 3)
            if delta is not None:
                deltas = [*deltas, delta][-cfg.stagnation_patience:]
            stagnated = len(deltas) >= cfg.stagnation_patience and max(deltas) < cfg.min_improvement_delta
            quality = (not r.has_hallucination and not r.has_factual_error and r.score >= cfg.min_quality_score
                       and _band(r.score) in ("good", "excellent"))
            reason = ("converged" if quality else "stagnated" if stagnated else "exhausted" if it >= cfg.max_iterations else None)
            yield self._row(run_id, it, r.event_id, r.score, delta or 0.0, stagnated, reason,
                            bool(r.has_hallucination and prev_h and reason is None), bool(last_ts) and ts < last_ts)
            prev, prev_h, last_ts, exited = r.score, r.has_hallucination, max(last_ts, ts), reason is not None
        if it > began:
            self.run.update((it, prev, prev_h, exited, last_ts))
            if exited and known:
                self.deltas.clear()
            elif deltas and not exited:
                self.deltas.put([(d,) for d in deltas])
            if self.idle_ms:
                self._wait(None if exited else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.run.get()
        if kept and not kept[3]:
            yield self._row(key[0], kept[0], None, kept[1], 0.0, False, "pending", False, False)
        self.run.clear()
        self.deltas.clear()

    def close(self) -> None:
        pass

    def _wait(self, until: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if until is not None:
            self.handle.registerTimer(until)

    @classmethod
    def _after(cls, run_id, r: Row, last_ts: str) -> Row:
        return cls._row(run_id, None, r.event_id, r.score, 0.0, False, None, False, bool(last_ts) and str(r.ts) < last_ts, True)

    @staticmethod
    def _row(run_id, iteration, event_id, score, delta, stagnated, reason, strict, late, after=False) -> Row:
        return Row(run_id=run_id, iteration=iteration, event_id=event_id, score=score, improvement_delta=delta, is_stagnated=stagnated,
                   exit_reason=reason, strict_mode=strict, late=late, after_exit=after)


def critique_events(events: DataFrame) -> DataFrame:
    """Trajectory fixture rows on a stream (no window needed: the state assigns iterations)."""
    return events.select(
        (F.col("user_id") * F.lit(100) + F.dayofmonth("ts")).alias("run_id"), "ts", "event_id",
        F.least(F.col("value") / F.lit(10.0), F.lit(10.0)).alias("score"),
        (F.col("event_type") == "error").alias("has_hallucination"),
        (F.col("event_type") == "signup").alias("has_factual_error"))


def stagnation_monitor(critiques: DataFrame, cfg: LoopConfig = DEFAULT_LOOP,
                       ttl_ms: int | None = 3_600_000, idle_ms: int | None = None) -> DataFrame:
    """ST1 on a streaming DataFrame of (run_id, ts, event_id, score, has_hallucination, has_factual_error).

    ``ttl_ms`` removes the state of runs without critiques for so long, ``idle_ms`` closes unfinished ones with a row (both in
    processing time); with neither, a bounded run ends (with one of them, Spark goes on looking for expired state).
    The query must start under the RocksDB provider: see ``rocksdb`` and ``run_available_now``."""
    mode = "ProcessingTime" if ttl_ms or idle_ms else "None"
    return critiques.groupBy("run_id").transformWithState(RunMonitor(cfg, ttl_ms, idle_ms), OUTPUT_SCHEMA, "Append", mode)


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB (on disk, so state may outgrow an executor's heap)."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_available_now(spark: SparkSession, df: DataFrame, base: str) -> DataFrame:
    """Run a streaming DataFrame to completion (Trigger.AvailableNow) into parquet under ``base``
    (checkpoint alongside) and return the written table as a batch DataFrame. Called again with the same ``base``, it goes on from
    the checkpoint."""
    with rocksdb(spark):
        q = (df.writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/_checkpoint").outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")
