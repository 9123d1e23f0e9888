"""Refinement trajectories as window analytics.

Input: one row per critique, keyed (run_id, iteration), with ``score``, ``has_hallucination``,
``has_factual_error``, ``verdict`` and ``answer``. Every window uses the same partitioning and
order (run_id, iteration), so the whole annotation costs one exchange and one sort; frames are
bounded by ``stagnation_patience`` or aggregate partially. A run of any length is annotated in
blocks of ``BLOCK`` critiques, each with the last rows of the block before it, so no run is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critica.config import DEFAULT_LOOP, LoopConfig
from critica.functions.common import py_round

RUN = "run_id"
IT = "iteration"
BLOCK = 100_000


def _w(*more: str):
    return Window.partitionBy(RUN, *more).orderBy(IT)


def quality_met_flat(cfg: LoopConfig = DEFAULT_LOOP) -> Column:
    """F1 on flat trajectory columns."""
    return (~F.col("has_hallucination") & ~F.col("has_factual_error")
            & (F.col("score") >= F.lit(cfg.min_quality_score))
            & F.col("verdict").isin("good", "excellent"))


def with_deltas(df: DataFrame, cfg: LoopConfig = DEFAULT_LOOP, within: tuple[str, ...] = ()) -> DataFrame:
    """W1 improvement_delta (0.0 on the first critique, rounded to 3) and ``recorded_delta``
    (NULL on the first critique: the tracker records nothing there); W2 is_stagnated over the last
    ``patience`` recorded deltas; W3 recent_deltas (same bounded frame)."""
    w = _w(*within)
    p = cfg.stagnation_patience
    frame = w.rowsBetween(-(p - 1), 0)
    d = py_round(F.col("score") - F.lag("score").over(w), 3)
    out = df.withColumn("recorded_delta", d)
    out = out.withColumn("improvement_delta", F.coalesce(F.col("recorded_delta"), F.lit(0.0)))
    out = out.withColumn(
        "is_stagnated",
        (F.count("recorded_delta").over(frame) >= F.lit(p))
        & (F.max("recorded_delta").over(frame) < F.lit(cfg.min_improvement_delta)))
    out = out.withColumn("recent_deltas", F.collect_list("recorded_delta").over(frame))
    return out


def exit_reason_at(cfg: LoopConfig = DEFAULT_LOOP) -> Column:
    """Converged > stagnated > exhausted (iteration >= max) > NULL (continue)."""
    return (F.when(quality_met_flat(cfg), F.lit("converged"))
            .when(F.col("is_stagnated"), F.lit("stagnated"))
            .when(F.col(IT) >= F.lit(cfg.max_iterations), F.lit("exhausted")))


def progress_label() -> Column:
    """Fixed 0.3 threshold (the reproduced loop's log label ignores the config)."""
    d = F.col("improvement_delta")
    return (F.when(d >= 0.3, F.lit("improving"))
            .when((d < 0.3) & (F.col(IT) > 1), F.lit("stagnant"))
            .otherwise(F.lit("first")))


def annotate(df: DataFrame, cfg: LoopConfig = DEFAULT_LOOP, block: int | None = None) -> DataFrame:
    """W1-W4 + W7 on every critique row (before truncation).

    With ``block``, runs are cut into blocks of so many iterations (numbered 1, 2, 3...); a block's windows also
    see the ``patience`` + 1 rows before it. Without, a run is one window partition: for cut input."""
    if block is None:
        out = with_deltas(df, cfg)
    else:
        back = cfg.stagnation_patience + 1
        if block < back:
            raise ValueError(f"block: at least {back} rows")
        own = F.floor((F.col(IT) - 1) / block)
        near_end = (F.col(IT) - 1) % block >= block - back
        spread = df.withColumn("__own", own).withColumn(
            "__block", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
        out = with_deltas(spread, cfg, ("__block",)).filter("__block = __own").drop("__block", "__own")
    out = out.withColumn("exit_reason", exit_reason_at(cfg))
    return out.withColumn("progress", progress_label())


def truncate_at_exit(annotated: DataFrame) -> DataFrame:
    """Keep rows up to and including the first exit of each run; W6 strict mode on the kept
    rows (hallucination now and in the previous critique, and the loop did not exit here)."""
    w = _w()
    first_exit = F.min(F.when(F.col("exit_reason").isNotNull(), F.col(IT))).over(
        Window.partitionBy(RUN))
    kept = annotated.withColumn("__first_exit", first_exit).filter(
        F.col("__first_exit").isNull() | (F.col(IT) <= F.col("__first_exit"))).drop("__first_exit")
    prev_h = F.coalesce(F.lag("has_hallucination").over(w), F.lit(False))
    return kept.withColumn(
        "strict_mode", F.col("has_hallucination") & prev_h & F.col("exit_reason").isNull())


def trajectories(df: DataFrame, cfg: LoopConfig = DEFAULT_LOOP) -> DataFrame:
    """W1-W7 in one pass: the critique rows the loop would have produced.

    The loop exits at ``max_iterations`` at the latest, so later critiques can never be kept;
    dropping them first (a pushed-down filter) bounds every run's window partition."""
    return truncate_at_exit(annotate(df.filter(F.col(IT) <= F.lit(cfg.max_iterations)), cfg))


def run_rollup(traj: DataFrame) -> DataFrame:
    """A1 (+A2): one row per run. ``max_by``/``min_by`` aggregate partially before the shuffle;
    ``score_history`` holds at most ``max_iterations`` scores because the trajectory is truncated
    at the first exit."""
    hist = F.transform(F.array_sort(F.collect_list(F.struct(F.col(IT), F.col("score")))),
                       lambda x: x.getField("score"))
    agg = traj.groupBy(RUN).agg(
        F.max(IT).alias("total_iterations"),
        F.max_by("exit_reason", IT).alias("__exit"),
        F.max_by("answer", IT).alias("final_answer"),
        F.max_by("score", IT).alias("final_score"),
        F.min_by("score", IT).alias("first_score"),
        F.max_by("has_hallucination", IT).alias("final_has_hallucination"),
        # exact decimal sum: the result cannot depend on the order rows arrive in
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") if "value" in traj.columns
         else F.lit(None).cast("double")).alias("latency_s"),
        hist.alias("score_history"),
    )
    exit_reason = F.coalesce(F.col("__exit"), F.lit("pending"))
    return agg.select(
        RUN, "total_iterations", exit_reason.alias("exit_reason"),
        (exit_reason == "converged").alias("converged"),
        "final_answer", "final_score", "first_score", "final_has_hallucination", "latency_s",
        "score_history",
        py_round(F.col("final_score") - F.col("first_score"), 2).alias("total_gain"))


def active_runs(traj: DataFrame) -> DataFrame:
    """Runs that have not exited continue to the next iteration - one aggregation, which is the
    anti-join of all runs with the exited ones."""
    runs = traj.groupBy(RUN).agg(F.max(IT).alias("iterations_so_far"), F.count("exit_reason").alias("__exits"))
    return runs.filter("__exits = 0").drop("__exits").withColumn("next_iteration", F.col("iterations_so_far") + 1)


def non_monotonic_runs(traj: DataFrame) -> DataFrame:
    """Runs whose score dropped at least once, with the worst drop."""
    agg = traj.groupBy(RUN).agg(
        F.bool_or(F.col("recorded_delta") < 0).alias("has_drop"),
        F.sum(F.when(F.col("recorded_delta") < 0, 1).otherwise(0)).cast("bigint").alias("n_drops"),
        F.min("recorded_delta").alias("worst_drop"))
    return agg.filter("has_drop").select(RUN, "n_drops", "worst_drop")


def streak_summaries(df: DataFrame, flag: str, block: int = BLOCK) -> DataFrame:
    """(run_id, block, length, prefix, suffix, longest, n_streaks) of the rows with ``flag`` in each block of ``block`` iterations (numbered
    1, 2, 3...): what two neighbouring blocks need to know of each other."""
    in_block = Window.partitionBy(RUN, "__block").orderBy(IT).rowsBetween(Window.unboundedPreceding, 0)
    on = F.coalesce(F.col(flag), F.lit(False))
    rows = df.select(RUN, IT, on.alias("__on"), F.floor((F.col(IT) - 1) / block).cast("long").alias("__block"))
    island = rows.withColumn("__island", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(in_block))
    sizes = island.groupBy(RUN, "__block", "__island").agg(F.sum(F.col("__on").cast("long")).alias("__n"), F.count(F.lit(1)).alias("__rows"))
    return sizes.groupBy(RUN, F.col("__block").alias("block")).agg(
        F.sum("__rows").alias("length"), F.sum(F.when(F.col("__island") == 0, F.col("__n")).otherwise(F.lit(0))).alias("prefix"),
        F.max_by("__n", "__island").alias("suffix"), F.max("__n").alias("longest"),
        F.sum(F.when(F.col("__n") > 0, 1).otherwise(0)).alias("n_streaks"))


def streaks(summaries: DataFrame) -> DataFrame:
    """(run_id, longest_streak, n_streaks) from block summaries. One row a block is left of a run here: the streak that
    reaches into a block is the suffix of the last block that is not all streak, and the whole blocks since."""
    w = Window.partitionBy(RUN).orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = summaries.withColumn("__end", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    broken = F.when(F.col("longest") < F.col("length"), F.struct(F.col("suffix").alias("suffix"), F.col("__end").alias("end")))
    rows = rows.withColumn("__last", F.last(broken, True).over(before)).withColumn("__start", F.col("__end") - F.col("length"))
    carried = F.when(F.col("__last").isNull(), F.col("__start")).otherwise(F.col("__last.suffix") + F.col("__start") - F.col("__last.end"))
    rows = rows.withColumn("__carried", carried)
    joined = (F.col("__carried") > 0) & (F.col("prefix") > 0)
    return rows.groupBy(RUN).agg(
        F.max(F.greatest("longest", F.when(joined, F.col("__carried") + F.col("prefix")).otherwise(F.lit(0)))).alias("longest_streak"),
        (F.sum("n_streaks") - F.sum(F.when(joined, 1).otherwise(0))).alias("n_streaks"))


def persistent_hallucination(traj: DataFrame, block: int = BLOCK) -> DataFrame:
    """Longest streak of consecutive hallucinating critiques per run and the number of streaks, for runs with a streak of 2 or
    more. Runs of any length: blocks are summarised by themselves, summaries merged."""
    return streaks(streak_summaries(traj, "has_hallucination", block)).filter(F.col("longest_streak") >= 2)


def stagnation_rate(rollup: DataFrame, cfg: LoopConfig = DEFAULT_LOOP) -> DataFrame:
    """Share of runs that exit stagnated and mean iterations saved against the maximum."""
    stag = F.col("exit_reason") == "stagnated"
    return rollup.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum(F.when(stag, 1).otherwise(0)).cast("bigint").alias("n_stagnated"),
        F.avg(F.when(stag, 1.0).otherwise(0.0)).alias("stagnation_rate"),
        F.avg(F.when(stag, F.lit(cfg.max_iterations) - F.col("total_iterations"))).alias(
            "mean_iterations_saved"))
